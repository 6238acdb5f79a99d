"""Near-duplicate documents by MinHash.

A document's set holds its distinct five-word shingles (ASCII lower case;
fewer words: the whole sequence). Documents with equal sets are one class, met
once from here on. Every class has ``BANDS * ROWS`` universal hash minima;
classes that agree in a whole band share a bucket. Pairs of a bucket are
screened by their sizes and by one-bit signatures of their minima, and
confirmed on the full sets (100 * intersection >= percent * union). Links join
up by large-star and small-star.

Not all pairs of a bucket are made. First every member meets the smallest one;
then members that are still apart meet the member with most links; and only
pairs of different components are made in the last round. Members of one
component need no further links, so none between different components is lost.
In the last round a bound by rarity spares pairs that cannot be similar: with
q(x) shingles of x in no other document of that round, the intersection of x
and y is at most min(n(x) - q(x), n(y) - q(y)).
A pair that shares several buckets is made in the first of them alone. A link
at the threshold itself shares no band with probability 2e-7, and the screen
drops it with about as much.

What is asked of a bucket (its least and greatest member, the member of most
links) is an aggregate with partial sums, written and joined back, so that
Spark can split a large bucket's rows.

Rows: null or empty texts, and texts without words, have the empty set and are
linked with nothing. Rows that repeat a doc_id and text get the same result. An
id is one node: where it has several texts, each row gets the component of its own
text, and those texts' classes may meet in the id. A null doc_id takes no part
(component null, kept). Ties: the smallest id stands for a class and for a
component. Very long texts are hashed a piece at a time. Empty tables give an
empty result. Extra columns are not read, but for those to ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope.llm.components import connected_components
from firmscope.llm.shared import arrow_rows, written

WORDS = 5
PERCENT = 85
BANDS, ROWS = 40, 7
#: One-bit signatures: minima used, and bits that may differ. A linked pair
#: differs in a bit with at most (1 - 0.85) / 2, so in 256 with mean 19.2 and
#: deviation 4.2; 42 is more than five deviations away.
SIGNATURE_BITS, MAX_DIFFERENT = 256, 42
#: Shingles hashed at a time.
PIECE = 2048
#: Bytes of text whose shingles meet in one range, about.
RANGE_BYTES = 16 << 20
#: In place of the id of several texts. A text of this very id would only get a weaker bound.
NO_OWNER = np.iinfo(np.int64).min
#: Rows with two texts in an Arrow batch.
PAIR_ROWS = 200

_MIX = np.uint64(0xBF58476D1CE4E5B9)


@cache
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    odd = lambda n: rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(WORDS), odd(BANDS * ROWS), rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64), odd(ROWS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a UTF-8 text."""
    words = text.lower().split() if text else []  # of bytes: A-Z, and \\x20 \\x09-\\x0D
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    factors = _constants()[0]
    n = len(words) - WORDS + 1
    total = h[:n] * factors[0]
    for i in range(1, WORDS):
        total += h[i : i + n] * factors[i]
    return np.unique(_mixed(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash function."""
    _, a, b, _ = _constants()
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), PIECE):
        np.minimum(out, (np.multiply.outer(shingles[i : i + PIECE], a) + b).min(axis=0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    per_band = (least.reshape(BANDS, ROWS) * _constants()[3]).sum(axis=1, dtype=np.uint64)
    return _mixed(per_band + np.arange(BANDS, dtype=np.uint64) * _MIX).astype(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    bits = (_mixed(least[:SIGNATURE_BITS]) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_shingles, set_id, bands, sig, and ``carry``) of every row; set_id is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, bands, sigs = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                s = shingle_set(text.as_py())
                sizes.append(len(s))
                least = minima(s) if len(s) else None
                sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(None if least is None else band_keys(least))
                sigs.append(None if least is None else signature(least))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64())), *batch.columns[2:]],
                names=["id", "n_shingles", "set_id", "bands", "sig", *carry])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *carry)
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"id long, n_shingles long, set_id binary, bands array<long>, sig array<long>{kinds}")


def _may_link(percent: int) -> Column:
    """Sizes and signatures of sides x and y allow a link."""
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    different = sum((F.bit_count(F.col(f"x.sig")[i].bitwiseXOR(F.col("y.sig")[i])) for i in range(SIGNATURE_BITS // 64)), F.lit(0))
    return (100 * small >= percent * large) & (different <= MAX_DIFFERENT)


def _own_shingles(texts: DataFrame, ranges: int) -> DataFrame:
    """(rep, own): shingles of each text that are in no other text. Sorted
    blocks of hashes are cut by range; a range decides about its hashes. A
    batch sends each shingle once, without an owner if several of its texts have it, so a
    very common one comes to its range once for each batch."""
    width = (1 << 64) // ranges + 1

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            hashes = np.concatenate([*sets, np.empty(0, np.uint64)])
            owners = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
            hashes, first, times = np.unique(hashes, return_index=True, return_counts=True)
            owners = np.where(times == 1, owners[first], NO_OWNER)
            cuts = np.searchsorted(hashes, np.array([i * width for i in range(1, ranges)], np.uint64))
            parts = [(i, x) for i, x in enumerate(np.split(np.arange(len(hashes)), cuts)) if len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in parts], pa.int32()), pa.array([hashes[x].tobytes() for _, x in parts], pa.binary()), pa.array([owners[x].tobytes() for _, x in parts], pa.binary())],
                names=["part", "hashes", "owners"])

    def once(frame: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in frame.hashes])
        owners = np.concatenate([np.frombuffer(x, np.int64) for x in frame.owners])
        _, first, n = np.unique(hashes, return_index=True, return_counts=True)
        alone = owners[first[n == 1]]
        rep, own = np.unique(alone[alone != NO_OWNER], return_counts=True)
        return pd.DataFrame({"rep": rep, "own": own})

    return (texts.mapInArrow(blocks, "part int, hashes binary, owners binary").groupBy("part").applyInPandas(once, "rep long, own long")
            .groupBy("rep").agg(F.sum("own").alias("own")))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets are similar enough. Sorted by u, so that its set is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())):
                a = a.as_py()
                if a != last:
                    last, own = a, shingle_set(a)
                keep.append(jaccard_at_least(own, shingle_set(b.as_py()), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["u", "v"])

    u, v = texts.select(F.col("id").alias("u"), F.col("text").alias("u_text")), texts.select(F.col("id").alias("v"), F.col("text").alias("v_text"))
    return pairs.join(v, "v").join(u, "u").select("u", "v", "u_text", "v_text").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_shingles, component_id, kept, and the columns to ``carry``) of
    every row of ``docs``. The bands and the screen are set for links of
    ``PERCENT`` and more; a smaller ``percent`` is refused, as they would lose links."""
    if percent < PERCENT:
        raise ValueError(f"percent is at least {PERCENT}")
    spark = docs.sparkSession
    signs = written(signed(docs, id_col, text_col, carry), "neardup-signs")
    classes = written(
        signs.where("set_id is not null and id is not null").groupBy("set_id").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")),
        "neardup-classes")
    about = classes.select("rep", "n", "sig", "bands")
    banded = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    several = written(banded.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first != last").select("bucket", "first"), "neardup-several")
    buckets = written(banded.join(several, "bucket").select("band", "bucket", "rep", "first"), "neardup-buckets")
    met = buckets.select("rep").distinct()
    texts = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").join(met, F.col("id") == F.col("rep"), "left_semi"), "neardup-texts")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """Confirmed pairs among (u, v)."""
        x = about.select(F.col("rep").alias("u"), F.struct("n", "sig").alias("x"))
        y = about.select(F.col("rep").alias("v"), F.struct("n", "sig").alias("y"))
        screened = written(pairs.distinct().join(x, "u").join(y, "v").where(_may_link(percent)).select("u", "v"), f"{name}-pairs")
        with arrow_rows(spark, PAIR_ROWS):
            return written(_confirmed(screened, texts, percent), name)

    def apart(components: DataFrame) -> DataFrame:
        """Rows of the buckets that still hold more than one component."""
        of = buckets.select("band", "bucket", "rep").join(components.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        of = written(of, "neardup-placed")
        mixed = written(of.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket"), "neardup-mixed")
        return of.join(mixed, "bucket").select("band", "bucket", "rep", "component")

    # round 1: every member and the smallest of its bucket
    found = links(buckets.where("rep != first").select(F.col("first").alias("u"), F.col("rep").alias("v")), "neardup-first")
    # round 2: members still apart, and the member with most links
    rest = written(apart(connected_components(found)), "neardup-apart")
    degree = found.select(F.col("u").alias("rep")).unionByName(found.select(F.col("v").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    ranked = rest.join(degree, "rep", "left").select("bucket", "rep", "component", F.struct(F.coalesce("links", F.lit(0)).alias("links"), (-F.col("rep")).alias("rep"), "component").alias("by"))
    ranked = written(ranked, "neardup-ranked")
    most_linked = written(ranked.groupBy("bucket").agg(F.max("by").alias("best")), "neardup-best")
    best = ranked.join(most_linked, "bucket").where("component != best.component")
    found = written(found.unionByName(links(best.select((-F.col("best.rep")).alias("u"), F.col("rep").alias("v")), "neardup-second")), "neardup-links")
    # round 3: all pairs of a bucket whose members are in different components
    rest = written(apart(connected_components(found)), "neardup-apart")
    last_texts = texts.join(rest.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "text")
    n_bytes = last_texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    own = written(_own_shingles(last_texts, max(1, n_bytes // RANGE_BYTES)), "neardup-own")
    rest = rest.join(about, "rep").join(own, "rep", "left").select("bucket", "component", F.struct("rep", "n", "sig", F.slice("bands", F.lit(1), F.col("band")).alias("before"), (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared")).alias("x"))
    rest = written(rest, "neardup-apart")
    most = F.least("x.shared", "y.shared")
    pairs = rest.alias("l").join(rest.withColumnRenamed("x", "y").alias("r"), (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.component") != F.col("r.component")) & (F.col("x.rep") < F.col("y.rep"))
                                 & (100 * most >= percent * (F.col("x.n") + F.col("y.n") - most)) & _may_link(percent)
                                 & ~F.arrays_overlap("x.before", "y.before"))
    pairs = written(pairs.select(F.col("x.rep").alias("u"), F.col("y.rep").alias("v")).distinct(), "neardup-third-pairs")
    with arrow_rows(spark, PAIR_ROWS):
        third = written(_confirmed(pairs, texts, percent), "neardup-third")
    component = connected_components(found.unionByName(third))

    of_class = written(classes.select("set_id", "rep").join(component.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component_id")), "neardup-of-class")
    out = signs.select("id", "n_shingles", "set_id", *carry).join(of_class, "set_id", "left")
    out = out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"), *carry)
    out = out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)
    return out.select(id_col, "n_shingles", "component_id", "kept", *carry)
