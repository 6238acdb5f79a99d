"""Benchmark decontamination: a prefix-filtered set join, in DataFrame
functions alone.

Every window of an item (13 words in a row; a shorter item is one window) is a
set of three-word shingles that a document must hold in full. One necessary
shingle is enough to find it, so each window is joined by its rarest one,
counted over all documents; windows with a shingle that no document has drop
out. A candidate's place in the document follows from the shingle's place in
the window; it must not begin before the document or end behind it. Candidates
are verified word by word with shingles that cover the whole window.

Documents are read once for shingles (only those of the benchmark are kept)
and once for word counts; texts are not shuffled. The benchmark's shingle
hashes are broadcast while there are at most ``BROADCAST_ROWS`` of them
(8 bytes each); with more, the join is shuffled.

Rows: a null text has no words; such documents, and those without words, hit
nothing. Items without words, or with a null id, have no windows; repeated
items count once. Rows that repeat a doc_id and text get the same result, rows
with another text their own; a null doc_id is treated like any other. Ties among the
rarest shingles go to the first in the window. Very long texts are read as a whole; a
row is made for each of their known shingles alone. Empty
tables: no documents give an empty result, no items give no hits. Extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmscope.llm.shared import ascii_lower, written

WINDOW = 13
SHINGLE = 3
BROADCAST_ROWS = 1_000_000
#: What is no part of a word, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
SEPARATORS_OF_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of words; empty for null."""
    plain = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def word_count(text: Column) -> Column:
    """Number of words, without making them: the blanks that separate them, and one."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS_OF_ANY_CASE, " "))
    return F.when(plain == "", 0).otherwise(F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def item_windows(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item, window, w): each window's words, and its text as a key."""
    w = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    first = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (size - 1)))
    w = w.select("item", "all", F.explode(first).alias("at")).select("item", F.slice("all", F.col("at"), F.lit(size)).alias("w"))
    return w.select("item", F.array_join("w", " ").alias("window"), "w").distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, n, q, offset, shingle, cover): the shingles of q words of each
    distinct window of n words; ``cover`` marks some that together hold every word."""
    one = windows.select("window", "w").distinct().select("window", "w", F.size("w").alias("n"), F.least(F.lit(SHINGLE), F.size("w")).alias("q"))
    at = one.select("window", "w", "n", "q", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("q"))).alias("offset"))
    return at.select("window", "n", "q", "offset", F.array_join(F.slice("w", F.col("offset") + 1, F.col("q")), " ").alias("shingle"),
                     ((F.col("offset") % F.col("q") == 0) | (F.col("offset") == F.col("n") - F.col("q"))).alias("cover"))


def shingle_hits(docs: DataFrame, known: DataFrame, q: int, small: bool) -> DataFrame:
    """(doc, text_hash, n_words, place, shingle) where a document has a known shingle of q words."""
    tail = [F.slice("w", F.lit(i + 1), F.col("n_words")).alias(f"w{i}") for i in range(1, q)]
    at = docs.select("doc", "text_hash", "w", F.size("w").alias("n_words")).where(F.col("n_words") >= q).select("doc", "text_hash", "n_words", F.posexplode(F.arrays_zip(F.col("w").alias("w0"), *tail)).alias("place", "s"))
    at = at.select("doc", "text_hash", "n_words", "place", *[F.col(f"s.w{i}").alias(f"w{i}") for i in range(q)]).withColumn("h", F.xxhash64(*[f"w{i}" for i in range(q)]))
    hashes = known.select(F.xxhash64(*[F.split("shingle", " ")[i] for i in range(q)]).alias("h")).distinct()
    kept = at.join(F.broadcast(hashes) if small else hashes, "h", "left_semi")
    # equal hashes are not yet equal words
    return kept.select("doc", "text_hash", "n_words", "place", F.concat_ws(" ", *[f"w{i}" for i in range(q)]).alias("shingle")).join(known.select("shingle"), "shingle", "left_semi")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) of every row; ``items``
    are the ids, as strings in order, of items with a window in the text."""
    windows = written(item_windows(items, item_col, item_text_col, size), "decontaminate-windows")
    shingles = written(window_shingles(windows), "decontaminate-shingles")
    text = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("w"))
    known = shingles.select("q", "shingle").distinct()
    counts = {r.q: r.n for r in known.groupBy("q").agg(F.count("*").alias("n")).collect()}  # three rows at most
    hits = None
    for q, n in sorted(counts.items()):
        part = shingle_hits(text, known.where(F.col("q") == q), q, n <= BROADCAST_ROWS)
        hits = part if hits is None else hits.unionByName(part)
    n_words = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), word_count(F.col(text_col)).alias("n_words"))
    if hits is None:
        out = n_words.select("doc", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"))
    else:
        found = occurrences(written(hits, "decontaminate-hits"), shingles)
        result = _per_document(found.join(windows.select("window", "item"), "window"))
        d, r = n_words.alias("d"), result.alias("r")
        same = F.col("d.doc").eqNullSafe(F.col("r.doc")) & (F.col("d.text_hash") == F.col("r.text_hash"))
        out = d.join(r, same, "left").select(
            "d.doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).alias("n"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        out = out.select("doc", "n_words", "n_hit", F.greatest("n", F.lit(0)).cast("long").alias("n_items"), "items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).withColumnRenamed("doc", id_col)


def occurrences(hits: DataFrame, shingles: DataFrame) -> DataFrame:
    """(doc, text_hash, begin, n, window): verified places of whole windows."""
    often = hits.groupBy("shingle").agg(F.count("*").alias("often"))
    counted = written(shingles.join(often, "shingle", "left").select("window", "n", "offset", "shingle", "cover", F.coalesce("often", F.lit(0)).alias("often")), "decontaminate-counted")
    # the prefix: the rarest shingle; a window with an absent one occurs nowhere
    prefix = counted.groupBy("window", "n").agg(F.min(F.struct("often", "offset", "shingle")).alias("rarest")).where("rarest.often > 0")
    prefix = written(prefix.select("window", "n", "rarest.offset", "rarest.shingle"), "decontaminate-prefix")
    candidates = hits.join(prefix, "shingle").withColumn("begin", F.col("place") - F.col("offset")).where((F.col("begin") >= 0) & (F.col("begin") + F.col("n") <= F.col("n_words")))
    candidates = written(candidates.select("doc", "text_hash", "begin", "n", "window").distinct(), "decontaminate-candidates")
    cover = counted.where("cover").select("window", "offset", "shingle")
    size = cover.groupBy("window").agg(F.count("*").alias("needed"))
    wanted = candidates.join(cover, "window").select("doc", "text_hash", "begin", "n", "window", (F.col("begin") + F.col("offset")).alias("place"), "shingle")
    w, h = wanted.alias("w"), hits.select("doc", "text_hash", "place", "shingle").distinct().alias("h")
    same = F.col("w.doc").eqNullSafe(F.col("h.doc")) & (F.col("w.text_hash") == F.col("h.text_hash")) & (F.col("w.place") == F.col("h.place")) & (F.col("w.shingle") == F.col("h.shingle"))
    have = w.join(h, same, "left_semi").groupBy("doc", "text_hash", "begin", "n", "window").agg(F.count("*").alias("have"))
    return have.join(size, "window").where("have = needed").select("doc", "text_hash", "begin", "n", "window")


def _per_document(found: DataFrame) -> DataFrame:
    """(doc, text_hash, n_hit, items): words in the union of the places, and the items."""
    places = found.groupBy("doc", "text_hash", "begin").agg(F.max(F.col("begin") + F.col("n")).alias("end"), F.collect_set("item").alias("items"))
    before = Window.partitionBy("doc", "text_hash").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    new = places.withColumn("so_far", F.max("end").over(before)).withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce("so_far", F.col("begin")))))
    return new.groupBy("doc", "text_hash").agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
