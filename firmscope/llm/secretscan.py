"""Secret scan: fixed formats, and character Markov models, in DataFrame
functions alone.

Two first-order models over printable ASCII, of random strings and of ordinary
identifiers, are counted on a labelled sample of tokens. Long tokens of a text
whose log-likelihood ratio (random to ordinary) is at least ``MIN_TOTAL`` and
``MIN_MEAN`` for each step are reported beside the fixed formats, also where that holds of a
long part of them between separators. The models are one table of 128 x 128
numbers, whatever the corpus.

Rows: a null or empty text has no spans. Very long texts, also those full of
spans, take time that grows with their length. Ties: spans that begin at one
place are in the order of their kinds. Repeated rows: one output row each.
Empty tables: an empty result; an empty sample: no random tokens are reported.
Extra columns are not read by ``scan``; ``redacted`` keeps all columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope.llm.spans import free_of, joined, let, matches, redact

KINDS = ["assign", "access", "hex", "random"]
# fixed values: formats and least lengths
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the models look at.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
MIN_TOTAL, MIN_MEAN = 12.0, 0.4
#: Characters of a part between / _ and - that is judged by itself.
LEAST_PART = 20
#: Rows that give the labelled sample, about; and their pairs of words that become ordinary tokens, about.
SAMPLE_ROWS, SAMPLE_PAIRS = 2000, 200


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(token, label): 1 for random strings, made of digests of the sampled
    texts in the alphabets keys are written in; 0 for identifiers made of the
    texts' words in the usual ways. At most about ``rows`` rows, picked by a
    hash of the id, teach (a documented bound); of a text's pairs of
    neighbouring words about ``SAMPLE_PAIRS`` do, picked by a hash from the whole of it."""
    n = docs.count()
    picked = docs.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < float(1 << 20) * rows / max(n, 1)).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    raw = F.unhex(F.sha2("text", 256))
    plain = F.regexp_replace(F.base64(raw), "[=\r\n]", "")
    random = picked.select(F.explode(F.array(F.sha2("text", 256), plain, F.translate(plain, "+/", "-_"), F.upper(F.regexp_replace(plain, "[+/]", "")))).alias("token"), F.lit(1).alias("label"))
    words = F.filter(F.split(F.regexp_replace("text", r"[^A-Za-z]+", " "), " "), lambda w: w != "")
    pairs = picked.select(words.alias("w")).where(F.size("w") > 1).select(F.size("w").alias("n"), F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("at", "p"))
    pairs = pairs.where(F.col("p.b").isNotNull() & (F.pmod(F.xxhash64("at", "p.a", "p.b"), F.col("n").cast("long")) < SAMPLE_PAIRS)).select("p.*")
    lower_a, lower_b = F.lower("a"), F.lower("b")
    names = F.array(F.col("a"), F.concat("a", "b"), F.concat_ws("_", lower_a, lower_b), F.concat_ws("-", lower_a, lower_b), F.concat(lower_a, F.initcap("b")), F.concat_ws("/", lower_a, lower_b), F.upper(F.concat_ws("_", "a", "b")), F.concat(lower_a, F.pmod(F.xxhash64("a"), F.lit(100)).cast("string")))
    return random.unionByName(pairs.select(F.explode(names).alias("token"), F.lit(0).alias("label")))


def train(sample: DataFrame, smoothing: float = 0.5, alphabet: int = 66) -> list[float] | None:
    """Log-likelihood ratio of each step from character a to b, at 128 a + b;
    None without samples of both labels. The counts' table has at most 2 x
    128 x 128 rows."""
    chars = sample.select("label", F.filter(F.split("token", ""), lambda c: c != "").alias("c"))
    steps = chars.select("label", F.explode(F.arrays_zip(F.col("c").alias("a"), F.slice("c", F.lit(2), F.size("c")).alias("b"))).alias("s")).where("s.b is not null")
    counts = steps.select("label", F.ascii("s.a").alias("a"), F.ascii("s.b").alias("b")).where("a < 128 and b < 128").groupBy("label", "a", "b").agg(F.count("*").alias("n")).collect()
    if {r.label for r in counts} != {0, 1}:
        return None
    pair, single = {}, {}
    for r in counts:
        pair[r.label, r.a, r.b] = r.n
        single[r.label, r.a] = single.get((r.label, r.a), 0) + r.n

    def log_p(label: int, a: int, b: int) -> float:
        return math.log((pair.get((label, a, b), 0) + smoothing) / (single.get((label, a), 0) + smoothing * alphabet))

    return [log_p(1, a, b) - log_p(0, a, b) for a in range(128) for b in range(128)]


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """Sum over the steps of a token of ASCII characters."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    steps = let(F.transform(F.filter(F.split(token, ""), lambda c: c != ""), F.ascii), lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.get(table, a * 128 + b)))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def _kind(spans: Column, kind: str, keep) -> Column:
    return F.transform(F.filter(spans, keep), lambda s: F.struct(s["start"], F.lit(KINDS.index(kind)).alias("kind"), s["end"]))


def find(text: Column, ratios: list[float] | None) -> tuple[Column, Column]:
    """(spans of the fixed formats, spans the models add), each sorted by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    base = F.array_sort(F.concat(
        _kind(matches(text, ASSIGN), "assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_VALUE),
        _kind(matches(text, ACCESS), "access", lambda s: F.lit(True)),
        _kind(matches(text, HEX), "hex", lambda s: F.lit(True))))
    if ratios is None:
        return base, F.array().cast("array<struct<start:int,kind:int,end:int>>")
    def drawn(token: Column) -> Column:
        return let(log_ratio(token, ratios), lambda r: (r >= MIN_TOTAL) & (r >= MIN_MEAN * (F.length(token) - 1)))

    # a key joined to ordinary words by / _ or - is judged by itself as well
    def has_part(token: Column) -> Column:
        return F.exists(F.split(token, "[/_-]+"), lambda part: (F.length(part) >= LEAST_PART) & (F.length(part) < F.length(token)) & drawn(part))

    return base, _kind(matches(text, TOKEN), "random", lambda s: drawn(s["value"]) | has_part(s["value"]))


def scan(docs: DataFrame, ratios: list[float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (start, kind, end); ``spans`` are all, the
    models' own where they overlap no fixed format."""
    base, random = find(F.col(text_col), ratios)
    found = docs.select(F.col(id_col), base.alias("base"), random.alias("random"))
    return found.select(id_col, "base", F.array_sort(F.concat("base", free_of(F.col("random"), F.col("base")))).alias("spans"))


def redacted(docs: DataFrame, ratios: list[float] | None, text_col: str = "text", by: str = "[SECRET]") -> DataFrame:
    """All columns, with every reported span of the text replaced."""
    kept = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    out = scan(kept, ratios, id_col="row").withColumn("clean", redact(F.col(f"row.{text_col}"), F.col("spans"), by))
    return out.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"row.{c}") for c in docs.columns])


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_<kind> of the fixed formats, base_sha256, spans)."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return scanned.select(id_col, *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))
