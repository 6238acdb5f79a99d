"""Personal data: candidate spans judged by gradient-boosted trees, in
DataFrame functions alone.

Spans of the fixed formats (email, ip, card, phone) always count. Two
high-recall generators propose further, overlapping spans: addresses written
with "at" and "dot", and runs of digit groups. Boosted trees look at a span's
format (digits, groups, separators, Luhn, lengths) and context (neighbouring
characters, cue words before it). They are fitted on all documents, whose
proposals are counted by features and label first, so the rounds of boosting
read weighted different ones.
Positives are the fixed spans of the documents, rewritten in place into forms that
the fixed formats miss (addresses with "at" and "dot", phones without plus,
other separators); negatives are the other proposals there, and ordinary
numbers (runs, dates, sums, ranges) and mentions with "@" that are put into the
same texts. Proposals that overlap a fixed format neither teach nor count. The
threshold of each generator is calibrated on a fold of the documents that the
trees have not seen: the lowest score from which ``PRECISION`` of what is
selected is positive.

The trees become one expression, so texts are scanned in one pass without a
shuffle, after the pass that learns.

Rows: a null or empty text has no spans. Very long texts, also those full of
spans, take time that grows with their length. Ties: spans are in the order of their
kinds, then places. Repeated rows: one output row each. Empty tables: an empty result. Documents without fixed spans, or with proposals
of one class only, select nothing beyond the fixed formats. Extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope.llm.shared import written
from firmscope.llm.spans import before_each, between_marks, free_of, joined, let, matches, most, piece, record, rewritten, text_blocks, without_marks

KINDS = ["email", "ip", "card", "phone", "email_like", "number_like"]
# fixed values: formats. Possessive, and from the start of a run or the end of
# the last match: the same matches as without, in time that grows with the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# generators
EMAIL_LIKE = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\((?i:at)\)|\[(?i:at)\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\((?i:dot)\)|\[(?i:dot)\])\x20?[A-Za-z0-9-]++)++"
NUMBER_LIKE = r"[+(]?[0-9](?:[\x20().\-/]{0,3}[0-9]){6,39}+"
GENERATORS = {"email_like": EMAIL_LIKE, "number_like": NUMBER_LIKE}
CUES = r"(?i)(?:phone|call|tel|fax|mobile|mail|contact|card|visa|account|address|server|host|ssn)"
#: Code points of context on each side.
CONTEXT = 24
#: Rewritten copies of a text that has fixed spans.
COPIES = 4
PRECISION = 0.95
TREES, DEPTH, FOLDS = 12, 3, 4
FEATURES = ["length", "digits", "groups", "spaces", "dots", "hyphens", "brackets", "luhn", "first_group", "last_group", "letters", "cue", "letter_before", "letter_after", "email_like"]


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Of 2 to 19 digits."""
    doubled = F.transform(F.reverse(F.split(digits, "")), lambda d, i: let(d.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def _of_kind(spans: Column, kind: str, keep) -> Column:
    return F.transform(F.filter(spans, keep), lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"], s["end"]))


def fixed_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> by kind, then start."""
    def card(s: Column) -> Column:
        return let(digits_of(s["value"]), lambda d: F.when(F.length(d).between(13, 19), passes_luhn(d)).otherwise(False))

    return F.concat(
        _of_kind(matches(text, EMAIL), "email", lambda s: F.lit(True)),
        _of_kind(matches(text, IP), "ip", lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")).cast("int"), F.lit(0)) <= 255))),
        _of_kind(matches(text, CARD), "card", card),
        _of_kind(matches(text, PHONE), "phone", lambda s: F.length(digits_of(s["value"])).between(9, 15)))


def proposals(text: Column, taken: Column) -> Column:
    """array<struct<kind, start, end, features>> of what the generators
    propose beside the spans that are ``taken``."""
    def with_features(kind: str, blocks: Column):
        def one(s: Column) -> Column:
            v = s["value"]
            before = piece(blocks, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"])
            after = piece(blocks, s["end"], s["end"] + 1)
            return let(digits_of(v), lambda d: let(F.split(v, "[^0-9]+"), lambda g: record(
                kind=F.lit(KINDS.index(kind)), start=s["start"], end=s["end"],
                x=F.transform(F.array(*_features(v, d, g, before, after, kind)), lambda x: x.cast("double")))))
        return one

    def judged(kind: str, pattern: str) -> Column:
        free = free_of(matches(text, pattern), taken)
        return let(free, lambda f: F.when(F.size(f) > 0, let(text_blocks(text), lambda blocks: F.transform(f, with_features(kind, blocks)))).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,x:array<double>>>")))

    return F.concat(*[judged(k, p) for k, p in GENERATORS.items()])


def _features(v: Column, d: Column, groups: Column, before: Column, after: Column, kind: str) -> list[Column]:
    count = lambda chars: F.length(v) - F.length(F.regexp_replace(v, chars, ""))
    yes = lambda c: F.when(c, 1).otherwise(0)
    full = F.filter(groups, lambda g: g != "")
    return [
        F.length(v), F.length(d), F.size(full), count(r"\x20"), count(r"\."), count("-"), count(r"[()\[\]]"),
        F.when(F.length(d).between(13, 19), yes(passes_luhn(d))).otherwise(0), F.coalesce(F.length(F.get(full, F.lit(0))), F.lit(0)), F.coalesce(F.length(F.get(full, F.size(full) - 1)), F.lit(0)),
        count("[A-Za-z]"), yes(before.rlike(CUES)), yes(F.right(before, F.lit(1)).rlike("[A-Za-z0-9]")), yes(after.rlike("[A-Za-z0-9]")), F.lit(int(kind == "email_like")),
    ]


@dataclass(frozen=True)
class Model:
    """Boosted trees as nested (feature, threshold, left, right) or a leaf's value, their weights, and a threshold for each generator."""

    trees: list
    weights: list[float]
    thresholds: dict[str, float]


def read_tree(text: str):
    """A tree out of its printed form."""
    lines = [line.strip() for line in text.splitlines()[1:] if line.strip()]

    def node(i: int):
        if lines[i].startswith("Predict:"):
            return float(lines[i].split(":")[1]), i + 1
        feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[i]).groups()
        left, i = node(i + 1)
        right, i = node(i + 1)  # behind the "Else" line
        return (int(feature), float(threshold), left, right), i

    return node(0)[0]


def _value(tree, x: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, left, right = tree
    return F.when(F.get(x, F.lit(feature)) <= threshold, _value(left, x)).otherwise(_value(right, x))


def probability(model: Model, x: Column) -> Column:
    margin = sum((F.lit(w) * _value(t, x) for t, w in zip(model.trees, model.weights)), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * margin))


def _one_of(choices: list[Column], seed: Column) -> Column:
    at = F.pmod(seed, F.lit(len(choices)))
    out = choices[0]
    for i, c in enumerate(choices[1:], 1):
        out = F.when(at == i, c).otherwise(out)
    return out


def hidden_form(kind: Column, value: Column, seed: Column) -> Column:
    """A fixed email, card or phone, written as no fixed format knows it."""
    # every second address in a plain shape: no digits, a host of two labels
    short = F.regexp_replace(F.substring_index(value, "@", 1), "[^A-Za-z]+", ""), F.regexp_replace(F.substring_index(F.substring_index(value, "@", -1), ".", -2), "[0-9]+", "")
    plain = (F.pmod(F.xxhash64(seed), F.lit(2)) == 0) & (short[0] != "") & short[1].rlike(r"^[A-Za-z-]+\.[A-Za-z-]+$")
    name, host = F.when(plain, short[0]).otherwise(F.substring_index(value, "@", 1)), F.when(plain, short[1]).otherwise(F.substring_index(value, "@", -1))
    email = _one_of([
        F.concat(name, F.lit(" (at) "), F.replace(host, F.lit("."), F.lit(" (dot) "))),
        F.concat(name, F.lit(" [at] "), F.replace(host, F.lit("."), F.lit(" [dot] "))),
        F.concat(name, F.lit("(at)"), F.replace(host, F.lit("."), F.lit("(dot)"))),
        F.concat(name, F.lit(" (at) "), host),
        F.concat(name, F.lit(" @ "), host),
    ], seed)
    digits = digits_of(value)
    local = F.right(digits, F.lit(10))
    parts = [F.substring(local, 1, 3), F.substring(local, 4, 3), F.substring(local, 7, 4)]
    phone = _one_of([
        F.substring(value, 2, 1 << 30),
        F.concat(F.lit("("), parts[0], F.lit(") "), parts[1], F.lit("-"), parts[2]),
        *[F.concat_ws(sep, *parts) for sep in "-./ "],
    ], seed)
    card = _one_of([F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{sep}") for sep in (".", "/", " - ", "--")], seed)
    return F.when(kind == KINDS.index("email"), email).when(kind == KINDS.index("phone"), phone).otherwise(card)


def ordinary_number(seed: Column) -> Column:
    """A number that is no personal data: a run of digits, a date, a sum or a range."""
    d = F.lpad(F.pmod(F.xxhash64(seed), F.lit(10**16)).cast("string"), 16, "0")
    at = lambda i, n: F.substring(d, i, n)
    two = lambda i, most: F.lpad((F.pmod(at(i, 4).cast("int"), F.lit(most)) + 1).cast("string"), 2, "0")
    year, month, day = F.concat(F.lit("20"), at(1, 2)), two(3, 12), two(7, 28)
    return _one_of([
        F.substring(d, F.lit(1), F.pmod(at(13, 4).cast("int"), F.lit(10)) + 7),
        F.concat_ws("-", year, month, day), F.concat_ws(".", day, month, year), F.concat_ws("/", day, month, year), F.concat(year, month, day),
        F.concat_ws(".", at(1, 1), at(2, 3), at(5, 3)), F.concat_ws(".", at(1, 5), at(6, 6)), F.concat_ws("-", at(1, 4), at(5, 4)),
    ], seed)


def labelled_proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fold, kind, x, label) of the proposals of all documents that overlap no
    fixed format; 1 for those that overlap a rewritten span."""
    at = F.xxhash64(id_col)
    every = docs.select(F.pmod(F.xxhash64(at), F.lit(FOLDS)).alias("fold"), at.alias("at"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = every.withColumn("given", fixed_spans(F.col("text")))
    spans = F.filter("given", lambda s: s["kind"] != KINDS.index("ip"))
    # of overlapping ones the first
    spans = let(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))), lambda a: let(
        before_each(F.transform(a, lambda s: s["end"]), most), lambda reach: F.filter(a, lambda s, i: s["start"] >= F.get(reach, i))))
    copies = every.withColumn("found", spans).withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.size("found") > 0, COPIES - 1).otherwise(0))))
    seed = F.xxhash64("at", "copy")
    plain = rewritten(F.col("text"), F.col("found"), lambda s, v: hidden_form(s["kind"], v, F.xxhash64(F.col("at"), s["start"]) + F.col("copy")))
    # after the first three words in a row; never inside a rewritten span, which marks set off
    mixed = F.regexp_replace(F.col("plain"), F.lit(r"(?s)\A(.*?[A-Za-z]) ([A-Za-z]+) ([A-Za-z]+)(.*)\z"), F.concat(_one_of([F.lit("$1 @ $2. $3 "), F.concat(F.lit("$1 @ "), F.format_string("%d.%02d", F.pmod(seed, F.lit(89)), F.pmod(seed, F.lit(97))), F.lit(" $2 $3 "))], F.xxhash64(seed)), ordinary_number(seed), F.lit(" $4")))
    copies = copies.withColumn("plain", plain).select("fold", F.when(F.size("found") == 0, F.col("given")).alias("given"), F.when(F.size("found") > 0, mixed).otherwise(F.col("plain")).alias("marked"))
    copies = copies.select("fold", "given", without_marks(F.col("marked")).alias("text"), between_marks(F.col("marked")).alias("hidden"))
    both = copies.select("fold", "hidden", "text", F.coalesce("given", fixed_spans(F.col("text"))).alias("base"))
    both = both.select("fold", "hidden", proposals(F.col("text"), F.col("base")).alias("all"))
    missed = F.concat(*[F.transform(free_of(F.filter("all", lambda s: s["kind"] == KINDS.index(k)), F.col("hidden")), lambda s: F.struct(s["kind"], s["start"])) for k in GENERATORS])  # noqa: B023
    rows = both.select("fold", missed.alias("missed"), F.explode("all").alias("s"))
    return rows.select("fold", "s.kind", "s.x", (~F.array_contains("missed", F.struct("s.kind", "s.start"))).cast("double").alias("label"))


def fit(labelled: DataFrame, precision: float = PRECISION) -> Model | None:
    """None unless both labels are in the folds the trees see."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    # equal proposals are one row of their number; written, so that the rounds of boosting do not carry the expressions that made them
    counted = labelled.groupBy("fold", "kind", "x", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = written(counted, "pii-proposals").withColumn("features", array_to_vector("x"))
    seen = rows.where("fold != 0").agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    model = None
    if min(seen) > 0:
        fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=11, cacheNodeIds=False, weightCol="n").fit(rows.where("fold != 0"))
        model = Model([read_tree(t.toDebugString) for t in fitted.trees], list(fitted.treeWeights), {})
        # positives and all from each hundredth of the score up; at most 101 rows a generator
        score = F.floor(probability(model, F.col("x")) * 100).cast("int")
        counts = rows.where("fold = 0").groupBy("kind", score.alias("score")).agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good")).collect()
        for kind in GENERATORS:
            good = n = 0.0
            for r in sorted((r for r in counts if KINDS[r.kind] == kind), key=lambda r: -r.score):
                good, n = good + r.good, n + r.n
                if good >= precision * n:
                    model.thresholds[kind] = r.score / 100
    return model


def scan(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end), by kind, then start;
    ``spans`` are all, selected proposals where they overlap no fixed format."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("key"), text.alias("text"), fixed_spans(text).alias("base"))
    if not (model and model.thresholds):
        return found.select(F.col("key").alias(id_col), "base", F.col("base").alias("spans"))
    found = found.select("key", "base", proposals(F.col("text"), F.col("base")).alias("all"))

    def selected(s: Column) -> Column:
        at = F.lit(None).cast("double")
        for kind, t in model.thresholds.items():
            at = F.when(s["kind"] == KINDS.index(kind), t).otherwise(at)
        return probability(model, s["x"]) >= at

    more = F.transform(F.filter("all", selected), lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return found.select(F.col("key").alias(id_col), "base", F.concat("base", more).alias("spans"))


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_<kind> of the fixed formats, base_sha256, spans)."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return scanned.select(id_col, *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))
