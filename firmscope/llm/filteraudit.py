"""Filter interaction audit: what each filter removes in every order of the
filters, by difference arrays over Lehmer ranks.

A document fails a set of filters, its mask. In an order of the filters it is
removed at the step of the first one it fails. The orders that share their
first letters are consecutive in lexicographic order, so the orders in which a
mask is removed at one step are a few intervals of ranks. Counts of a mask are
added where an interval begins and taken off where it ends; a running sum over
the ranks gives the removals of every order. Documents are read once; what is
carried on is a row of some fifty bytes for each, then at most 32 rows a part.

The filters: A under 200 words; B fewer than half of the words distinct; C
over 3 % of the code points in A-Z; D one of ``#$%&*|``; E the text of a
document of smaller id.

Rows: a null text is an empty one (A fails, and E if an empty text has a
smaller id); a null part is the part ''. A null doc_id is smaller than none
and has none smaller, so E never fails there, and it has no labels. Rows that
repeat a doc_id are counted each; equal ids are not smaller, so ties in E fail
neither. Several labels of a document: any 1 counts. Very long texts are split
into words one at a time in a task. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm.shared import written

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
_SIGNS = re.compile(rb"[#$%&*|]")
_CAPITALS = string.ascii_uppercase.encode()
_CONTINUES = bytes(range(0x80, 0xC0))


def own_failures(text: bytes) -> int:
    """Bits of A to D, which a text fails by itself."""
    words = text.split()  # of bytes: at \x20 and \x09-\x0D
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUES))
    return (len(words) < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1 | (100 * capitals > CAPITAL_PERCENT * points) << 2 | (_SIGNS.search(text) is not None) << 3


def facts(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(key, part, mask, digest, n): documents that agree in all of these."""
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for t in batch.column(2):
                text = t.as_py()
                masks.append(own_failures(text))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["key", "part", "mask", "digest"])

    schema = T.StructType([rows.schema["key"], rows.schema["part"], T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    return rows.mapInArrow(run, schema).groupBy("key", "part", "mask", "digest").agg(F.count("*").alias("n"))


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each set of failed filters."""
    rows = written(facts(docs, id_col, text_col, part_col), "filter-facts")
    named = rows.where("key is not null")
    # partial sums first, so that a group of copies is one row of a task; the lookup is keyed by the document as well
    first = named.groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    copy = F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    masks = named.join(first, ["digest", "key"], "left").withColumn("mask", F.col("mask") + copy).groupBy("key", "part", "mask").agg(F.sum("n").alias("n"))
    label = labels.select(F.col(id_col).alias("key"), F.col("quality").eqNullSafe(1).cast("long").alias("good"), F.col("toxic").eqNullSafe(1).cast("long").alias("toxic"))
    label = label.where("key is not null").groupBy("key").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    marked = masks.join(label, "key", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    unnamed = rows.where("key is null").select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    every = marked.unionByName(unnamed)
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def lehmer_rank(order: tuple[int, ...]) -> int:
    """Place of a permutation of 0..n-1 in lexicographic order."""
    n = len(order)
    return sum(sum(later < x for later in order[i + 1 :]) * factorial(n - 1 - i) for i, x in enumerate(order))


def intervals(n: int = len(FILTERS)) -> list[tuple[int, int, int, int]]:
    """(mask, step, begin, end): ranks of the orders in which a mask is
    removed at a step; they begin with step - 1 filters it passes and one it fails."""
    out = []
    for step in range(1, n + 1):
        for head in permutations(range(n), step):
            begin = lehmer_rank(head + tuple(x for x in range(n) if x not in head))
            end = begin + factorial(n - step)
            passed = sum(1 << x for x in head[:-1])
            out += [(mask, step, begin, end) for mask in range(1 << n) if mask >> head[-1] & 1 and not mask & passed]
    return out


def audit(masks: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley) for every part, order and step of the
    counts that ``failures`` gives."""
    spark, n = masks.sparkSession, len(FILTERS)
    masks = written(masks, "filter-masks")
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    counts = ["n", "good", "toxic"]
    spans = F.broadcast(spark.createDataFrame(intervals(), "mask int, step int, begin int, end int"))  # fixed by the number of filters
    held = masks.join(spans, "mask")
    ends = F.explode(F.array(F.struct(F.col("begin").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign"))))
    changes = held.select("part", "step", *counts, ends.alias("e")).select("part", "step", "e.rank", *[(F.col(c) * F.col("e.sign")).alias(c) for c in counts])
    totals = masks.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)) for i in range(n)]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(n)]).alias("alone"))
    every = totals.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in counts])
    at = changes.where(F.col("rank") < factorial(n)).unionByName(every).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in counts])
    so_far = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    removed = at.select("part", "step", "rank", *[F.sum(c).over(so_far).alias(c) for c in counts])
    order = F.element_at(orders, F.col("rank") + 1)
    steps = removed.select("part", "step", order.alias("filter_order"), *counts).withColumn("letter", F.substr("filter_order", F.col("step"), F.lit(1)))
    earlier = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = steps.withColumn("gone", F.sum("n").over(earlier)).withColumn("shapley", F.sum("n").over(Window.partitionBy("part", "letter"))).join(totals, "part")
    place = F.instr(F.lit(FILTERS), F.col("letter"))
    return whole.select(
        "part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), F.col("n").alias("removed"), (F.element_at("fails", place) - F.col("n")).alias("redundant"),
        F.element_at("alone", place).alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
