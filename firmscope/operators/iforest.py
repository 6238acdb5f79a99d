"""Isolation forest (R4–R6; Liu, Ting & Zhou 2008) grown and scored on Spark,
with nothing left to a random generator: any engine can grow the same trees.

* sample: rows whose portable hash falls in a range that holds about
  trees x psi rows (all rows of a small table) are the pool; each tree takes
  the psi = min(256, n) of them with the least universal hash of its own.
* grow: level by level for all trees, one job a level. A node's count and the
  least and greatest value of every feature are window aggregates over (tree, node);
  the feature (among those that vary) and the place of the cut between its
  ends come from a portable hash of (tree, node). Nodes are numbered as in a
  heap: 2 i and 2 i + 1 lie below i. At most trees x psi rows take part,
  whatever the input's size.
* score: a pandas function walks every tree for an Arrow batch of rows at
  once against the broadcast node table (at most trees x (2 psi - 1) rows). Path
  lengths are whole numbers, so their sums do not depend on their order.
  s = 2^(-E[h] / c(psi)); decision = -s - P(-s, contamination); label -1 when < 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmscope.functions.portable import hash52, unit
from firmscope.operators.lloyd import HALF, PRIME, stream
from firmscope.operators.stats import quantiles
from firmscope.session import Scratch, cut_lineage

#: Steps of a path length to one node.
STEPS = 1 << 32

EULER_GAMMA = 0.5772156649015329

def avg_path_length(n):
    """c(n): average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def sample_trees(df: DataFrame, id_col: str, trees: int, psi: int, seed: int, n: int) -> DataFrame:
    """(tree, columns of ``df``) with psi rows per tree. The pool is picked by
    a hash of the id, whatever the table's size or layout, and only its rows are
    copied for the trees."""
    h = hash52(F.col(id_col), F.lit(seed))
    pool = df.withColumn("_h", h).filter(F.col("_h") < int(min(1.0, trees * psi / max(n, 1)) * 2**52))
    dealt = F.inline(F.array(*[F.struct(F.lit(t).alias("tree"), *[F.lit(c).alias(name) for c, name in zip(stream(seed, "tree", t), ("_x", "_y", "_z"))]) for t in range(trees)]))
    own = F.pmod(F.col("_x") * F.shiftright("_h", HALF) + F.col("_y") * F.col("_h").bitwiseAND((1 << HALF) - 1) + F.col("_z"), F.lit(PRIME))
    keyed = pool.select("*", dealt).withColumn("_own", own)
    w = Window.partitionBy("tree").orderBy("_own", "_h")
    # row_number <= psi is limited per map task before the shuffle
    return keyed.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= psi).select("tree", *df.columns)


def max_depth(psi: int) -> int:
    return int(math.ceil(math.log2(max(psi, 2))))


def iforest_fit(df: DataFrame, id_col: str, features: list, trees: int = 100, psi: int = 256, seed: int = 42) -> DataFrame:
    """Grow the forest; returns the node table (tree, node, feature, cut,
    size, depth, psi), feature -1 in leaves: trees x (2 psi - 1) rows at most."""
    n = df.count()
    psi = min(psi, n)
    x = F.array(*[F.col(c).cast("double") for c in features])
    sample = sample_trees(df.select(F.col(id_col), x.alias("x")), id_col, trees, psi, seed, n)
    rows = sample.select("tree", "x", F.lit(1).alias("node"), F.array().cast("array<struct<node:int,feature:int,cut:double,size:bigint>>").alias("path"))
    by = Window.partitionBy("tree", "node")
    with Scratch(df.sparkSession) as scratch:
        # a written table for each level: one task would hold the memory of all levels' sorts at once
        rows = scratch.write(rows, "forest-level")
        for _ in range(max_depth(psi)):
            ends = F.array(*[F.struct(F.lit(j).alias("j"), F.min(F.get("x", F.lit(j))).over(by).alias("lo"), F.max(F.get("x", F.lit(j))).over(by).alias("hi")) for j in range(len(features))])
            rows = rows.select("tree", "x", "node", "path", F.count(F.lit(1)).over(by).alias("size"), F.filter(ends, lambda e: e["hi"] > e["lo"]).alias("varies"))
            which = F.pmod(hash52(F.col("tree"), F.col("node"), F.lit(seed)), F.size("varies").cast("long")).cast("int")
            rows = rows.withColumn("f", F.when(F.size("varies") > 0, F.get("varies", which)))
            cut = F.col("f.lo") + unit(F.col("node"), F.col("tree"), F.lit(seed)) * (F.col("f.hi") - F.col("f.lo"))
            rows = rows.withColumn("cut", cut)
            split = F.col("f").isNotNull()
            rows = scratch.write(rows.select(
                "tree", "x", F.when(split, 2 * F.col("node") + (F.get("x", F.col("f.j")) >= F.col("cut")).cast("int")).otherwise(F.col("node")).alias("node"),
                F.when(split, F.concat("path", F.array(F.struct("node", F.col("f.j").alias("feature"), "cut", "size")))).otherwise(F.col("path")).alias("path")), "forest-level")
            scratch.clear(keep=1)
        inner = rows.select("tree", F.inline("path")).distinct()
        leaves = rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size")).select("tree", "node", F.lit(-1).alias("feature"), F.lit(0.0).alias("cut"), "size")
        nodes = inner.unionByName(leaves)
        return cut_lineage(nodes.withColumns({"depth": F.floor(F.log2("node")).cast("int"), "psi": F.lit(psi)}), "forest")


def leaf_steps(depth, size) -> np.ndarray:
    """Path length of a leaf: its depth and the expected rest, in ``STEPS``."""
    return np.rint((np.asarray(depth, "float64") + avg_path_length(size)) * STEPS).astype("int64")


def _walked(t: pd.DataFrame, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, path length) by place of a tree whose every walk takes
    ``levels`` steps: below a leaf, whatever way is taken, lies its path length."""
    places = 2 << levels
    feat, cut, leaf = np.zeros(places, dtype="int64"), np.zeros(places), np.full(places, True)
    # a place without sampled rows is a leaf of size 0
    length = leaf_steps(np.floor(np.log2(np.maximum(np.arange(places), 1))), np.zeros(places))
    at, inner = t["node"].to_numpy(), t["feature"].to_numpy() >= 0
    feat[at[inner]], cut[at[inner]] = t["feature"].to_numpy()[inner], t["cut"].to_numpy()[inner]
    length[at] = leaf_steps(t["depth"].to_numpy(), t["size"].to_numpy())
    leaf[at[inner]] = False
    for p in range(2, places):  # from the root down
        if leaf[p // 2]:
            length[p], leaf[p] = length[p // 2], True
    return feat, cut, length


def iforest_score(df: DataFrame, nodes_pdf: pd.DataFrame, features: list, out_col: str = "iforest_s") -> DataFrame:
    """Anomaly score s in (0, 1] per row (higher = more isolated)."""
    psi = int(nodes_pdf["psi"].iloc[0])
    norm = float(avg_path_length([psi])[0]) or 1.0
    levels = max_depth(psi)
    trees = [_walked(t, levels) for _, t in nodes_pdf.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        forest = shared.value
        for columns in batches:
            x = np.concatenate([c.to_numpy(dtype="float64") for c in columns])
            rows = len(x) // len(columns)
            place, total = np.arange(rows), np.zeros(rows, dtype="int64")
            for feat, cut, length in forest:
                at = np.ones(rows, dtype="int64")
                for _ in range(levels):
                    # the values of feature j begin at j x rows
                    right = x.take(feat.take(at) * rows + place) >= cut.take(at)
                    at += at
                    at += right
                total += length.take(at)
            yield pd.Series(np.power(2.0, -(total / STEPS / len(forest)) / norm))

    # only the features go through Python
    return df.withColumn(out_col, score(*[F.col(c).cast("double") for c in features]))


def anomaly_threshold(scored: DataFrame, contamination: float = 0.05, col: str = "iforest_s") -> float:
    """The contamination-quantile of -s (exact, linearly interpolated)."""
    q = quantiles(scored.select((-F.col(col)).alias("_neg")), ["_neg"], (), contamination, ["t"]).first()
    return float(q["t"])


def anomaly_columns(scored: DataFrame, threshold: float, col: str = "iforest_s") -> DataFrame:
    decision = -F.col(col) - F.lit(threshold)
    return scored.withColumns(
        {
            "anomaly_score": decision,
            "is_anomaly": decision < 0,
            "anomaly_label": F.when(decision < 0, F.lit("Anomaly")).otherwise(F.lit("Normal")),
        }
    )
