"""Exact top-k search by inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks by a hash of their id. A block keeps one
sorted list per dimension; a query reads the lists from their better end (the
largest values where its component is positive, the smallest where it is
negative) some steps at a time, scores each vector it meets in full, and stops
when the bound made of the last values read cannot beat the k-th score found.
Block winners are merged by rank. Queries are dealt into blocks as well, so
neither side is ever held whole by one task.

Rows: vectors that are null, or hold a null or non-finite component, take no
part; neither do rows without id. Vectors of different lengths count as padded
with zeros. A repeated id is one vector (the smallest of its vectors, if they
differ). Empty tables give an empty result. Extra columns are not read.
Components are taken to fit a long after scaling.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate and of a query block; blocks grow in number, not in size.
CANDIDATE_ROWS, QUERY_ROWS = 8192, 1024
#: Steps down the lists between two looks at the bound.
FIRST_STEP = 64


def integer_vector(c: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(c, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(c: Column) -> Column:
    """Not null, every component finite."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True))


def threshold_top(block: np.ndarray, ids: np.ndarray, order: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of the k best rows of a block for one query (ties
    to the smaller id), and how many rows were scored. ``order`` sorts each
    column of ``block`` ascending."""
    n = len(ids)
    dims = np.flatnonzero(query)
    falling = query[dims] > 0
    seen = np.zeros(n, bool)
    seen[ids == own] = True
    top_at, top = np.empty(0, np.int64), np.empty(0, np.int64)
    depth, step, scored = 0, FIRST_STEP, 0
    while True:
        end = min(depth + step, n)
        if len(dims):
            ahead = order[depth:end][:, dims[~falling]]
            behind = order[n - end : n - depth][:, dims[falling]]
            met = np.zeros(n, bool)
            met[ahead.ravel()] = True
            met[behind.ravel()] = True
            new = np.flatnonzero(met & ~seen)
        else:  # every score is 0
            end, new = n, np.flatnonzero(~seen)
        seen[new] = True
        scored += len(new)
        top_at, top = np.concatenate([top_at, new]), np.concatenate([top, block[new] @ query])
        best = np.lexsort((ids[top_at], -top))[:k]
        top_at, top = top_at[best], top[best]
        if end >= n:
            return top_at, top, scored
        last = np.where(falling, block[order[n - end, dims], dims], block[order[end - 1, dims], dims])
        # a vector not met yet scores at most the bound; an equal score may still win by its id
        if len(top) == k and int(last @ query[dims]) < top[-1]:
            return top_at, top, scored
        depth, step = end, step * 2


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, <id>, score): the k best candidates of every query but itself."""

    def rows(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        return (df.where(usable(v) & F.col(id_col).isNotNull())
                .select(F.col(id_col).cast("long").alias("id"), integer_vector(v, scale).alias("v"))
                .groupBy("id").agg(F.min("v").alias("v")))

    # ids are counted before the vectors are read; both counts only set the number of blocks
    blocks = max(1, -(-candidates.select(id_col).count() // CANDIDATE_ROWS))
    parts = max(1, -(-queries.select(id_col).count() // QUERY_ROWS))
    c = rows(candidates).select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    q = rows(queries).select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "id": [], "score": []}
        if len(left) and len(right):
            width = max(left.v.map(len).max(), right.v.map(len).max())
            block, ids = _matrix(left.v, width), left.id.to_numpy()
            order = np.argsort(block, axis=0, kind="stable")
            for own, query in zip(right.id.to_numpy(), _matrix(right.v, width)):
                at, scores, _ = threshold_top(block, ids, order, query, own, k)
                out["query_id"].append(np.full(len(at), own))
                out["id"].append(ids[at])
                out["score"].append(scores)
        return pd.DataFrame({n: np.concatenate(x) if x else np.empty(0, np.int64) for n, x in out.items()})

    found = (c.groupBy("block", "part").cogroup(q.groupBy("block", "part"))
             .applyInPandas(search, "query_id long, id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
