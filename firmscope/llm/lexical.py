"""Ranked lexical search by dual trees: the best documents of every query item
under an integer weighting of shared terms.

Items are dealt into blocks of a bounded number of terms. For a block the
documents are read once: their counts of the block's terms are written, and
from these come the corpus statistics. Then every task builds a hierarchy over
its documents and one over the items. A node holds the coordinate maxima below
it: the greatest impact of each term in its documents, or the weight of each
term of its items. The product of two nodes bounds every score between them;
where it is below the weakest k-th score of the items, the pair is dropped with
all it holds. Pairs of leaves are scored exactly, best bounds first, so the
k-th scores rise early. Equal bounds are kept, since an equal score may win by
its id, and the result is exact. Tasks begin with the k-th scores found in a
small hash sample of the documents, which can only be too low.

Scores are exact: sums of products of integers, in doubles while they fit
2^53 and in 64-bit integers for items of more terms.

Rows: a null text, or one without terms, is no document. A null doc_id counts
in the statistics and ranks behind all ids of its score. Rows that repeat a
doc_id are documents of their own. Items with a null id or without terms have
no result; rows that repeat an item id are one item with the terms of all. Equal scores: ascending
doc_id. Very long texts are counted one at a time in a task. Empty tables give
an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm.shared import written

#: Terms of the items of a block, about: what a task and the driver hold of the items.
BLOCK_TERMS = 100_000
#: Documents and items of a leaf; children of a node.
LEAF_DOCS, LEAF_ITEMS, FAN = 4, 1, 4
#: Bytes of the leaves' maxima of one document tree; sets its number of documents.
TREE_BYTES = 64 << 20
#: One document in so many gives the opening bounds.
OPENING = 64
#: Terms of an item up to which doubles are exact: each adds less than 3.5e10.
DOUBLE_TERMS = 250_000

_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all beyond ASCII; A-Z lower-cased."""
    return text.translate(_BYTES).split()


# ---------------------------------------------------------------- one task
class Queries:
    """Items of a block: numbers and weights of their terms, and the hierarchy over them."""

    def __init__(self, items: list[list[int]], weights: np.ndarray):
        self.weights = weights
        self.own = [np.array(sorted(t), np.int64) for t in items]
        self.dtype = np.int64 if max(map(len, items), default=0) > DOUBLE_TERMS else np.float64
        # neighbours share their heaviest terms
        heaviest = [sorted(t, key=lambda x: (-weights[x], x))[:4] for t in items]
        order = sorted(range(len(items)), key=lambda i: heaviest[i])
        level = [order[i : i + LEAF_ITEMS] for i in range(0, len(order), LEAF_ITEMS)]
        nodes = [(own, ()) for own in level]
        while len(nodes) > 1:
            groups = [nodes[i : i + FAN] for i in range(0, len(nodes), FAN)]
            nodes = [([i for own, _ in g for i in own], tuple(g)) for g in groups]
        self.root = self._node(*nodes[0]) if nodes else None

    def _node(self, own: list[int], below: tuple) -> tuple:
        columns = np.unique(np.concatenate([self.own[i] for i in own]))
        table = None
        if not below:
            table = np.zeros((len(columns), len(own)), self.dtype)
            for j, i in enumerate(own):
                table[np.searchsorted(columns, self.own[i]), j] = self.weights[self.own[i]]
        return np.array(own), columns, self.weights[columns].astype(self.dtype), table, [self._node(*b) for b in below]


class Best:
    """The k best documents of each item so far."""

    def __init__(self, k: int, opening: np.ndarray):
        self.k, self.least = k, np.maximum(opening, 1)
        none = np.empty(0, np.int64)
        self.top = [(none, none, none) for _ in opening]  # score, 1 for a null id, id

    def add(self, item: int, scores: np.ndarray, unnamed: np.ndarray, ids: np.ndarray) -> None:
        s, u, i = (np.concatenate(x) for x in zip(self.top[item], (scores, unnamed, ids)))
        at = np.lexsort((i, u, -s))[: self.k]
        self.top[item] = (s[at], u[at], i[at])
        if len(at) == self.k:
            self.least[item] = max(self.least[item], s[at[-1]])


class Documents:
    """A hierarchy over some documents, given as rows of (term, impact) and a
    size of each. Neighbours are of a size, as impacts fall with it."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, impacts: np.ndarray, sizes: np.ndarray, width: int):
        n = len(starts) - 1
        lengths = np.diff(starts)
        row = np.repeat(np.arange(n), lengths)
        order = np.argsort(sizes, kind="stable")
        self.order = order
        self.starts, self.lengths, self.columns, self.impacts = starts[:-1][order], lengths[order], columns, impacts
        leaf = np.empty(n, np.int64)
        leaf[order] = np.arange(n) // LEAF_DOCS
        maxima = np.zeros((-(-n // LEAF_DOCS), width), np.int32)
        np.maximum.at(maxima, (leaf[row], columns), impacts.astype(np.int32))
        self.levels = [maxima]
        while len(maxima) > 1:
            maxima = np.maximum.reduceat(maxima, np.arange(0, len(maxima), FAN), axis=0)
            self.levels.append(maxima)

    def rows_of(self, leaves: np.ndarray) -> np.ndarray:
        at = (leaves[:, None] * LEAF_DOCS + np.arange(LEAF_DOCS)).ravel()
        return at[at < len(self.order)]

    def dense(self, rows: np.ndarray, place: np.ndarray, width: int, dtype: type) -> np.ndarray:
        """Impacts of some rows in the columns that ``place`` numbers."""
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - ends + lengths, lengths)
        column = place[self.columns[at]]
        known = column >= 0
        out = np.zeros((len(rows), width), dtype)
        out[np.repeat(np.arange(len(rows)), lengths)[known], column[known]] = self.impacts[at[known]]
        return out


def search_trees(queries: Queries, docs: Documents, best: Best, unnamed: np.ndarray, ids: np.ndarray) -> int:
    """Bring ``best`` up to date with these documents; the number of documents scored for an item."""
    scored = 0
    place = np.full(len(queries.weights), -1)

    def children(level: int, nodes: np.ndarray) -> np.ndarray:
        below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return below[below < len(docs.levels[level - 1])]

    def descend(node: tuple, level: int, nodes: np.ndarray) -> None:
        nonlocal scored
        own, columns, weights, table, below = node
        bounds = docs.levels[level][np.ix_(nodes, columns)].astype(queries.dtype) @ weights
        near = bounds >= best.least[own].min()
        nodes, bounds = nodes[near], bounds[near]
        if not len(nodes):
            return
        if below or level:
            deeper, at = (level - 1, children(level, nodes)) if level else (0, nodes)
            for b in below or [node]:
                descend(b, deeper, at)
            return
        place[columns] = np.arange(len(columns))
        nodes = nodes[np.argsort(-bounds, kind="stable")]
        bounds = -np.sort(-bounds)
        at, step = 0, 4
        while at < len(nodes) and bounds[at] >= best.least[own].min():
            rows = docs.rows_of(nodes[at : at + step])
            scores = (docs.dense(rows, place, len(columns), queries.dtype) @ table).astype(np.int64)
            scored += scores.size
            for j, item in enumerate(own):
                good = np.flatnonzero(scores[:, j] >= best.least[item])
                if len(good):
                    which = docs.order[rows[good]]
                    best.add(item, scores[good, j], unnamed[which], ids[which])
            at, step = at + step, step * 2
        place[columns] = -1

    if queries.root is not None and len(docs.order):
        descend(queries.root, len(docs.levels) - 1, np.array([0]))
    return scored


# ---------------------------------------------------------------- the whole
def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term), each once."""
    rows = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(set(terms(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.binary()))], names=["item", "terms"])

    schema = T.StructType([rows.schema["item"], T.StructField("terms", T.ArrayType(T.BinaryType()))])
    return rows.mapInArrow(run, schema).select("item", F.explode("terms").alias("term")).distinct()


def term_counts(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts) of every document with a term: all its terms
    counted, and the counts of the vocabulary's, by number."""
    numbers = {t: i for i, t in enumerate(vocabulary)}
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, found, counts = [], [], [], []
            for i, t in enumerate(batch.column(1)):
                own = Counter(terms(t.as_py()))
                if own:
                    known = sorted((numbers[w], own[w]) for w in own.keys() & numbers.keys())
                    kept.append(i)
                    n.append(own.total())
                    found.append([a for a, _ in known])
                    counts.append([b for _, b in known])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int32())), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["id", "n", "terms", "counts"])

    return rows.mapInArrow(run, "id long, n long, terms array<int>, counts array<long>")


def found_by_task(counted: DataFrame, items: list[list[int]], weights: list[int], documents: int, length: int, k: int, opening: list[int]) -> DataFrame:
    """(item number, id, score): the k best documents of each item among those of a task."""
    tree_rows = max(16 * LEAF_DOCS, TREE_BYTES // (4 * max(len(weights), 1)) * LEAF_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.array(weights, np.int64)
        queries, best = Queries(items, weight), Best(k, np.array(opening, np.int64))
        for batch in batches:
            for at in range(0, batch.num_rows, tree_rows):
                part = batch.slice(at, tree_rows)
                found, counts = part.column(2), part.column(3)
                starts = np.array(found.offsets, np.int64)
                starts -= starts[0]
                columns, tf = np.array(found.flatten(), np.int64), np.array(counts.flatten(), np.int64)
                # whole numbers of any size, as n * documents may pass 64 bits
                m = np.array([10 + 90 * n * documents // length for n in part.column(1).to_pylist()], np.int64)
                impacts = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(starts)))
                ids = part.column(0)
                unnamed = np.array(ids.is_null(), np.int64)
                search_trees(queries, Documents(starts, columns, impacts, m, len(weight)), best, unnamed, np.array(ids.fill_null(0), np.int64))
        for i, (scores, unnamed, ids) in enumerate(best.top):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i), pa.int32()), pa.array(ids, pa.int64(), mask=unnamed.astype(bool)), pa.array(scores, pa.int64())], names=["number", "id", "score"])

    return counted.mapInArrow(run, "number int, id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, id, score): the k best documents of each item, score above 0."""
    spark = docs.sparkSession
    pairs = written(item_terms(items, item_col, item_text_col), "lexical-items")
    blocks = max(1, -(-pairs.count() // block_terms))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    schema = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("item", pairs.schema["item"].dataType)])
    out = None
    for block in range(blocks):  # each holds about ``block_terms`` terms
        held = pairs.where(F.col("block") == block).select("item", "term").toArrow().to_pydict()
        vocabulary = sorted(set(map(bytes, held["term"])))
        numbers = {t: i for i, t in enumerate(vocabulary)}
        names = sorted(set(held["item"]))
        place = {x: i for i, x in enumerate(names)}
        own: list[list[int]] = [[] for _ in names]
        for item, term in zip(held["item"], held["term"]):
            own[place[item]].append(numbers[bytes(term)])
        counted = written(term_counts(docs, vocabulary, id_col, text_col), "lexical-counts")
        documents, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = {r.term: r.n for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
        weights = [term_weight(documents, holding.get(i, 0)) for i in range(len(vocabulary))]
        opening = [0] * len(names)
        some = counted.where(F.pmod(F.xxhash64("id"), F.lit(OPENING)) == 0)
        for r in ranked(found_by_task(some, own, weights, documents, max(length, 1), k, opening), k).where(F.col("rank") == k).collect():
            opening[r.number] = r.score
        found = ranked(found_by_task(counted, own, weights, documents, max(length, 1), k, opening), k)
        part = found.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), schema)), "number").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = part if out is None else out.unionByName(part)
    return out
