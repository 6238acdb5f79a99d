"""Gradient-boosted trees for several classes.

Every round grows one tree for each class on the gradient of the softmax loss,
all trees and all targets on the same histograms: a level of a round is one
scan of the binned table, which adds up gradients and curvatures by (class,
node, feature, bin) in its tasks. Features are bytes (``BINS`` bins cut at quantiles of a
bounded sample), margins are kept with the rows and brought up to date every
``REFRESH`` rounds, so a scan walks few trees. Gradients are added up as whole
numbers, so the trees do not depend on file layout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmscope.functions.portable import hash52
from firmscope.session import Scratch

BINS = 64
#: Rows whose values set the bin edges, about.
EDGE_ROWS = 20_000
#: Rounds between two writes of the margins.
REFRESH = 10
#: Whole-number steps of a gradient.
STEPS = 1 << 24
#: Added to the curvature of a leaf.
SMOOTHING = 1.0


@dataclass
class Tree:
    """Nodes as in a heap from 1: a feature and the last bin that goes left; values of the leaves."""
    feature: np.ndarray
    last: np.ndarray
    value: np.ndarray


@dataclass
class Boosted:
    features: list
    edges: list  # per feature, the upper ends of all bins but the last
    targets: dict  # name -> its classes in order
    trees: list = field(default_factory=list)  # rounds x classes of all targets
    rate: float = 0.1

    def slots(self) -> list[slice]:
        ends = np.cumsum([len(c) for c in self.targets.values()])
        return [slice(int(b - len(c)), int(b)) for b, c in zip(ends, self.targets.values())]


def walk(tree: Tree, bins: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after some levels."""
    at = np.ones(len(bins), np.int64)
    for node in range(1, 1 << levels):  # a node's children come after it
        if tree.feature[node] >= 0:
            right = bins[:, tree.feature[node]] > tree.last[node]
            at = np.where(at == node, 2 * node + right, at)
    return at


def softmax(margins: np.ndarray, slots: list[slice]) -> np.ndarray:
    out = np.empty_like(margins)
    for s in slots:
        e = np.exp(margins[:, s] - margins[:, s].max(axis=1, keepdims=True))
        out[:, s] = e / e.sum(axis=1, keepdims=True)
    return out


def best_split(g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
    """(feature, last bin that goes left) of the greatest gain over features x
    bins; feature -1 if none is above 0. Ties: the first feature and bin."""
    score = lambda a, b: a * a / (b + SMOOTHING)
    left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    all_g, all_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    gain = score(left_g, left_h) + score(all_g - left_g, all_h - left_h) - score(all_g, all_h)
    gain[(left_h <= 0) | (all_h - left_h <= 0)] = 0.0
    at = int(np.argmax(gain))
    return (at // gain.shape[1], at % gain.shape[1]) if gain.flat[at] > 1e-9 else (-1, 0)


def _margins(model: Boosted, trees: list, bins: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    out = start.copy()
    for round_trees in trees:
        for k, tree in enumerate(round_trees):
            out[:, k] += model.rate * tree.value[walk(tree, bins, depth)]
    return out


def _columns(batch: pa.RecordBatch, width: int, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    # a column's bins lie together: trees and histograms read them by column
    bins = np.asfortranarray(np.array(batch.column(0).flatten(), np.int64).reshape(n, width))
    return bins, np.array(batch.column(1).flatten(), np.int64).reshape(n, -1), np.array(batch.column(2).flatten(), np.float64).reshape(n, slots)


def _histograms(state: DataFrame, model: Boosted, pending: list, growing: list, depth: int, level: int) -> np.ndarray:
    """Gradients and curvatures: 2 x classes x nodes of the level x features x bins, in one scan."""
    slots, k, width = model.slots(), sum(len(c) for c in model.targets.values()), len(model.features)
    shape = (k, 1 << level, width, BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((2, *shape), np.int64)
        for batch in batches:
            bins, label, start = _columns(batch, width, k)
            p = softmax(_margins(model, pending, bins, start, depth), slots)
            wanted = np.zeros_like(p)
            for t, s in enumerate(slots):
                wanted[np.arange(len(p)), s.start + label[:, t]] = 1.0
            for c in range(k):
                # a node that was not split has no rows below it
                node = walk(growing[c], bins, level) - (1 << level)
                rows = np.flatnonzero(node >= 0)
                for part, v in enumerate((p[:, c] - wanted[:, c], p[:, c] * (1 - p[:, c]))):
                    whole = np.rint(v[rows] * STEPS)
                    for f in range(width):
                        cell = node[rows] * BINS + bins[rows, f]
                        kept[part, c, :, f, :] += np.bincount(cell, whole, (1 << level) * BINS).astype(np.int64).reshape(1 << level, BINS)
        cells = np.flatnonzero(kept[0].ravel() | kept[1].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(kept[0].ravel()[cells]), pa.array(kept[1].ravel()[cells])], names=["cell", "g", "h"])

    sums = state.select("bins", "label", "margin").mapInArrow(run, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    out = np.zeros((2, int(np.prod(shape))))
    at = sums.column("cell").to_numpy()
    out[0, at], out[1, at] = sums.column("g").to_numpy() / STEPS, sums.column("h").to_numpy() / STEPS
    return out.reshape(2, *shape)


def edges_of(df: DataFrame, id_col: str, features: list, rows: int = EDGE_ROWS) -> list[np.ndarray]:
    """Upper ends of all bins but the last: quantiles of a sample picked by a hash of the id."""
    n = df.count()
    some = df.filter(hash52(F.col(id_col), F.lit(7)) < int(min(1.0, rows / max(n, 1)) * 2**52)).select(*features).toArrow()
    out = []
    for f in features:
        v = np.array([x for x in some.column(f).to_pylist() if x is not None], np.float64)
        out.append(np.unique(np.quantile(v, np.arange(1, BINS) / BINS)) if len(v) else np.empty(0))
    return out


def binned(df: DataFrame, model: Boosted):
    """Array of the features' bins: how many edges lie below the value; nulls in bin 0."""
    def one(f: str, edges: np.ndarray):
        ends = F.array(*[F.lit(float(e)) for e in edges]) if len(edges) else F.array().cast("array<double>")
        return F.coalesce(F.size(F.filter(ends, lambda e: e < F.col(f).cast("double"))), F.lit(0))

    return F.array(*[one(f, e) for f, e in zip(model.features, model.edges)])


def labels_of(model: Boosted):
    """Array of the number of each target's class."""
    return F.array(*[F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(t)).cast("int") - 1 for t, classes in model.targets.items()])


def fit(df: DataFrame, id_col: str, features: list, targets: dict, rounds: int = 100, depth: int = 3, rate: float = 0.1) -> Boosted:
    """Boosted trees for every target (column -> its classes) of ``df``:
    ``rounds`` x ``depth`` scans for all of them together."""
    model = Boosted(list(features), edges_of(df, id_col, features), dict(targets), rate=rate)
    with Scratch(df.sparkSession) as scratch:
        _grow(df, model, rounds, depth, scratch)
    return model


def _grow(df: DataFrame, model: Boosted, rounds: int, depth: int, scratch: Scratch) -> None:
    k = sum(len(c) for c in model.targets.values())
    state = scratch.write(df.select(binned(df, model).alias("bins"), labels_of(model).alias("label"), F.array_repeat(F.lit(0.0), k).alias("margin")), "boosting")
    pending: list = []
    for _ in range(rounds):
        growing = [Tree(np.full(2 << depth, -1), np.zeros(2 << depth, np.int64), np.zeros(2 << depth)) for _ in range(k)]
        for level in range(depth):
            g, h = _histograms(state, model, pending, growing, depth, level)
            for c, tree in enumerate(growing):
                for node in range(1 << level):
                    own_g, own_h = g[c, node], h[c, node]
                    if not own_h.any():
                        continue
                    heap = (1 << level) + node
                    # the value of a node is that of its leaf until it is split
                    tree.value[heap] = -own_g[0].sum() / (own_h[0].sum() + SMOOTHING)
                    f, last = best_split(own_g, own_h)
                    if f >= 0:
                        tree.feature[heap], tree.last[heap] = f, last
                        for side, part in ((0, slice(0, last + 1)), (1, slice(last + 1, None))):
                            tree.value[2 * heap + side] = -own_g[f, part].sum() / (own_h[f, part].sum() + SMOOTHING)
        model.trees.append(growing)
        pending.append(growing)
        if len(pending) == REFRESH:
            state, pending = scratch.write(_moved(state, model, pending, depth), "boosting"), []
            scratch.clear(keep=1)


def _moved(state: DataFrame, model: Boosted, trees: list, depth: int) -> DataFrame:
    k, width = sum(len(c) for c in model.targets.values()), len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, _, start = _columns(batch, width, k)
            out = _margins(model, trees, bins, start, depth)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(out), pa.list_(pa.float64()))], names=["bins", "label", "margin"])

    return state.select("bins", "label", "margin").mapInArrow(run, "bins array<int>, label array<int>, margin array<double>")


def accuracy(df: DataFrame, model: Boosted) -> dict:
    """Share of rows whose most likely class is theirs, for each target, in one scan."""
    slots, k, width = model.slots(), sum(len(c) for c in model.targets.values()), len(model.features)
    depth = int(np.log2(len(model.trees[0][0].feature))) - 1 if model.trees else 0
    rows = df.select(binned(df, model).alias("bins"), labels_of(model).alias("label"), F.array_repeat(F.lit(0.0), k).alias("margin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, right = 0, np.zeros(len(slots), np.int64)
        for batch in batches:
            bins, label, start = _columns(batch, width, k)
            m = _margins(model, model.trees, bins, start, depth)
            n += len(bins)
            right += [int((m[:, s].argmax(axis=1) == label[:, t]).sum()) for t, s in enumerate(slots)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(slots)), pa.int32()), pa.array(right), pa.array([n] * len(slots), pa.int64())], names=["t", "r", "n"])

    found = rows.mapInArrow(run, "t int, r long, n long").groupBy("t").agg((F.sum("r") / F.sum("n")).alias("a")).collect()
    return {list(model.targets)[r["t"]]: r["a"] for r in found}
