"""Quality classifier: Naive Bayes support vectors.

A text is the set of its token unigrams and bigrams (words, digit runs and
runs of marks; hashed; all bigrams of a token with itself are one indicator).
Each indicator is scaled by the log ratio of its smoothed counts in the two
classes, rows are divided by their damped length (so that a text of few
indicators stays near the intercept), and a linear hinge-loss model is fitted
by dual coordinate descent. Margins become
probabilities by a logistic curve fitted on labelled rows kept apart from the
fit.

The fit uses at most about ``rows`` labelled rows (a documented bound; rows
are picked by a hash of their id, and the indicators of a very long one by a
hash from the whole of it), so the sample and the weights do not grow
with the corpus. Scoring reads every whole text.

Rows: a null or empty text has no indicators and gets the score of the
intercept. Null labels teach nothing; without labels of both classes every
score is the share of good labels (0.5 if there are none). Very long texts
are turned into tokens a piece at a time. Ties: sampled rows of one hash are in the
order of what they hold. Repeated rows: one output row each. Empty tables give
an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Labelled rows of a fit, about.
FIT_ROWS = 8000
#: Hashed indicators.
BITS = 18
#: Indicators of a fit row at most; a longer text teaches by those of the smallest hashes. With FIT_ROWS this bounds what the driver holds.
ROW_INDICATORS = 8192
#: Every so many fit rows, one is kept for the logistic curve.
CALIBRATION_EVERY = 4
#: Characters turned into tokens at a time.
PIECE = 1 << 20

#: Added to a row's squared length.
DAMPING = 20.0

_SALT = np.uint64(0x9E3779B97F4A7C15)


def indicators(text: str | None) -> np.ndarray:
    """Distinct hashed unigrams and bigrams, sorted."""
    if not text:
        return np.empty(0, np.int64)
    found, before = [], np.empty(0, np.uint64)
    for m in range(0, len(text), PIECE):  # a token cut at a border counts as two
        tokens = TOKENS.findall(text, m, m + PIECE)
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
        chain = np.concatenate([before, own])
        found.append(_slots(own))
        found.append(_slots(np.where(chain[:-1] == chain[1:], _SALT, chain[:-1] * _SALT + chain[1:])))
        before = chain[-1:]
    return np.unique(np.concatenate(found))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _SALT) >> np.uint64(64 - BITS)).astype(np.int64)


def teaching(slots: np.ndarray) -> np.ndarray:
    """All indicators, or ``ROW_INDICATORS`` of them from the whole of a very long text."""
    if len(slots) <= ROW_INDICATORS:
        return slots
    order = slots.astype(np.uint64) * _SALT
    return np.sort(slots[np.argpartition(order ^ (order >> np.uint64(29)), ROW_INDICATORS)[:ROW_INDICATORS]])


@dataclass(frozen=True)
class Model:
    """score = logistic(slope * margin + shift); margin = weights over the scaled row + intercept."""

    ratios: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        return self.intercept + float(scaled(self.ratios[slots]) @ self.weights[slots])

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(indicators(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def scaled(row: np.ndarray) -> np.ndarray:
    return row / np.sqrt(row @ row + DAMPING)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = []
    for wanted in (1, 0):
        own = [r for r, y in zip(rows, labels) if y == wanted]
        n = np.full(1 << BITS, alpha)
        for at in range(0, len(own), 256):
            n += np.bincount(np.concatenate(own[at : at + 256]).astype(np.int64, copy=False), minlength=1 << BITS)
        counts.append(np.log(n / n.sum()))  # of indicators, over all of the class
    return counts[0] - counts[1]


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: np.ndarray, epochs: int = 30, tolerance: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept of min |w|^2 / 2 + sum(cost * max(0, 1 - y f(x))),
    one dual variable at a time in a random order."""
    w, b = np.zeros(1 << BITS), 0.0
    y = np.where(labels == 1, 1.0, -1.0)
    dual = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values])  # + 1: the intercept's constant input
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + b) - 1.0
            new = min(max(dual[i] - gradient / norms[i], 0.0), cost[i])
            step = (new - dual[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                b += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < tolerance:
            break
    return w, b


def logistic_curve(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton's method, with smoothed targets."""
    good, bad = float((labels == 1).sum()), float((labels == 0).sum())
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * at * [1, 0])
        at = at - change
        if np.abs(change).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0) -> Model:
    labels = np.asarray(labels, np.int64)
    none = np.zeros(1 << BITS)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(none, none, 0.0, 0.0, float(np.log(share / (1 - share))))
    apart = np.arange(len(rows)) % CALIBRATION_EVERY == CALIBRATION_EVERY - 1
    if len(set(labels[apart].tolist())) < 2 or len(set(labels[~apart].tolist())) < 2:
        apart[:] = False
    use = np.flatnonzero(~apart)
    ratios = log_count_ratios([rows[i] for i in use], labels[use])
    # one block for all rows: thousands of small ones would stay in the driver's memory after the fit
    ends = np.cumsum([0, *(len(rows[i]) for i in use)])
    block = np.empty(ends[-1])
    values = [block[i:j] for i, j in zip(ends[:-1], ends[1:])]
    for i, v in zip(use, values):
        v[:] = scaled(ratios[rows[i]])
    y = labels[use]
    # both classes weigh the same in total
    cost = c * len(y) / 2 / np.where(y == 1, (y == 1).sum(), (y == 0).sum())
    w, b = dual_coordinate_descent([rows[i] for i in use], values, y, cost)
    plain = Model(ratios, w, b, 1.0, 0.0)
    curve = np.flatnonzero(apart) if apart.any() else use
    slope, shift = logistic_curve(np.array([plain.margin(rows[i]) for i in curve]), labels[curve])
    return Model(ratios, w, b, slope, shift)


def settled(at: np.ndarray, labels: np.ndarray, rows: list[np.ndarray]) -> list[int]:
    """Places of the rows in an order that does not depend on how tasks ended:
    by hash and label; rows that share both are sorted by what they hold."""
    order = np.lexsort((labels, at)).tolist()
    again = lambda i: (at[i], labels[i])
    return [i for _, same in groupby(order, again) for i in sorted(same, key=lambda i: rows[i].tobytes())]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled rows of ``docs``; the caller leaves out what is to be held out."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label"))
    n = known.count()
    # the hash picks ids before texts are read, and orders what was picked
    known = known.withColumn("at", F.xxhash64("key")).where(F.pmod("at", F.lit(1 << 20)) < float(1 << 20) * rows / max(n, 1))
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    picked = texts.join(known, "key").select("at", "label", "text")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [teaching(indicators(t.as_py())).astype(np.int32) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.int32()))], names=["at", "label", "slots"])

    sample = picked.mapInArrow(reduce, "at long, label int, slots array<int>").toArrow().combine_chunks()
    slots = sample.column("slots").combine_chunks()
    values, ends = slots.values.to_numpy(), slots.offsets.to_numpy()
    label = sample.column("label").to_numpy()
    order = settled(sample.column("at").to_numpy(), label, [values[i:j] for i, j in zip(ends[:-1], ends[1:])])
    model = fit_rows([values[ends[i] : ends[i + 1]] for i in order], label[order])
    del sample, slots, values, ends, label
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", column: str = "score") -> DataFrame:
    """(id, score) of every row."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["key", "score"])

    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).withColumnsRenamed({"key": id_col, "score": column})


def accepted(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows scored at least ``least``, all columns; each text goes to Python once."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) >= least for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
