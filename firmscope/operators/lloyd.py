"""k-means of many replicas at once.

A replica is one fit: a number of clusters, a start, and optionally a
bootstrap run that weighs the rows. All replicas advance together: each
iteration is one scan of a written table of points, which adds up weights and
coordinates by (replica, centre) in its tasks and brings one row for each to the
driver. So a best-of-10 fit, a sweep over k and a bootstrap cost as many scans
as their slowest replica has iterations.

Everything can be repeated by another engine. Coordinates are whole numbers
(``UNIT`` steps to a standard deviation), so sums do not depend on their order.
Starts (k-means++: the next centre with probability in proportion to the squared
distance) and Poisson weights come from universal hashes of a portable hash of
the row's id, never from a random generator or a row's place in a file.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmscope.functions.portable import hash52
from firmscope.session import Scratch, cut_lineage

#: Steps of a coordinate to one standard deviation.
UNIT = 1 << 16
#: Modulus of the universal hashes; a row has two halves of HALF bits.
PRIME, HALF = (1 << 31) - 1, 26
#: Fits end when all centres together have moved by less than this (squared, in standard deviations).
TOLERANCE = 1e-4
#: Distances held at once by a task.
CELLS = 2_000_000
#: Two squared distances nearer than this to each other, in squared lengths, are added up in full: hundreds of times the rounding of a product.
CLOSE = 1e-12


@dataclass(frozen=True)
class Replica:
    k: int
    start: int
    run: int | None = None  # bootstrap run; None: every row once


def stream(seed: int, *name) -> tuple[int, int, int]:
    """Coefficients of the universal hash of that name."""
    digest = hashlib.md5(":".join(map(str, (seed, *name))).encode()).digest()
    return tuple(int.from_bytes(digest[5 * i : 5 * i + 5], "big") % PRIME for i in range(3))


def poisson_steps() -> list[float]:
    """Cumulative probabilities of Poisson(1), as far as a double tells them from 1."""
    out, p = [math.exp(-1.0)], math.exp(-1.0)
    while out[-1] < 1.0 and out[-1] + p / len(out) > out[-1]:
        p /= len(out)
        out.append(out[-1] + p)
    return out


def points(df: DataFrame, id_col: str, cols: list, keep: tuple = (), seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """A written table (a, b, q, and ``keep``): two halves of the id's hash
    and the whole-number coordinates of the standardised columns."""
    h = hash52(F.col(id_col), F.lit(seed))
    q = F.array(*[F.round(F.col(c) * UNIT).cast("long") for c in cols])
    rows = df.select(F.shiftright(h, HALF).alias("a"), h.bitwiseAND((1 << HALF) - 1).alias("b"), q.alias("q"), *keep)
    return scratch.write(rows, "points") if scratch else cut_lineage(rows, "points")


# ---------------------------------------------------------------- inside a task
def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(a, b, coordinates, batch) of at most CELLS / width rows."""
    rows = max(1, CELLS // max(width, 1))
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            q = np.array(batch.column(2).flatten(), np.float64).reshape(batch.num_rows, -1)
            yield np.array(batch.column(0), np.int64), np.array(batch.column(1), np.int64), q, batch


def _unit(a: np.ndarray, b: np.ndarray, coefficients: tuple) -> np.ndarray:
    x, y, z = coefficients
    return ((x * a + y * b + z) % PRIME) / PRIME


def _weights(a: np.ndarray, b: np.ndarray, replicas: list[Replica], seed: int) -> np.ndarray | None:
    """Rows x replicas; None where all are 1."""
    runs = [r.run for r in replicas]
    if all(run is None for run in runs):
        return None
    steps = np.array(poisson_steps())
    of = {run: np.ones(len(a)) if run is None else np.searchsorted(steps, _unit(a, b, stream(seed, "weight", run)), side="right").astype(np.float64) for run in set(runs)}
    return np.stack([of[run] for run in runs], axis=1)


def _distances(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows x replicas x centres, added up by coordinate in their order."""
    out = np.zeros((len(q), *centres.shape[:2]))
    for j in range(q.shape[1]):
        gap = q[:, j][:, None, None] - centres[None, :, :, j]
        out += gap * gap
    return out


def _nearest(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """``_distances(q, centres).argmin(axis=2)``, by products of matrices; only
    where those cannot tell the two nearest centres apart are the distances added up."""
    best = second = label = None
    for c in range(centres.shape[1]):
        at = centres[:, c, :]
        d = (at * at).sum(axis=1) - 2.0 * (q @ at.T)
        if best is None:
            best, second, label = d, np.full_like(d, np.inf), np.zeros(d.shape, np.int64)
        else:
            np.putmask(label, d < best, c)
            second = np.minimum(second, np.maximum(best, d))
            best = np.minimum(best, d)
    size = np.sqrt((q * q).sum(axis=1))[:, None] + np.sqrt((centres * centres).sum(axis=2)).max(axis=1)[None, :]
    rows, of = np.nonzero(~(second - best > CLOSE * size * size))
    if len(rows):
        d = np.zeros((len(rows), centres.shape[1]))
        for j in range(q.shape[1]):
            gap = q[rows, j][:, None] - centres[of, :, j]
            d += gap * gap
        label[rows, of] = d.argmin(axis=1)
    return label


def _by_k(replicas: list[Replica]) -> list[tuple[int, list[int]]]:
    """Places of the replicas of each number of clusters."""
    return [(k, [i for i, r in enumerate(replicas) if r.k == k]) for k in sorted({r.k for r in replicas})]


# ---------------------------------------------------------------- scans
def _next_starts(pts: DataFrame, replicas: list[Replica], chosen: list[np.ndarray], seed: int) -> dict:
    """The row that each replica takes as its next centre: an exponential race
    in which a row runs with its weight times its squared distance to the
    nearest centre so far."""
    step = len(chosen[0])
    names = [stream(seed, "start", r.k, r.start, "" if r.run is None else r.run, step) for r in replicas]

    def run(batches):
        best: list = [None] * len(replicas)
        for a, b, q, _ in _batches(batches, len(replicas) * max(step, 1)):
            w = _weights(a, b, replicas, seed)
            near = _distances(q, np.stack(chosen)).min(axis=2) if step else np.ones((len(q), len(replicas)))
            for i, name in enumerate(names):
                speed = near[:, i] if w is None else near[:, i] * w[:, i]
                usable = np.flatnonzero(speed > 0)
                if len(usable):
                    key = -np.log(1.0 - _unit(a[usable], b[usable], name)) / speed[usable]
                    first = usable[key == key.min()]
                    at = first[np.lexsort((b[first], a[first]))[0]]
                    mine = (float(key.min()), int(a[at]), int(b[at]), q[at].astype(np.int64).tolist())
                    best[i] = mine if best[i] is None else min(best[i], mine)
        got = [(i, *x) for i, x in enumerate(best) if x is not None]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["r", "key", "a", "b", "q"])

    found = pts.select("a", "b", "q").mapInArrow(run, "r int, key double, a long, b long, q array<long>")
    return {r["r"]: np.array(r["m"]["q"], np.float64) for r in found.groupBy("r").agg(F.min(F.struct("key", "a", "b", "q")).alias("m")).collect()}


def _totals(pts: DataFrame, replicas: list[Replica], centres: list[np.ndarray], seed: int, costs: bool = True) -> dict:
    """(replica, centre) -> (weight, sums of coordinates, sum of squared distances), of the rows nearest to it.
    Without ``costs`` the last is 0. Weights and coordinates are whole numbers, so their sums are exact in any order."""

    def run(batches):
        kept: dict = {}
        for a, b, q, _ in _batches(batches, sum(r.k for r in replicas)):
            every = _weights(a, b, replicas, seed)
            plain, weighed = np.column_stack([np.ones(len(q)), q]), {}
            for k, at in _by_k(replicas):
                of = np.stack([centres[i] for i in at])
                label = _nearest(q, of)
                cell = (np.arange(len(at)) * k + label).ravel()
                sums = np.empty((len(at) * k, plain.shape[1]))
                for n, i in enumerate(at):
                    run_of = replicas[i].run
                    if run_of not in weighed:
                        weighed[run_of] = plain if every is None else plain * every[:, i][:, None]
                    own = (label[:, n] == np.arange(k)[:, None]).astype(np.float64)
                    sums[n * k : (n + 1) * k] = own @ weighed[run_of]
                cost = np.zeros(len(at) * k)
                if costs:
                    d = np.zeros(label.shape)
                    for j in range(q.shape[1]):
                        gap = q[:, j][:, None] - of[np.arange(len(at)), label, j]
                        d += gap * gap
                    cost = np.bincount(cell, (d if every is None else every[:, at] * d).ravel(), len(at) * k)
                rows = [sums, cost]
                kept[k] = [x + y for x, y in zip(kept[k], rows)] if k in kept else rows
        for k, at in _by_k(replicas):
            if k in kept:
                sums, cost = kept[k]
                whole = sums.astype(np.int64)
                rows = pa.array(whole[:, 1:].tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, k), pa.int32()), pa.array(np.tile(np.arange(k), len(at)), pa.int32()), pa.array(whole[:, 0]), rows, pa.array(cost)], names=["r", "c", "n", "s", "cost"])

    width = len(centres[0][0])
    found = pts.select("a", "b", "q").mapInArrow(run, "r int, c int, n long, s array<long>, cost double")
    sums = found.groupBy("r", "c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(j))) for j in range(width)]).alias("s"), F.sum("cost").alias("cost"))
    return {(r["r"], r["c"]): (r["n"], np.array(r["s"], np.float64), r["cost"]) for r in sums.collect()}


@dataclass
class Fit:
    replica: Replica
    centres: np.ndarray  # k x columns, in standard deviations
    cost: float  # weighted sum of squared distances
    mean_cost: float  # the same for a row, as compared between starts
    iterations: int


def fit(pts: DataFrame, replicas: list[Replica], seed: int = 42, max_iter: int = 300) -> list[Fit]:
    """A fit for each replica. A centre without rows stays where it is; a
    replica with fewer different rows than clusters repeats its last centre."""
    centres: list[np.ndarray] = [np.empty((0, 0))] * len(replicas)
    for step in range(max((r.k for r in replicas), default=0)):
        due = [i for i, r in enumerate(replicas) if r.k > step]
        got = _next_starts(pts, [replicas[i] for i in due], [centres[i] for i in due], seed)
        for n, i in enumerate(due):
            if n not in got and not step:
                return []  # no rows
            new = got.get(n, centres[i][-1] if step else None)
            centres[i] = np.vstack([centres[i], new]) if step else new[None, :]
    iterations = [0] * len(replicas)
    moving = list(range(len(replicas)))
    for _ in range(max_iter):
        totals = _totals(pts, [replicas[i] for i in moving], [centres[i] for i in moving], seed, costs=False)
        still = []
        for n, i in enumerate(moving):
            new = centres[i].copy()
            for c in range(replicas[i].k):
                weight, sums, _ = totals.get((n, c), (0, None, 0.0))
                if weight:
                    new[c] = sums / weight
            shift = float(((new - centres[i]) ** 2).sum()) / UNIT**2
            centres[i], iterations[i] = new, iterations[i] + 1
            if shift > TOLERANCE:
                still.append(i)
        moving = still
        if not moving:
            break
    totals = _totals(pts, replicas, centres, seed)
    out = []
    for i, r in enumerate(replicas):
        cost = sum(totals.get((i, c), (0, None, 0.0))[2] for c in range(r.k)) / UNIT**2
        weight = sum(totals.get((i, c), (0, None, 0.0))[0] for c in range(r.k))
        out.append(Fit(r, centres[i] / UNIT, cost, cost / max(weight, 1), iterations[i]))
    return out


def best(fits: list[Fit]) -> Fit:
    """The fit of least cost; costs that agree to nine decimals a row go to the earlier start."""
    return min(fits, key=lambda f: (round(f.mean_cost, 9), f.replica.start))


# ---------------------------------------------------------------- with fitted centres
def contingency(pts: DataFrame, label: str, fits: list[Fit]) -> DataFrame:
    """(fit, a, b, n): rows by their given label and the nearest centre of each fit, in one scan."""
    shapes = [Replica(len(f.centres), i) for i, f in enumerate(fits)]
    centres = [f.centres * UNIT for f in fits]

    def run(batches):
        counts: dict = {}
        for _, _, q, batch in _batches(batches, sum(r.k for r in shapes)):
            given = np.array(batch.column(3), np.int64)
            for _, at in _by_k(shapes):
                near = _nearest(q, np.stack([centres[i] for i in at]))
                for n, i in enumerate(at):
                    pairs, times = np.unique(np.stack([given, near[:, n]]), axis=1, return_counts=True)
                    for (x, y), t in zip(pairs.T.tolist(), times.tolist()):
                        counts[i, x, y] = counts.get((i, x, y), 0) + t
        if counts:
            rows = [(*k, t) for k, t in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["fit", "a", "b", "n"])

    found = pts.select("a", "b", "q", F.col(label).cast("long").alias("label")).mapInArrow(run, "fit int, a long, b long, n long")
    return found.groupBy("fit", "a", "b").agg(F.sum("n").alias("n"))


def silhouettes(pts: DataFrame, fits: list[Fit], seed: int = 42) -> list[float]:
    """Mean silhouette by squared Euclidean distance of each fit, in two scans
    for all of them: the mean squared distance of a row to a cluster follows
    from the cluster's size, sums and sums of squares."""
    shapes = [Replica(len(f.centres), i) for i, f in enumerate(fits)]
    centres = [f.centres * UNIT for f in fits]
    totals = _totals(pts, shapes, centres, seed)
    sizes = [np.array([totals.get((i, c), (0, 0, 0.0))[0] for c in range(r.k)], np.float64) for i, r in enumerate(shapes)]
    means = [np.stack([totals[i, c][1] / sizes[i][c] if sizes[i][c] else centres[i][c] for c in range(r.k)]) for i, r in enumerate(shapes)]
    # spread of a cluster around its own mean, from that around the centre it was assigned by
    spread = []
    for i, r in enumerate(shapes):
        around = np.array([totals.get((i, c), (0, 0, 0.0))[2] for c in range(r.k)]) / np.maximum(sizes[i], 1)
        spread.append(around - ((means[i] - centres[i]) ** 2).sum(axis=1))

    def run(batches):
        sums, n = np.zeros(len(shapes)), 0
        for _, _, q, _ in _batches(batches, sum(r.k for r in shapes)):
            n += len(q)
            for _, at in _by_k(shapes):
                label = _nearest(q, np.stack([centres[i] for i in at]))
                to_mean = _distances(q, np.stack([means[i] for i in at]))
                for m, i in enumerate(at):
                    own = label[:, m]
                    mean_to = np.where(sizes[i] > 0, to_mean[:, m] + spread[i], np.inf)
                    rows = np.arange(len(q))
                    alone = sizes[i][own] <= 1
                    inside = mean_to[rows, own] * sizes[i][own] / np.maximum(sizes[i][own] - 1, 1)
                    mean_to[rows, own] = np.inf
                    outside = mean_to.min(axis=1)
                    top = np.maximum(inside, outside)
                    value = np.where(alone | ~np.isfinite(outside) | (top <= 0), 0.0, (outside - inside) / np.where(top > 0, top, 1))
                    sums[i] += value.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(shapes)), pa.int32()), pa.array(sums), pa.array([n] * len(shapes), pa.int64())], names=["fit", "s", "n"])

    found = pts.select("a", "b", "q").mapInArrow(run, "fit int, s double, n long").groupBy("fit").agg((F.sum("s") / F.sum("n")).alias("s"))
    return [r["s"] for r in sorted(found.collect())]
