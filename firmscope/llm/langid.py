"""Language identification by rank-order profiles (out-of-place distance).

A profile is the list of a language's most frequent letter n-grams (1 to 3
letters, words padded with one blank), in order of frequency. A text's own
list is compared with each profile: every n-gram of the text costs the
difference of its two ranks, or ``size`` where the profile lacks it. The
language with the smallest sum wins; equal sums go to the smaller name.

The profiles are fitted on at most about ``per_language`` labelled rows of each
language (a documented bound; rows are picked by a hash of their id), so their
size does not depend on the corpus: languages x ``size`` n-grams.

Rows: a text that is null or has no letter is ``und`` with score 0; so is
every text if nothing could be learned. Rows without language teach nothing.
Very long texts are counted a piece at a time. Ties: n-grams of a count are in
the order of their codes, languages of a distance in that of their names. Repeated rows: one output row each. Extra columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.operators.stats import bounded_broadcast

#: n-grams of a profile, and of a text.
PROFILE_SIZE = 300
#: Labelled rows that teach one language, about.
PER_LANGUAGE = 4000
#: Letters counted at a time; a longer text is counted piece by piece and the counts added.
PIECE = 1 << 20
UNKNOWN = "und"

_BITS = np.uint64(21)
#: What stands for a blank in an n-gram; no letter.
_BLANK = np.uint64(1)


@cache
def _letters() -> np.ndarray:
    """Each code point to itself if it is a letter, else to 0."""
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    keep = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return np.where(keep, points, 0).astype(np.uint32)


def _grams(text: str) -> np.ndarray:
    """Codes of all n-grams of the padded words: code points, the first one lowest."""
    points = _letters()[np.frombuffer(f" {text} ".lower().encode("utf-32-le", "replace"), np.uint32)]
    # runs of blanks shrink to one
    points = points[(points != 0) | np.concatenate([[True], points[:-1] != 0])].astype(np.uint64)
    if len(points) < 3:
        return np.empty(0, np.uint64)
    letter = points[points != 0]
    # a blank is a character of its own, or a word's end would be the same as the n-gram without it
    points = np.where(points == 0, _BLANK, points)
    a, b, c = points[:-2], points[1:-1], points[2:]
    two = a | b << _BITS
    # an n-gram has at least one letter and no blank inside
    return np.concatenate([letter, two, points[-2:-1] | points[-1:] << _BITS, (two | c << _BITS << _BITS)[b != _BLANK]])


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts."""
    if len(text) <= PIECE:
        return np.unique(_grams(text), return_counts=True)
    parts = [gram_counts(text[i : i + PIECE]) for i in range(0, len(text), PIECE)]
    return add_counts(parts)


def add_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by code."""
    if len(grams) > size:  # everything at least as frequent as the last one that fits
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.argsort(-counts, kind="stable")][:size]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, size: int = PROFILE_SIZE) -> dict[str, np.ndarray]:
    """The profile of each language of ``docs``. Counts are made per task and
    added per (language, n-gram); only the profiles come to the driver."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    share = known.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    # a few languages: sent along after a count of them, so that texts are not dealt by language
    picked = known.join(bounded_broadcast(share), "lang").where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.col("share") * float(1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(gram_counts(text))
            for lang, parts in by.items():
                grams, counts = add_counts(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    sums = picked.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = sums.withColumn("r", rank).where(F.col("r") <= size).orderBy("lang", "r").collect()
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(grams, np.uint64) for lang, grams in sorted(out.items())}


class Profiles:
    """Profiles laid side by side: one sorted table of n-grams, a row of ranks for each language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names, self.size = list(profiles), size
        self.grams = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.uint64)]))
        self.ranks = np.full((len(profiles), len(self.grams) + 1), -1, np.int64)  # the last column: in no profile
        for i, grams in enumerate(profiles.values()):
            self.ranks[i, np.searchsorted(self.grams, grams)] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score: 1 for the same order, 0 for nothing in common."""
        own = ranked(*gram_counts(text), self.size) if text and self.names else np.empty(0, np.uint64)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        there = self.ranks[:, at]
        away = np.where(there >= 0, np.abs(there - np.arange(len(own))), self.size).sum(axis=1)
        best = int(np.argmin(away))
        return self.names[best], 1.0 - float(away[best]) / (self.size * len(own))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE_SIZE) -> DataFrame:
    """(id, lang_pred, score) of every row."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Profiles(profiles, size)
        for batch in batches:
            found = [table.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["key", "lang_pred", "score"])

    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", id_col)
