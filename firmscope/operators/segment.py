"""Segmentation (K1–K4, A2, J2): standardised features, k-means with several
starts, tier names from the per-cluster revenue rank and modal entity score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmscope.operators import lloyd
from firmscope.operators.impute import fit_scaler
from firmscope.operators.stats import median_row, quantiles
from firmscope.session import Scratch

# Cluster structure names (fixed values).
STRUCTURE_GLOBAL_HQ = "Global HQ"
STRUCTURE_LOCAL_HQ = "Local HQ"
STRUCTURE_PARENT_HQ = "Parent HQ"
STRUCTURE_SUBSIDIARY = "Subsidiary"
STRUCTURE_BRANCH = "Branch"
HQ_SCORE, SUB_SCORE, SMALL_RANK = 2.8, 1.8, 4


def cluster_matrix(df: DataFrame, cols, scaler: dict | None = None, medians: dict | None = None):
    """+-inf -> null -> column median, then z-score with the population std.
    Adds ``z_<column>`` and returns (df, scaler, medians)."""
    cols = list(cols)
    clean = df.withColumns({c: F.when(F.col(c).isin(float("inf"), float("-inf")), None).otherwise(F.col(c)).cast("double") for c in cols})
    if medians is None:
        # one pass: null counts and the scaler of the unfilled columns; the
        # median fill (and a refit) is only needed when some value is missing
        aggs = [F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols]
        for c in cols:
            aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
        row = clean.agg(*aggs).first()
        missing = [c for c in cols if row[f"n_{c}"]]
        medians = median_row(clean, missing) if missing else {}
        medians.update({c: None for c in cols if c not in medians})
        if not missing and scaler is None:
            scaler = {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] if row[f"s_{c}"] else 1.0) for c in cols}
    filled = clean.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c])) for c in cols if medians.get(c) is not None})
    if scaler is None:
        scaler = fit_scaler(filled, cols)
    z = filled.withColumns({f"z_{c}": (F.col(c) - F.lit(scaler[c][0])) / F.lit(scaler[c][1]) for c in cols})
    return z, scaler, medians


def kmeans_fit(df: DataFrame, id_col: str, cols, k: int = 5, starts: int = 10, seed: int = 42, max_iter: int = 300) -> lloyd.Fit:
    """Best of ``starts`` fits (k-means++ starts) by cost on the standardised
    columns; all starts advance in the same scans."""
    with Scratch(df.sparkSession) as scratch:
        pts = lloyd.points(df, id_col, list(cols), seed=seed, scratch=scratch)
        return lloyd.best(lloyd.fit(pts, [lloyd.Replica(k, s) for s in range(starts)], seed, max_iter))


def kmeans_assign(df: DataFrame, cols, centres) -> DataFrame:
    """Adds ``cluster``, the index of the centre nearest to ``cols`` (squared
    Euclidean distance, ties to the smaller index), as one expression over
    k centres given as sequences of numbers."""
    gaps = []
    for i, centre in enumerate(centres):
        d2 = F.lit(0.0)
        for c, v in zip(cols, centre):
            d2 = d2 + (F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v)))
        gaps.append(F.struct(d2.alias("d2"), F.lit(i).alias("i")))
    return df.withColumn("cluster", F.array_min(F.array(*gaps))["i"])


def cluster_tier_profile(df: DataFrame) -> DataFrame:
    """Per cluster: median revenue and the modal entity score (smallest of
    ties; the mean when no mode exists)."""
    return quantiles(df, ["revenue_clean"], ["cluster"], 0.5, ["median_revenue"], aggs=[
        F.coalesce(F.mode("entity_score", True), F.avg("entity_score")).alias("entity_mode"), F.count(F.lit(1)).alias("size")])


def name_clusters(profile: DataFrame) -> DataFrame:
    """Revenue rank (descending, ties share the lowest rank) -> ``Tier n``
    plus a structure word. ``profile`` has one row per cluster (k rows), so
    the unpartitioned rank window is over k rows only."""
    rank = F.rank().over(Window.orderBy(F.col("median_revenue").desc_nulls_last()))
    p = profile.withColumn("cluster_tier", rank)
    score, r = F.col("entity_mode"), F.col("cluster_tier")
    structure = (
        F.when(r == 1, STRUCTURE_GLOBAL_HQ)
        .when((r >= SMALL_RANK) & (score >= HQ_SCORE), STRUCTURE_LOCAL_HQ)
        .when(score >= HQ_SCORE, STRUCTURE_PARENT_HQ)
        .when(score >= SUB_SCORE, STRUCTURE_SUBSIDIARY)
        .otherwise(STRUCTURE_BRANCH)
    )
    return p.select(
        "cluster", "cluster_tier",
        F.concat(F.lit("Tier "), r.cast("string"), F.lit(" "), structure).alias("cluster_name"),
    )


def attach_cluster_name(df: DataFrame, names: DataFrame) -> DataFrame:
    """Lookup cluster -> (tier, name); ``names`` has k rows (bounded by k)."""
    return df.join(F.broadcast(names), "cluster", "left")
