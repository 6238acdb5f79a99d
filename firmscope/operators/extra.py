"""Analytics the reference's report describes without code (X1–X12); the
semantics here are this library's, documented per function."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmscope.functions import scoring as S
from firmscope.operators import lloyd
from firmscope.operators.queries import stat_row
from firmscope.operators.stats import quantiles, smallest_k_per_group
from firmscope.session import Scratch, cut_lineage

# Employee size bands (fixed values): label, inclusive upper bound.
SIZE_BANDS = (("1-10", 10.0), ("11-50", 50.0), ("51-200", 200.0), ("201-1000", 1000.0), ("1000+", None))


def size_bands(df: DataFrame, col: str = "employees_clean") -> DataFrame:
    """Companies per employee band with their share in percent."""
    band = None
    for label, hi in SIZE_BANDS:
        if hi is None:
            band = band.otherwise(F.lit(label))
        else:
            band = F.when(F.col(col) <= hi, F.lit(label)) if band is None else band.when(F.col(col) <= hi, F.lit(label))
    counted = df.filter(F.col(col).isNotNull()).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))  # <= 5 rows


def correlations(df: DataFrame) -> DataFrame:
    return df.agg(
        F.corr("revenue_clean", "employees_clean").alias("rev_emp"),
        F.corr("revenue_clean", "market_value_clean").alias("rev_market_value"),
        F.corr("revenue_clean", "entity_score").alias("rev_entity_score"),
    )


def founding_summary(df: DataFrame, after: int = 2015) -> DataFrame:
    y = df.filter(F.col("year_found_clean").isNotNull())
    return quantiles(y, ["year_found_clean"], (), 0.5, ["median_year"], aggs=[
        F.count(F.lit(1)).alias("n"), F.avg((F.col("year_found_clean") > after).cast("double")).alias("share_after")])


def founding_by_year(df: DataFrame) -> DataFrame:
    return df.filter(F.col("year_found_clean").isNotNull()).groupBy(F.col("year_found_clean").alias("year")).agg(
        F.count(F.lit(1)).alias("n")
    )


def sic_sparsity(df: DataFrame, small: int = 5) -> DataFrame:
    """Per SIC level (4-digit code, 2-digit prefix): number of groups, share
    of groups under ``small`` rows, median group size."""
    out = None
    for level, key in (("sic4", F.coalesce(F.col("sic_code"), F.lit("nan"))), ("sic2", F.col("sic2"))):
        sizes = cut_lineage(df.groupBy(key.alias("g")).agg(F.count(F.lit(1)).alias("size")), "group-sizes")
        part = quantiles(sizes, ["size"], (), 0.5, ["median_size"], aggs=[
            F.count(F.lit(1)).alias("groups"), F.avg((F.col("size") < small).cast("double")).alias("share_small")]).withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return out


def segment_insights(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("revenue_clean") > 1e8).alias("large_enterprises"),
        F.count_if((F.col("corporate_family_size") > 100) & (F.col("revenue_per_employee") > 5e4)).alias("efficient_groups"),
        F.count_if((F.col("revenue_clean") < 1e6) & (F.col("revenue_vs_industry") > 100)).alias("small_outperformers"),
    )


def k_sweep(df: DataFrame, id_col: str, cols, ks=range(2, 9), seed: int = 42, starts: int = 10, max_iter: int = 300) -> DataFrame:
    """Training cost and silhouette (squared Euclidean) per k, of the best of
    ``starts`` fits; all of them advance in the same scans."""
    with Scratch(df.sparkSession) as scratch:
        pts = lloyd.points(df, id_col, list(cols), seed=seed, scratch=scratch)
        fits = lloyd.fit(pts, [lloyd.Replica(k, s) for k in ks for s in range(starts)], seed, max_iter)
        chosen = [lloyd.best([f for f in fits if f.replica.k == k]) for k in ks]
        rows = [(int(f.replica.k), float(f.cost), float(s)) for f, s in zip(chosen, lloyd.silhouettes(pts, chosen))]
    return df.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double")


# Score-weight perturbations for the sensitivity check (fixed values).
WEIGHT_VARIANTS = (
    ("revenue_up_20", {"revenue": 1.2}),
    ("power_down_20", {"power": 0.8}),
    ("value_up_10_stability_down_10", {"market_value": 1.1, "stability": 0.9}),
)


def _score(df: DataFrame, weights=None):
    return S.lead_score_v2(
        F.col("revenue_clean"), F.col("is_domestic_ultimate_clean"), F.col("entity_score"), F.col("revenue_per_employee"),
        F.col("it_spend_per_emp"), F.col("market_value_clean"), F.col("company_age"), F.col("data_completeness"), 0.5, weights,
    )


def weight_sensitivity(df: DataFrame, variants=WEIGHT_VARIANTS, top: int = 100) -> DataFrame:
    """Jaccard similarity of the top-``top`` lead sets (score desc, id) under
    perturbed weights vs the base weights. All scores of a row are taken in
    one scan; the top sets are limited on the map side, and the base set's ids
    meet every variant's in one aggregate of (variants + 1) x ``top`` rows."""
    scores = [(None, None), *variants]
    stacked = df.select("company_id", F.inline(F.array(*[F.struct(F.lit(i).alias("v"), _score(df, w).alias("s")) for i, (_, w) in enumerate(scores)])))
    best = smallest_k_per_group(stacked, ["v"], [F.col("s").desc(), F.col("company_id")], top)
    sides = best.groupBy("company_id").agg(F.collect_set("v").alias("in"))
    pairs = sides.select(F.explode(F.sequence(F.lit(1), F.lit(len(variants)))).alias("v"), F.array_contains("in", 0).alias("base"), F.col("in"))
    pairs = pairs.select("v", "base", F.expr("array_contains(in, v)").alias("own")).filter(F.col("base") | F.col("own"))
    names = F.array(*[F.lit(n) for n, _ in variants])
    return pairs.groupBy("v").agg((F.count_if(F.col("base") & F.col("own")) / F.count(F.lit(1))).alias("jaccard")).select(
        F.element_at(names, F.col("v")).alias("variant"), "jaccard")


def profile_vs_market(df: DataFrame, metrics=("revenue_clean", "employees_clean", "lead_score", "company_age")) -> DataFrame:
    """Min-max normalised metrics of every company beside the market average
    of the normalised metric (one row per company and metric). The ranges
    and averages are fitted statistics applied as literals."""
    rng = stat_row(df.agg(*[F.min(m).alias(f"lo_{m}") for m in metrics], *[F.max(m).alias(f"hi_{m}") for m in metrics]))

    def norm(m):
        lo, hi = rng[f"lo_{m}"], rng[f"hi_{m}"]
        if lo is None or hi is None or not hi > lo:
            return F.lit(0.0)
        return (F.col(m) - F.lit(lo)) / F.lit(hi - lo)

    normed = df.select("company_id", *[norm(m).alias(m) for m in metrics])
    avgs = stat_row(normed.agg(*[F.avg(m).alias(m) for m in metrics]))
    lit = lambda v: "CAST(NULL AS DOUBLE)" if v is None else f"CAST({float(v)!r} AS DOUBLE)"
    stack = ", ".join(f"'{m}', {m}, {lit(avgs[m])}" for m in metrics)
    return normed.selectExpr("company_id", f"stack({len(metrics)}, {stack}) AS (metric, value, market_avg)")


def territory_balance(df: DataFrame, tier: str = "Hot") -> DataFrame:
    hot = df.filter(F.col("lead_tier") == tier)
    return hot.filter(F.col("region").isNotNull()).groupBy("region").agg(
        F.count(F.lit(1)).alias("leads"), F.sum("revenue_clean").alias("revenue")
    )


def territory_top_leads(df: DataFrame, tier: str = "Hot", n: int = 50) -> DataFrame:
    """Top ``n`` leads per region among one lead tier (score desc, id)."""
    hot = df.filter((F.col("lead_tier") == tier) & F.col("region").isNotNull())
    w = Window.partitionBy("region").orderBy(F.col("lead_score").desc(), "company_id")
    return hot.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("region", "rank", "company_id", "lead_score")


def anomaly_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """Histogram of the decision values over their range, with the share of
    rows below the cut (decision < 0)."""
    st = stat_row(df.agg(F.min("anomaly_score").alias("lo"), F.max("anomaly_score").alias("hi")))
    lo, hi = st["lo"] or 0.0, st["hi"] or 0.0
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col("anomaly_score") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("anomaly_score").alias("min_score"), F.count_if(F.col("anomaly_score") < 0).alias("below_cut")
    )

