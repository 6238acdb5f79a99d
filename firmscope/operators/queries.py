"""Report queries over the pipeline results.

Every function is DataFrame -> DataFrame. Top-k and first-match use the
company id as the final sort key (the reference relied on file order);
``orderBy(...).limit(n)`` plans as TakeOrderedAndProject (per-partition top-n,
no global sort).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmscope.functions.portable import hash52
from firmscope.operators.stats import attach_by_key, bounded_broadcast, quantiles, rows_at
from firmscope.session import cut_lineage

ID = "company_id"


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Several one-row aggregates -> one row with all their columns (a union
    and one aggregate; no join)."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    cols = []
    for f in frames:
        cols += [c for c in f.columns if c not in cols]
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def stat_row(one_row: DataFrame) -> dict:
    """A fitted one-row statistic, as driver-side numbers for literals."""
    row = one_row.first()
    return row.asDict() if row is not None else {}


# ---------------------------------------------------------------- filters
def sidebar_filter(df: DataFrame, region: str | None = None, cluster: str | None = None, anomalies_only: bool = False) -> DataFrame:
    """Region =, cluster name =, anomalies only; ``None``/``All`` = no filter."""
    if region not in (None, "All"):
        df = df.filter(F.col("region") == region)
    if cluster not in (None, "All"):
        df = df.filter(F.col("cluster_name") == cluster)
    if anomalies_only:
        df = df.filter(F.col("anomaly_label") == "Anomaly")
    return df


@dataclass(frozen=True)
class MarketSpec:
    """Market filter specification; any empty field means no filter."""
    region: str | None = None
    country: str | None = None
    industry_keywords: tuple = ()
    min_revenue: float | None = None
    max_revenue: float | None = None
    min_employees: float | None = None
    max_employees: float | None = None
    target_tiers: tuple = ()
    exclude_high_risk: bool = False
    limit: int | None = None
    extra: dict = field(default_factory=dict)


def market_filter(df: DataFrame, spec: MarketSpec, tier_mode: str = "tier") -> DataFrame:
    """Conjunction of the spec's filters.

    * region: applied only when some row has that region (else ignored); the
      existence check is a one-row probe (on a region-partitioned table it
      reads only that partition's metadata), so the filter itself is static
      and prunes partitions;
    * country: lower-cased, trimmed literal containment (null never matches);
    * industry: any keyword as a case-insensitive regular expression;
    * revenue / employee bounds inclusive; tiers IN (tier number, or the raw
      k-means label with ``tier_mode='label'``); exclude rows with >= 2 flags.
    """
    if spec.region and df.filter(F.col("region") == spec.region).select(F.lit(1)).limit(1).count() > 0:
        df = df.filter(F.col("region") == spec.region)
    if spec.country:
        needle = spec.country.strip().lower()
        df = df.filter(F.coalesce(F.lower(F.trim(F.col("country"))).contains(needle), F.lit(False)))
    kws = [k for k in spec.industry_keywords if k]
    if kws:
        df = df.filter(F.coalesce(F.col("sic_description").rlike("(?i)" + "|".join(kws)), F.lit(False)))
    if spec.min_revenue:
        df = df.filter(F.col("revenue_clean") >= spec.min_revenue)
    if spec.max_revenue:
        df = df.filter(F.col("revenue_clean") <= spec.max_revenue)
    if spec.min_employees:
        df = df.filter(F.col("employees_clean") >= spec.min_employees)
    if spec.max_employees:
        df = df.filter(F.col("employees_clean") <= spec.max_employees)
    if spec.target_tiers:
        col = "cluster_tier" if tier_mode == "tier" else "cluster"
        df = df.filter(F.col(col).isin(list(spec.target_tiers)))
    if spec.exclude_high_risk and "risk_flags" in df.columns:
        df = df.filter(F.col("risk_flags") < 2)
    return df


def market_spec(fields: dict) -> MarketSpec:
    """The specification in a parsed reply; null or absent fields set no
    filter. Revenue and headcount bounds, tiers and the row limit as given."""
    known = {k: v for k, v in fields.items() if v is not None and k in MarketSpec.__dataclass_fields__}
    return MarketSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})


def search_name(df: DataFrame, text: str | None) -> DataFrame:
    """Case-insensitive regex search on the name; empty text keeps all rows."""
    if not text:
        return df
    return df.filter(F.coalesce(F.col("company_name").rlike("(?i)" + text), F.lit(False)))


def company_lookup(df: DataFrame, names: DataFrame) -> DataFrame:
    """First row (smallest id) per requested name: ``names`` has column
    ``company_name``. A semi-join then the smallest id per name."""
    hits = df.join(names.select("company_name").distinct(), "company_name", "left_semi")
    w = Window.partitionBy("company_name").orderBy(ID)
    return hits.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk")


# ---------------------------------------------------------------- top-k, paging, sampling
def top_by(df: DataFrame, col: str, n: int, columns: list) -> DataFrame:
    return df.orderBy(F.col(col).desc_nulls_last(), F.col(ID)).limit(n).select(*columns)


def page(df: DataFrame, number: int, size: int = 50, order: str = ID) -> DataFrame:
    """Page ``number`` (1-based) of rows ordered by the numeric column
    ``order`` (ties by id), plus the page count max(1, ceil(n / size)) as a
    column. Any page sorts only the range of values it lies in, so the last
    one costs what the first does."""
    rows, total = rows_at(df, order, (number - 1) * size, size, ID)
    return rows.withColumn("total_pages", F.lit(max(1, -(-total // size))).cast("long"))


def sample_scatter(df: DataFrame, n: int = 1000, seed: int = 7) -> DataFrame:
    """All rows when at most n, else a uniform random n: those of the smallest
    portable hash of the id, whatever the file layout (per-partition top-n, no
    global sort)."""
    return df.withColumn("_r", hash52(F.col(ID), F.lit(seed))).orderBy("_r", ID).limit(n).drop("_r")


# ---------------------------------------------------------------- aggregates
def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    out = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    out = out.orderBy(F.col("n").desc(), F.col(col))
    return out.limit(n) if n else out


def lead_tier_counts(df: DataFrame, cuts=(70.0, 50.0, 30.0)) -> DataFrame:
    hi, mid, lo = cuts
    s = F.col("lead_score")
    return df.agg(
        F.count_if(s >= hi).alias("priority"),
        F.count_if((s >= mid) & (s < hi)).alias("hot"),
        F.count_if((s >= lo) & (s < mid)).alias("warm"),
        F.count_if(s < lo).alias("cold"),
    )


def histogram(df: DataFrame, col: str, width: float, bins: int, lo: float = 0.0) -> DataFrame:
    """Fixed-width bins from ``lo``; the top edge folds into the last bin."""
    b = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).cast("long")
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(b.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (F.lit(lo) + F.col("bin") * width).alias("bin_start"), "n")
    )


def range_histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the range of the values; the largest one belongs
    to the last bin. Values that are all equal lie in bin 0."""
    st = stat_row(df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")))
    lo, hi = st["lo"] or 0.0, st["hi"] or 0.0
    return histogram(df, col, (hi - lo) / bins if hi > lo else 1.0, bins, lo)


def market_summary(df: DataFrame) -> DataFrame:
    return quantiles(df, ["revenue_clean"], (), 0.5, ["median_revenue"], aggs=[
        F.count(F.lit(1)).alias("companies"), F.avg("lead_score").alias("avg_lead_score"), F.countDistinct("country").alias("countries")])


def country_breakdown(df: DataFrame, n: int = 10) -> DataFrame:
    base = df.filter(F.col("country").isNotNull())
    per = quantiles(base, ["revenue_clean"], ["country"], 0.5, ["median_revenue"], aggs=[
        F.count(F.lit(1)).alias("companies"), F.avg("lead_score").alias("avg_lead_score")])
    return per.orderBy(F.col("companies").desc(), "country").limit(n)


def global_medians(df: DataFrame) -> DataFrame:
    rpe = F.col("revenue_clean") / F.when(F.col("employees_clean") == 0, F.lit(1.0)).otherwise(F.col("employees_clean"))
    return quantiles(df.withColumn("_rpe", rpe), ["revenue_clean", "_rpe"], (), 0.5, ["median_revenue", "median_productivity"])


def group_moments(df: DataFrame, group: str, value: Column) -> DataFrame:
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")
    )


def box_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and 1.5-IQR whiskers (most extreme data points inside the fences)."""
    base = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    # a row for each group: written once, as the whiskers and the result read it
    q = bounded_broadcast(cut_lineage(quantiles(base, [value], [group], [0.25, 0.5, 0.75], ["q1", "median", "q3"]), "quartiles"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return base.join(q, group).groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(F.col(value) >= F.col("q1") - reach, F.col(value))).alias("whisker_low"),
        F.max(F.when(F.col(value) <= F.col("q3") + reach, F.col(value))).alias("whisker_high"),
    )


def distinct_values(df: DataFrame, col: str, limit: int | None = None, where: Column | None = None, exclude=None) -> DataFrame:
    base = df if where is None else df.filter(where)
    out = base.filter(F.col(col).isNotNull()).select(col).distinct()
    if exclude is not None:
        out = out.filter(F.col(col) != exclude)
    out = out.orderBy(col)
    return out.limit(limit) if limit else out


def compare_companies(df: DataFrame, pairs: DataFrame, metrics=("employees_clean", "revenue_clean")) -> DataFrame:
    """Side-by-side metrics for a table of pairs (id_a, id_b): one row per
    pair and metric. Two keyed lookups, then an unpivot."""
    joined = pair_columns(df, pairs, metrics)
    stack = ", ".join(f"'{m}', CAST(a_{m} AS DOUBLE), CAST(b_{m} AS DOUBLE)" for m in metrics)
    return joined.selectExpr("id_a", "id_b", f"stack({len(metrics)}, {stack}) AS (metric, value_a, value_b)")


def pair_columns(df: DataFrame, pairs: DataFrame, columns) -> DataFrame:
    """``pairs`` (id_a, id_b) with ``columns`` of both companies (prefixes
    ``a_`` and ``b_``). Either id may repeat in any number of pairs, as when
    all are compared with a few leaders: each lookup deals its hot ids over
    several tasks, keyed by the other id."""
    a = df.select(F.col(ID).alias("id_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = df.select(F.col(ID).alias("id_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return attach_by_key(attach_by_key(pairs, a, ["id_a"], ["id_b"]), b, ["id_b"], ["id_a"], occurring=pairs)
