"""Industry benchmark (A1, J1, B1, S7): per-SIC-2 medians joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmscope.functions.features import vs_industry
from firmscope.operators.stats import bounded_broadcast, quantiles


def industry_benchmark(df: DataFrame, exact: bool = True, aggs=()) -> DataFrame:
    """sic2 -> ind_rev_med, ind_emp_med (exact interpolated medians; the
    approximate variant returns a data value, not an interpolation)."""
    if exact:
        return quantiles(df, ["revenue_clean", "employees_clean"], ["sic2"], 0.5, ["ind_rev_med", "ind_emp_med"], aggs=aggs)
    return df.groupBy("sic2").agg(
        F.percentile_approx("revenue_clean", 0.5).cast("double").alias("ind_rev_med"),
        F.percentile_approx("employees_clean", 0.5).cast("double").alias("ind_emp_med"),
    )


def industry_stats(df: DataFrame) -> DataFrame:
    """The stored per-industry artefact: median/mean/std/count of revenue and
    median/mean/std of employees per SIC-2 group."""
    stats = industry_benchmark(df, aggs=[
        F.avg("revenue_clean").alias("ind_revenue_mean"),
        F.stddev_samp("revenue_clean").alias("ind_revenue_std"),
        F.count("revenue_clean").alias("ind_count"),
        F.avg("employees_clean").alias("ind_employees_mean"),
        F.stddev_samp("employees_clean").alias("ind_employees_std"),
    ])
    return stats.select(
        F.col("sic2").alias("sic_2digit"),
        F.col("ind_rev_med").alias("ind_revenue_median"), "ind_revenue_mean", "ind_revenue_std", "ind_count",
        F.col("ind_emp_med").alias("ind_employees_median"), "ind_employees_mean", "ind_employees_std",
    )


def attach_benchmark(df: DataFrame, stats: DataFrame, max_rows: int = 200_000, clip=(-100.0, 500.0)) -> DataFrame:
    """Left join to the per-industry medians (broadcast after a row-count
    check; the key is a 2-character prefix) and the clipped % gaps. Pass a
    materialised ``stats`` (the count check reads it)."""
    joined = df.join(bounded_broadcast(stats, max_rows), "sic2", "left")
    return joined.withColumns(
        {
            "revenue_vs_industry": vs_industry(F.col("revenue_clean"), F.col("ind_rev_med"), *clip),
            "employees_vs_industry": vs_industry(F.col("employees_clean"), F.col("ind_emp_med"), *clip),
        }
    )
