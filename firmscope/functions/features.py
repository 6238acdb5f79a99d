"""Feature expressions (F1–F8, B1–B2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmscope.functions.clean import null_guarded_clip


def company_age(year: Column, reference_year: int, lo: float = 0.0, hi: float = 200.0) -> Column:
    """Reference year minus founding year, clipped; null stays null (filled later)."""
    return null_guarded_clip(F.lit(float(reference_year)) - year, lo, hi)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den with a zero or null denominator -> null."""
    return F.try_divide(num, F.when(den != 0, den))


def revenue_per_employee(rev: Column, emp: Column, null_rule: str = "null") -> Column:
    """Three null rules: ``null`` (pipeline, filled with the median later),
    ``zero`` (evaluator: employees <= 0 -> 0), ``one`` (reports: employees 0 -> 1)."""
    if null_rule == "one":
        return F.try_divide(rev, F.when(emp == 0, F.lit(1.0)).otherwise(emp))
    if null_rule == "zero":
        return F.when(emp > 0, F.try_divide(rev, emp)).otherwise(F.lit(0.0))
    return safe_ratio(rev, emp)


def it_spend_per_employee(it: Column, emp: Column) -> Column:
    """Zero or missing employees -> 0."""
    return F.coalesce(safe_ratio(it, emp), F.lit(0.0))


def has_parent(parent: Column) -> Column:
    return parent.isNotNull().cast("int")


def sic2(sic: Column) -> Column:
    """First two characters of the SIC code as text; null -> 'na' (a real group)."""
    return F.coalesce(F.substring(sic, 1, 2), F.lit("na"))


def data_completeness(rev_missing: Column, emp_missing: Column, *present: Column) -> Column:
    """Share of 7 fields present: revenue, employees, then five raw columns."""
    parts = [(~rev_missing).cast("int"), (~emp_missing).cast("int")] + [p.isNotNull().cast("int") for p in present]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / F.lit(float(len(parts)))


def vs_industry(value: Column, median: Column, lo: float = -100.0, hi: float = 500.0) -> Column:
    """(value / median - 1) * 100 when median > 0 else 0, clipped to [lo, hi]."""
    raw = F.when(median > 0, (value / median - 1) * 100).otherwise(F.lit(0.0))
    return null_guarded_clip(raw, lo, hi)


def vs_benchmark(value: Column, median: Column) -> Column:
    """Report variant: unclipped, 0 when the benchmark is not positive."""
    return F.when(median > 0, (value / median - 1) * 100).otherwise(F.lit(0.0))
