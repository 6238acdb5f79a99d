"""Column cleaners (C1–C8). Every function maps Column -> Column and stays
inside whole-stage codegen (no Python UDF)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmscope.config import ENTITY_DEFAULT, TRUE_TOKENS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_numeric(c) -> Column:
    """Pipeline cleaner: keep only ASCII digits and dots, parse; failure -> null.
    Apply to raw text only (``-5`` -> 5, ``1e6`` -> 16, ``1.2.3`` -> null)."""
    return F.regexp_replace(_col(c), r"[^0-9.]", "").try_cast("double")


def clean_number_strict(c) -> Column:
    """Evaluator cleaner: drop commas, trim, parse (signs and exponents kept)."""
    return F.trim(F.replace(_col(c), F.lit(","), F.lit(""))).try_cast("double")


def clean_boolean(c) -> Column:
    """``yes``/``true``/``1`` (any case) -> 1, anything else or null -> 0."""
    return F.when(F.lower(_col(c)).isin(*TRUE_TOKENS), F.lit(1)).otherwise(F.lit(0))


def is_missing(value: Column) -> Column:
    """Null or zero counts as missing (revenue, employees)."""
    return value.isNull() | (value == 0)


def zero_to_null_log1p(value: Column) -> Column:
    """Imputation input: log1p of the value with zero treated as missing."""
    return F.log1p(F.when(value != 0, value))


def entity_ordinal(c, mapping: Mapping[str, int], default: int = ENTITY_DEFAULT) -> Column:
    """Categorical -> ordinal through ``mapping``; unmapped or null -> default."""
    expr = None
    for key, val in mapping.items():
        expr = (F.when(_col(c) == key, F.lit(float(val))) if expr is None else expr.when(_col(c) == key, F.lit(float(val))))
    return expr.otherwise(F.lit(float(default)))


def fill_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def parse_year(c) -> Column:
    return _col(c).try_cast("double")


def null_guarded_clip(value: Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi] keeping nulls null (``least``/``greatest`` skip nulls)."""
    return F.when(value.isNull(), F.lit(None)).otherwise(F.least(F.greatest(value, F.lit(lo)), F.lit(hi)))
