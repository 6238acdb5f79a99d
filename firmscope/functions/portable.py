"""Hashes that any engine can repeat: samples, folds, shuffles and weights
picked by them do not depend on file layout, and SQL can follow them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash52(*parts: Column) -> Column:
    """52 bits (a long) of the MD5 of the parts' texts joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def unit(*parts: Column) -> Column:
    """A number from 0 (included) to 1 (excluded) of the same hash."""
    return hash52(*parts) / F.lit(float(1 << 52))


def hash52_sql(*parts: str) -> str:
    """The same in SQL, for parts that are integers."""
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


def unit_sql(*parts: str) -> str:
    return f"({hash52_sql(*parts)} / {float(1 << 52)!r})"
