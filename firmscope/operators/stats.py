"""Scale-safe building blocks shared by the operators.

* ``quantiles``            — exact (interpolated) grouped quantiles, selected by
                             narrowing ranges of values until they are short.
* ``rows_at``              — a page of an ordered table, found the same way.
* ``smallest_k_per_group`` — top-k rows per group; Spark limits each group on
                             the map side before the shuffle.
* ``bounded_broadcast``    — broadcast a side only after checking its row count.
* ``attach_by_key``        — keyed lookup whose hot keys are dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmscope.session import cut_lineage

# a key of a keyed lookup has a share for so many rows that hold it; and the most keys of several shares
ROWS_PER_SHARE, HOT_KEYS = 100_000, 50_000
# rows of a range of values that one task may put in order; of a page's range
SORT_ROWS = 1_000_000
PAGE_SORT_ROWS = 100_000
# buckets by which a range is split in a pass
SPLITS = 1024


def bounded_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``broadcast(df)`` when ``df`` has at most ``max_rows`` rows, else ``df``
    unchanged (the join then shuffles). Pass a materialised frame: the
    check runs a count job."""
    return F.broadcast(df) if df.count() <= max_rows else df


def attach_by_key(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner",
    occurring: DataFrame | None = None,
) -> DataFrame:
    """``rows`` with the columns of ``lookup`` (one row per key; ``keys`` are
    columns of both). A key that more than ``limit`` rows hold has a share for
    each ``limit`` of them; a row's share is picked by a hash of the ``spread``
    columns, and the lookup row is copied once for each share. The limit is
    ``ROWS_PER_SHARE``, or what leaves at most ``HOT_KEYS`` such keys, so their
    list can be broadcast at every size and the shares of a key grow with its
    rows. Other keys are joined as they are. Keys are counted in partial sums, in ``occurring`` where a
    cheaper frame has the same keys. Rows whose key the lookup lacks stay with ``how='left'``."""
    counted = rows if occurring is None else occurring
    n = counted.count()
    limit = max(ROWS_PER_SHARE, -(-n // HOT_KEYS))
    if n <= limit:  # no key can be hot
        return rows.join(lookup, list(keys), how)
    counts = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    hot = F.broadcast(counts.select(*keys, F.ceil(F.col("_rows") / limit).alias("_shares")))  # at most n / limit rows
    shares = F.coalesce(F.col("_shares"), F.lit(1).cast("long"))
    copies = lookup.join(hot, list(keys), "left").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("_shares")
    dealt = rows.join(hot, list(keys), "left").withColumn("_share", F.pmod(F.xxhash64(*spread), shares)).drop("_shares")
    return dealt.join(copies, [*keys, "_share"], how).drop("_share")


def smallest_k_per_group(
    df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column], k: int, rank_col: str = "_rk",
) -> DataFrame:
    """Rows ranked 1..k per group by ``order_cols`` (end with a unique key for
    a total order). ``row_number() <= k`` is planned as a partial
    WindowGroupLimit before the shuffle, so each map task ships at most k rows
    per group: a hot group reaches its reducer as k x map-tasks rows."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k).drop(rank_col)


# ---------------------------------------------------------------- selection by rank
def _first_bucket(v: Column) -> Column:
    """A non-decreasing function of a double with 16 steps per factor of two."""
    size = F.floor(F.log2(F.abs(v)) * 16) + 20_000  # positive for every finite double but 0
    size = F.when(F.abs(v) == float("inf"), F.lit(1 << 20)).otherwise(size)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("int")


def _same(left: str, right: str, cols: Sequence[str]) -> Column:
    """Null-safe equality of the columns of two aliased frames."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def _holding(histogram: DataFrame, by: list, targets: Column | None) -> DataFrame:
    """The buckets (``_b`` with count ``_n`` and values from ``_lo`` to
    ``_hi``) that hold the wanted ranks, with each rank counted within its
    bucket. ``targets`` gives the ranks from the number of values ``_all``; without
    it each row brings its own rank ``_k``."""
    w = Window.partitionBy(*by)
    known = histogram.filter(F.col("_b").isNotNull())
    cum = known.withColumn("_before", F.sum("_n").over(w.orderBy("_b")) - F.col("_n"))
    if targets is not None:
        cum = cum.withColumn("_all", F.sum("_n").over(w)).select("*", F.inline(targets)).filter(F.col("_tj") == F.col("_j"))
    inside = cum.filter((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_n")))
    return inside.withColumn("_k", F.col("_k") - F.col("_before"))


def _narrowed(df: DataFrame, value_cols: Sequence[Column], g: list, targets: Column, sort_rows: int) -> tuple[DataFrame, DataFrame]:
    """Where the wanted ranks lie: (base, held). ``base`` has a row (group,
    _j, _v) for each value; ``held`` one for each (group, wanted rank) with
    the range ``_lo`` to ``_hi`` of values that holds it, their number ``_n``
    (at most ``sort_rows``, or all equal) and the rank ``_k`` among them; also
    one with null ``_t`` for each group.

    Every pass counts the values of the ranges by bucket in partial sums and
    keeps the bucket that holds the rank; the next one reads only values
    between its least and its greatest. Those two never share a bucket
    again, and a pass narrows a range by a factor of 1024, so six passes
    end every range of doubles."""
    cells = F.array(*[F.struct(F.lit(j).alias("_j"), F.when(~F.isnan(c), c).alias("_v")) for j, c in enumerate(value_cols)])
    stacked = lambda rows: rows.select(*g, F.inline(cells))
    base = stacked(df)
    first = base.groupBy(*g, "_j", _first_bucket(F.col("_v")).alias("_b")).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    first = cut_lineage(first, "quantile-buckets")  # read for the ranks and for the groups
    keep = [*g, "_j", "_t", "_side", "_k", "_frac", "_n", "_lo", "_hi"]
    held = _holding(first, [*g, "_j"], targets).select(*keep)
    groups = first.select(*g).distinct() if g else first.limit(1).select()
    held = cut_lineage(held.unionByName(groups, allowMissingColumns=True), "quantile-ranges")
    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_n") > sort_rows)
    while True:
        ends = held.filter(wide).groupBy("_j").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).collect()  # a row per value column
        if not ends:
            return base, held
        near = F.lit(False)
        for r in ends:
            near = near | value_cols[r["_j"]].between(r["lo"], r["hi"])
        open_ = held.filter(wide)
        v, o = stacked(df.filter(near)).alias("v"), bounded_broadcast(open_).alias("o")
        inside = v.join(o, _same("v", "o", [*g, "_j"]) & F.col("v._v").between(F.col("o._lo"), F.col("o._hi")))
        bucket = F.least(F.floor((F.col("v._v") - F.col("o._lo")) / (F.col("o._hi") - F.col("o._lo")) * SPLITS), F.lit(SPLITS - 1)).cast("int")
        by = [*g, "_j", "_t", "_side"]
        counted = inside.select(*[F.col(f"o.{c}") for c in by], "o._k", "o._frac", bucket.alias("_b"), "v._v").groupBy(*by, "_k", "_frac", "_b").agg(
            F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        held = cut_lineage(held.filter(~F.coalesce(wide, F.lit(False))).unionByName(_holding(counted, by, None).select(*keep)), "quantile-ranges")


def quantiles(
    df: DataFrame, value_cols: Sequence[str], group_cols: Sequence[str] = (), p=0.5, names: Sequence[str] | None = None,
    aggs: Sequence[Column] = (), sort_rows: int | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantile ``p`` (as pandas/NumPy/DuckDB
    ``quantile_cont``) of each value column per group; nulls and NaN skipped.
    Returns one row per group, null where it has no value (one row when
    ``group_cols`` is empty). ``p`` may be a list of probabilities for a
    single value column (``names`` then names each probability). ``aggs`` are
    further named aggregates of the same groups, taken along in the same pass.

    Selection by narrowing: ranges of values that hold more than ``sort_rows``
    rows are split by counting, one scan a pass, until those that hold a
    wanted rank are short enough to be put in order by one task (or all equal). A table
    of at most ``sort_rows`` rows needs no split: one scan and one shuffle."""
    sort_rows = SORT_ROWS if sort_rows is None else sort_rows
    g, values = list(group_cols), [F.col(c).cast("double") for c in value_cols]
    many = isinstance(p, (list, tuple))
    wanted = [(0, float(x)) for x in p] if many else [(j, float(p)) for j in range(len(value_cols))]
    names = list(names or [f"q_{c}" for c in value_cols])
    if df.count() <= sort_rows:
        plain = [F.when(~F.isnan(v), v) for v in values]
        return df.groupBy(*g).agg(*[F.percentile(plain[j], F.lit(x)).alias(n) for (j, x), n in zip(wanted, names)], *aggs)
    rank = lambda x: (F.col("_all") - 1) * F.lit(x)
    targets = F.array(*[
        F.struct(F.lit(t).alias("_t"), F.lit(j).alias("_tj"), F.lit(side).alias("_side"), end(rank(x)).cast("long").alias("_k"), (rank(x) - F.floor(rank(x))).alias("_frac"))
        for t, (j, x) in enumerate(wanted) for side, end in ((0, F.floor), (1, F.ceil))])
    base, held = _narrowed(df, values, g, targets, sort_rows)
    short = held.filter(F.col("_lo") < F.col("_hi"))
    v, h = base.alias("v"), bounded_broadcast(short).alias("h")
    inside = v.join(h, _same("v", "h", [*g, "_j"]) & F.col("v._v").between(F.col("h._lo"), F.col("h._hi")))
    key = [*g, "_t", "_side", "_frac"]
    picked = inside.groupBy(*[F.col(f"h.{c}") for c in key], "h._k").agg(F.array_sort(F.collect_list("v._v")).alias("_vs"))
    picked = picked.select(*key, F.get("_vs", F.col("_k").cast("int")).alias("_v"))
    ends = picked.unionByName(held.filter(~F.coalesce(F.col("_lo") < F.col("_hi"), F.lit(False))).select(*key, F.col("_lo").alias("_v")))
    at = lambda t, side: F.max(F.when((F.col("_t") == t) & (F.col("_side") == side), F.col("_v")))
    cols = []
    for t, n in enumerate(names):
        lo, hi, frac = at(t, 0), at(t, 1), F.max(F.when(F.col("_t") == t, F.col("_frac")))
        cols.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * frac).alias(n))
    out = ends.groupBy(*g).agg(*cols)
    if not aggs:
        return out
    rest = df.groupBy(*g).agg(*aggs)
    rest_names = [c for c in rest.columns if c not in g]
    if not g:  # one row each
        return out.unionByName(rest, allowMissingColumns=True).agg(*[F.first(c, ignorenulls=True).alias(c) for c in [*out.columns, *rest_names]])
    return out.alias("q").join(rest.alias("r"), _same("q", "r", g)).select("q.*", *[f"r.{c}" for c in rest_names])


def rows_at(df: DataFrame, order: str, first: int, size: int, tie: str, sort_rows: int | None = None) -> tuple[DataFrame, int]:
    """Rows ``first`` .. ``first + size - 1`` (from 0) in the order of a
    numeric column, ties by ``tie``, nulls first; and the number of all rows.
    The ranges of values that hold both ends are found by narrowing, and only
    rows between them are sorted."""
    sort_rows = PAGE_SORT_ROWS if sort_rows is None else sort_rows
    total = df.count()
    last = min(first + size, total) - 1
    if total <= sort_rows or last < first:
        return df.orderBy(order, tie).offset(first).limit(size), total
    key = F.coalesce(F.col(order).cast("double"), F.lit(float("-inf")))
    targets = F.array(*[F.struct(F.lit(t).alias("_t"), F.lit(0).alias("_tj"), F.lit(0).alias("_side"), F.lit(k).cast("long").alias("_k"), F.lit(0.0).alias("_frac")) for t, k in enumerate((first, last))])
    _, held = _narrowed(df, [key], [], targets, sort_rows)
    ends = {r["_t"]: r for r in held.filter(F.col("_t").isNotNull()).collect()}  # two rows
    lo, hi = ends[0]["_lo"], ends[1]["_hi"]
    return df.filter((key >= lo) & (key <= hi)).orderBy(order, tie).offset(ends[0]["_k"]).limit(size), total


def median_row(df: DataFrame, cols: Sequence[str], names: Sequence[str] | None = None) -> dict:
    """Global exact medians of several columns, returned to the driver as a
    dict (a fitted statistic: a handful of numbers)."""
    names = list(names or cols)
    row = quantiles(df, cols, (), 0.5, names).first()
    return {n: (row[n] if row is not None else None) for n in names}
