"""Scaling and exact k-nearest-neighbour imputation.

The reference imputes log revenue and log headcount with the 5 nearest rows
under the NaN-Euclidean distance over (log revenue, log employees, entity
ordinal), standardised with the population std. With three coordinates of
which one (the ordinal) is always present and takes a handful of values, the
distance from a receiver missing target T to a donor having T is

    donor has the other coordinate x:   d^2 = 3/2 * (dx^2 + do^2)
    donor lacks x (or receiver does):    d^2 = 3   * do^2

so, per ordinal group of donors, the nearest donors are the nearest x values.
Receivers with the same (ordinal, x) have the same neighbours, so the search
runs once for each distinct pair and its answer is attached to the rows. The
plan never pairs every receiver with every donor:

1. per (group, x value) keep the k smallest donor ids (salted two-stage rank);
2. rank the distinct donor x values per group in one bucketed sort (running
   count per quantile bucket + bucket offsets); distinct receiver
   keys ride in the same sort and get their insertion rank r;
3. each distinct receiver key equi-joins value ranks r-k+1 .. r+k in every
   group (<= 2k values x k ids), plus the k smallest-id donors lacking x per
   group;
4. rank candidates per receiver key by (d^2, donor id), average the first k;
5. receivers take their key's answer (keys of many receivers are dealt over
   several tasks; those lacking x share one answer per ordinal: broadcast).

Fan-out per distinct key is bounded (groups x (2k x k + k)); ties are broken by
the smallest id. Observed values are never rewritten. Without any donor the
column's mean is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmscope.functions.portable import hash52
from firmscope.operators.donor_index import DonorIndex, build, near_values, nearest
from firmscope.operators.stats import attach_by_key, smallest_k_per_group
from firmscope.session import cut_lineage


def fit_scaler(df: DataFrame, cols) -> dict:
    """Mean and population std of each column, nulls skipped (z-score fit).
    A zero or undefined std becomes 1, as a standard scaler does."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        out[c] = (m if m is not None else 0.0, s if (s is not None and s > 0) else 1.0)
    return out


# bucket cuts for the ranking sort: about one bucket per RANK_BUCKET_ROWS input
# rows (at least `partitions`), cut at the quantiles of a sample of CUT_ROWS a bucket
RANK_BUCKET_ROWS, CUT_ROWS = 2_000_000, 20


def _fit_with_cuts(df: DataFrame, id_col: str, cols, cut_cols, partitions: int, scaler: dict | None):
    """The row count and the scaler (unless given) in one aggregation, then
    bucket boundaries of ``cut_cols`` for about max(partitions, rows /
    RANK_BUCKET_ROWS) buckets. These are quantiles of a sample picked by a hash of
    the id, about CUT_ROWS rows for each bucket, so the driver holds a
    hundred-thousandth of the rows; they set where a bucket ends, never a result."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    if scaler is None:
        for c in cols:
            aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    if scaler is None:
        scaler = {}
        for c in cols:
            m, s = row[f"m_{c}"], row[f"s_{c}"]
            scaler[c] = (m if m is not None else 0.0, s if (s is not None and s > 0) else 1.0)
    rows = row["_rows"] or 0
    buckets = max(partitions, -(-rows // RANK_BUCKET_ROWS))
    share = int(min(1.0, 100 * partitions / max(rows, 1) + CUT_ROWS * buckets / max(rows, 1)) * (1 << 40))
    picked = df.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < share).select(*cut_cols).toArrow()
    cuts = {}
    for c in cut_cols:
        values = sorted(v for v in picked.column(c).to_pylist() if v is not None)
        cuts[c] = sorted({values[len(values) * i // buckets] for i in range(1, buckets)}) if values else []
    return scaler, cuts


def scale(col, mean: float, std: float):
    return (F.col(col) - F.lit(mean)) / F.lit(std) if isinstance(col, str) else (col - F.lit(mean)) / F.lit(std)


def _running_rank(u: DataFrame, splits: list) -> DataFrame:
    """Global per-group rank of donor values. ``u`` has unique
    (tgt, g, key, kind) rows, kind 0 = donor value, 1 = receiver key. Adds
    ``rank`` = number of donor values of the (tgt, g) group sorting at or
    before the row (a donor value sorts before an equal receiver key).

    Deterministic and JVM-only: ``splits`` cut the key axis into buckets, a
    running count is taken inside each (tgt, g, bucket), and the counts of
    earlier buckets (a table of groups x buckets rows) are added.
    """
    if len(splits) > 2:
        bucketed = Bucketizer(splits=splits, inputCol="key", outputCol="b", handleInvalid="keep").transform(u)
    else:
        bucketed = u.withColumn("b", F.lit(0.0))
    is_v = (F.col("kind") == 0).cast("long")
    w = Window.partitionBy("tgt", "g", "b").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = bucketed.withColumn("local", F.sum(is_v).over(w))
    per_bucket = bucketed.groupBy("tgt", "g", "b").agg(F.sum(is_v).alias("cnt"))
    wb = Window.partitionBy("tgt", "g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("tgt", "g", "b", F.coalesce(F.sum("cnt").over(wb), F.lit(0)).alias("offset"))
    # one offset per (target, group, bucket); the rows are dealt by just that for their
    # window, so they are not moved again, and Spark broadcasts the offsets only while they are few
    return local.join(offsets, ["tgt", "g", "b"]).select(
        *u.columns, (F.col("offset") + F.col("local")).alias("rank")
    )


def _ordinals(groups, mean: float, std: float):
    """(array of the ordinal's values, map from a value to its standardised one)."""
    groups = sorted({float(g) for g in groups})
    return F.array(*[F.lit(g) for g in groups]), F.create_map(*[x for g in groups for x in (F.lit(g), F.lit((g - mean) / std))])


def _smallest_ids(donors: DataFrame, k: int) -> DataFrame:
    """(tgt, g, lacking, donors): the k smallest ids of all donors, and of
    those that lack x; at most 2 targets x groups x 2 rows of k."""
    out = None
    for lacking, part in ((False, donors), (True, donors.filter(F.col("x").isNull()))):
        top = smallest_k_per_group(part.select("tgt", "id", "g", "t"), ["tgt", "g"], [F.col("id")], k)
        rows = top.groupBy("tgt", "g").agg(F.collect_list(F.struct("id", "t")).alias("donors")).withColumn("lacking", F.lit(lacking))
        out = rows if out is None else out.unionByName(rows)
    return cut_lineage(out, "knn-extras")


def _candidates(keyed: DataFrame, keyless: DataFrame, extras: DataFrame, zo_map) -> DataFrame:
    """(tgt, rg, rkey, id, t, d2) of asked keys: ``keyed`` come with the values
    near them (key, donors); keys without x share only the ordinal with every donor,
    and all keys do with donors that lack x. ``keyless`` holds (tgt, rg, g, rzo, rkey) of all asked keys."""
    dzo = F.col("rzo") - zo_map[F.col("g")]
    by_value = keyed.select("tgt", "rg", "g", "rzo", "rkey", "key", F.inline("donors")).select(
        "tgt", "rg", "rkey", "id", "t", (F.lit(1.5) * ((F.col("rkey") - F.col("key")) * (F.col("rkey") - F.col("key")) + dzo * dzo)).alias("d2"))
    few = F.broadcast(extras)  # bounded by construction
    by_ordinal = keyless.join(few, ["tgt", "g"]).filter(F.col("lacking") == F.col("rkey").isNotNull())
    return by_value.unionByName(by_ordinal.select("tgt", "rg", "g", "rzo", "rkey", F.inline("donors")).select(
        "tgt", "rg", "rkey", "id", "t", (F.lit(3.0) * (dzo * dzo)).alias("d2")))


def _impute_long(long: DataFrame, group_arr, zo_map, k: int, splits: list, ks=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``long`` holds one row per (row, target): tgt, id, g, zo, x (the other
    coordinate, scaled, nullable), t (target value, null = receiver), _donor.
    Returns (id, tgt, value) for every receiver that has a donor; with ``ks`` (each <= k) one
    column ``k{n}`` per neighbour count instead of ``value``. Also the written donor
    values by rank, and the smallest ids, of which a donor index is made."""
    donors = long.filter(F.col("t").isNotNull() & F.col("_donor"))
    receivers = long.filter(F.col("t").isNull())

    # (1) donors having x: k smallest ids per (target, group, x value), as one array row per value
    d_x = donors.filter(F.col("x").isNotNull()).select("tgt", "id", "g", F.col("x").alias("key"), "t")
    d5 = smallest_k_per_group(d_x, ["tgt", "g", "key"], [F.col("id")], k)
    u = d5.groupBy("tgt", "g", "key").agg(F.collect_list(F.struct("id", "t")).alias("donors")).withColumn("kind", F.lit(0))

    # (2) one bucketed sort ranks donor values and distinct receiver keys together
    asked = receivers.select("tgt", F.col("g").alias("rg"), F.col("zo").alias("rzo"), F.col("x").alias("rkey")).distinct()
    rec = asked.withColumn("g", F.explode(group_arr))
    rec_x = rec.filter(F.col("rkey").isNotNull())
    keys = rec_x.select("tgt", "g", F.col("rkey").alias("key")).distinct().withColumn("kind", F.lit(1))
    u = u.unionByName(keys, allowMissingColumns=True)
    # both the value side and the receiver side read the ranks: materialise
    # once (column pruning would otherwise make the two subtrees differ and
    # run the top-k windows and the ranking sort twice)
    ranked = cut_lineage(_running_rank(u, splits), "knn-ranks")
    v_ranked = ranked.filter(F.col("kind") == 0).select("tgt", "g", F.col("rank").alias("vrank"), "key", "donors")
    r_keys = ranked.filter(F.col("kind") == 1).select("tgt", "g", F.col("key").alias("rkey"), F.col("rank").alias("r"))

    # (3) each key meets the k nearest distinct values on each side of it
    near = rec_x.join(r_keys, ["tgt", "g", "rkey"]).select(
        "tgt", "rg", "g", "rzo", "rkey", F.explode(F.sequence(F.col("r") - (k - 1), F.col("r") + k)).alias("vrank")
    )
    extras = _smallest_ids(donors, k)
    cands = _candidates(near.join(v_ranked, ["tgt", "g", "vrank"]), rec, extras, zo_map)

    # (4) k nearest by (d^2, id), mean of their values: one shuffle by receiver key
    by_key = ["tgt", "rg", "rkey"]
    best = nearest(cands.repartition(*by_key), by_key, k)
    if ks:
        names = [f"k{n}" for n in ks]
        found = best.groupBy(*by_key).agg(*[F.avg(F.when(F.col("_rk") <= n, F.col("t"))).alias(f"k{n}") for n in ks])
    else:
        names = ["value"]
        found = best.groupBy(*by_key).agg(F.avg("t").alias("value"))
    answers = cut_lineage(found.select("tgt", F.col("rg").alias("g"), F.col("rkey").alias("x"), *names), "knn-answers")

    # (5) one answer per (target, ordinal) for receivers lacking x; the others by their key
    rows = receivers.select("tgt", "id", "g", "x")
    keyless = answers.filter(F.col("x").isNull()).drop("x")
    keyed = attach_by_key(rows.filter(F.col("x").isNotNull()), answers.filter(F.col("x").isNotNull()), ["tgt", "g", "x"], ["id"])
    plain = rows.filter(F.col("x").isNull()).join(F.broadcast(keyless), ["tgt", "g"])
    return keyed.select("id", "tgt", *names).unionByName(plain.select("id", "tgt", *names)), v_ranked, extras


def knn_impute(
    df: DataFrame, id_col: str, a: str, b: str, ordinal: str, groups, k: int = 5, partitions: int = 8,
    scaler: dict | None = None,
) -> tuple[DataFrame, dict]:
    """Impute columns ``a`` and ``b`` (nullable doubles) from their k nearest
    rows under NaN-Euclidean distance over standardised (a, b, ordinal).
    ``groups`` lists every value the ordinal can take. Returns ``df`` with
    ``imp_a``/``imp_b`` (the observed value where present) and the scaler.
    """
    return knn_fit(df, id_col, a, b, ordinal, groups, k, partitions, scaler)[:2]


def knn_fit(
    df: DataFrame, id_col: str, a: str, b: str, ordinal: str, groups, k: int = 5, partitions: int = 8, scaler: dict | None = None,
) -> tuple[DataFrame, dict, Callable[[], DonorIndex]]:
    """``knn_impute``, and a function that stores the donors for ``knn_apply``."""
    scaler, raw_cuts = _fit_with_cuts(df, id_col, [a, b, ordinal], [a, b], partitions, scaler)
    (ma, sa), (mb, sb), (mo, so) = scaler[a], scaler[b], scaler[ordinal]
    group_arr, zo_map = _ordinals(groups, mo, so)
    rows = df.select(
        F.col(id_col).alias("id"), F.col(a).alias("va"), F.col(b).alias("vb"), F.col(ordinal).cast("double").alias("g"),
        scale(a, ma, sa).alias("za"), scale(b, mb, sb).alias("zb"), scale(ordinal, mo, so).alias("zo"), F.lit(True).alias("_donor"),
    )
    cuts = {(q - ma) / sa for q in raw_cuts[a]} | {(q - mb) / sb for q in raw_cuts[b]}
    splits = [float("-inf")] + sorted(c for c in cuts if abs(c) != float("inf")) + [float("inf")]
    common = ["id", "g", "zo", "_donor"]
    long = rows.select(F.lit("a").alias("tgt"), *common, F.col("zb").alias("x"), F.col("va").alias("t")).unionByName(
        rows.select(F.lit("b").alias("tgt"), *common, F.col("za").alias("x"), F.col("vb").alias("t"))
    )
    found, ranked, extras = _impute_long(long, group_arr, zo_map, k, splits)
    imp = found.groupBy("id").agg(
        F.max(F.when(F.col("tgt") == "a", F.col("value"))).alias(f"imp_{a}"),
        F.max(F.when(F.col("tgt") == "b", F.col("value"))).alias(f"imp_{b}"),
    )
    out = (
        df.join(imp.withColumnRenamed("id", id_col), id_col, "left")
        # a column without any donor falls back to its mean
        .withColumn(f"imp_{a}", F.coalesce(F.col(a), F.col(f"imp_{a}"), F.lit(ma)))
        .withColumn(f"imp_{b}", F.coalesce(F.col(b), F.col(f"imp_{b}"), F.lit(mb)))
    )
    return out, scaler, lambda: build(ranked, extras)


def knn_apply(new_rows: DataFrame, index: DonorIndex, a: str, b: str, ordinal: str, groups, scaler: dict, k: int = 5) -> DataFrame:
    """Impute new rows against stored donors (I4): the same neighbours, looked
    up in the donor index. Each row takes the answer of its (ordinal, other
    coordinate), so rows need no id and may repeat; without any donor the
    column's mean is taken."""
    (ma, sa), (mb, sb), (mo, so) = scaler[a], scaler[b], scaler[ordinal]
    group_arr, zo_map = _ordinals(groups, mo, so)
    # a key without x is NaN, and rows that lack nothing have a key that nothing answers
    nan, none = F.lit(float("nan")), F.lit(float("-inf"))
    za, zb, g = scale(a, ma, sa), scale(b, mb, sb), F.col(ordinal).cast("double")
    keyed = new_rows.withColumns({"_g": g, "_xa": F.when(F.col(a).isNotNull(), none).otherwise(F.coalesce(zb, nan)),
                                  "_xb": F.when(F.col(b).isNotNull(), none).otherwise(F.coalesce(za, nan))})
    wanted = keyed.select("_g", F.inline(F.array(*[F.struct(F.lit(t).alias("tgt"), F.col(f"_x{t}").alias("x")) for t in "ab"]))).filter(F.col("x") != none).distinct()
    asked = wanted.select("tgt", F.col("_g").alias("rg"), zo_map[F.col("_g")].alias("rzo"), F.when(~F.isnan("x"), F.col("x")).alias("rkey"))
    rec = cut_lineage(asked.withColumn("g", F.explode(group_arr)), "knn-asked")
    cands = _candidates(near_values(index, rec.filter(F.col("rkey").isNotNull()), k), rec, index.extras, zo_map)
    by_key = ["tgt", "rg", "rkey"]
    found = nearest(cands.repartition(*by_key), by_key, k).groupBy(*by_key).agg(F.avg("t").alias("value"))
    answers = cut_lineage(found.select("tgt", F.col("rg").alias("_g"), F.coalesce("rkey", nan).alias("x"), "value"), "knn-answers")
    out = keyed
    for t, col, mean in (("a", a, ma), ("b", b, mb)):
        of = answers.filter(F.col("tgt") == t).select("_g", F.col("x").alias(f"_x{t}"), F.col("value").alias(f"_v{t}"))
        out = attach_by_key(out, of, ["_g", f"_x{t}"], [a, b, *[c for c in ("company_id",) if c in new_rows.columns]], "left", occurring=keyed)
        out = out.withColumn(f"imp_{col}", F.coalesce(F.col(col), F.col(f"_v{t}"), F.lit(mean)))
    return out.select(*new_rows.columns, f"imp_{a}", f"imp_{b}")


def impute_cv(
    df: DataFrame, id_col: str, a: str, b: str, ordinal: str, groups, ks=(1, 3, 5, 7, 10), folds: int = 5,
    seed: int = 42, partitions: int = 8,
) -> DataFrame:
    """K-fold cross-validation of the kNN imputer (X8): every known value of
    ``a`` and ``b`` is hidden in one fold and imputed from the other folds;
    mean squared error per (target, k) over folds, its standard error, and
    the one-standard-error choice (largest k within one SE of the best).
    All folds, targets and k values run in one neighbour-search pass: the
    (target, fold) pair is the search's group key."""
    kmax = max(ks)
    scaler, raw_cuts = _fit_with_cuts(df, id_col, [a, b, ordinal], [a, b], partitions, None)
    (ma, sa), (mb, sb), (mo, so) = scaler[a], scaler[b], scaler[ordinal]
    group_arr, zo_map = _ordinals(groups, mo, so)
    rows = df.select(
        F.col(id_col).alias("id"), F.col(a).alias("va"), F.col(b).alias("vb"), F.col(ordinal).cast("double").alias("g"),
        scale(a, ma, sa).alias("za"), scale(b, mb, sb).alias("zb"), scale(ordinal, mo, so).alias("zo"),
        F.pmod(hash52(F.col(id_col), F.lit(seed)), F.lit(folds)).alias("fold"),
    )
    cuts = {(q - ma) / sa for q in raw_cuts[a]} | {(q - mb) / sb for q in raw_cuts[b]}
    splits = [float("-inf")] + sorted(c for c in cuts if abs(c) != float("inf")) + [float("inf")]
    per_fold = rows.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    parts = []
    for name, val, other in (("a", "va", "zb"), ("b", "vb", "za")):
        known = per_fold.filter(F.col(val).isNotNull())
        parts.append(known.select(
            F.concat(F.lit(name), F.lit(":"), F.col("f").cast("string")).alias("tgt"), "id", "g", "zo",
            F.col(other).alias("x"), F.when(F.col("fold") != F.col("f"), F.col(val)).alias("t"),
            (F.col("fold") != F.col("f")).alias("_donor"), F.col(val).alias("truth"),
        ))
    long = parts[0].unionByName(parts[1])
    pred, _, _ = _impute_long(long.drop("truth"), group_arr, zo_map, kmax, splits, ks)
    truth = long.filter(~F.col("_donor")).select("id", "tgt", "truth")
    err = pred.join(truth, ["id", "tgt"]).withColumn("target", F.split("tgt", ":")[0]).withColumn("fold", F.split("tgt", ":")[1])
    stack = ", ".join(f"{n}, k{n}" for n in ks)
    long_err = err.selectExpr("target", "fold", "truth", f"stack({len(ks)}, {stack}) AS (k, pred)")
    fold_mse = long_err.groupBy("target", "fold", "k").agg(F.avg((F.col("pred") - F.col("truth")) ** 2).alias("mse"))
    summary = fold_mse.groupBy("target", "k").agg(
        F.avg("mse").alias("mse"), (F.stddev_samp("mse") / F.sqrt(F.count(F.lit(1)))).alias("se")
    ).withColumn("target", F.when(F.col("target") == "a", F.lit(a)).otherwise(F.lit(b)))
    # one-standard-error rule within each target (<= len(ks) rows per target)
    w = Window.partitionBy("target")
    best = summary.withColumn("_min", F.min("mse").over(w)).withColumn(
        "_se_at_min", F.min(F.when(F.col("mse") == F.col("_min"), F.col("se"))).over(w)
    )
    ok = F.col("mse") <= F.col("_min") + F.col("_se_at_min")
    chosen = best.withColumn("_kmax_ok", F.max(F.when(ok, F.col("k"))).over(w))
    return chosen.select("target", "k", "mse", "se", (F.col("k") == F.col("_kmax_ok")).alias("chosen"))


def fill_median(df: DataFrame, medians: dict) -> DataFrame:
    """Nulls (and +-inf) of each column -> its median (a fitted value)."""
    return df.withColumns(
        {
            c: F.when(F.col(c).isNull() | F.col(c).isin(float("inf"), float("-inf")), F.lit(m)).otherwise(F.col(c))
            for c, m in medians.items()
        }
    )
