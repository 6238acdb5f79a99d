"""Statistical validation (V1–V7): Welch test, adjusted Rand index, bootstrap
stability of the segmentation, cluster predictor and permutation importance."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmscope.functions.portable import hash52, unit
from firmscope.operators import lloyd
from firmscope.session import Scratch, cut_lineage


# ------------------------------------------------------------------ V1
def welch_ttest(df: DataFrame, group: str, a: str, b: str, value) -> DataFrame:
    """t and Welch–Satterthwaite degrees of freedom of ``value`` between
    groups ``a`` and ``b`` (unequal variances): one conditional aggregation."""
    base = df.filter(F.col(group).isin(a, b)).withColumn("_v", value)
    in_a, in_b = F.col(group) == a, F.col(group) == b
    m = base.agg(
        F.count(F.when(in_a, F.col("_v"))).alias("na"), F.count(F.when(in_b, F.col("_v"))).alias("nb"),
        F.avg(F.when(in_a, F.col("_v"))).alias("mean_a"), F.avg(F.when(in_b, F.col("_v"))).alias("mean_b"),
        F.var_samp(F.when(in_a, F.col("_v"))).alias("va"), F.var_samp(F.when(in_b, F.col("_v"))).alias("vb"),
    )
    sa, sb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    return m.select(
        F.lit(a).alias("group_a"), F.lit(b).alias("group_b"), "na", "nb", "mean_a", "mean_b",
        ((F.col("mean_a") - F.col("mean_b")) / F.sqrt(sa + sb)).alias("t"),
        ((sa + sb) * (sa + sb) / (sa * sa / (F.col("na") - 1) + sb * sb / (F.col("nb") - 1))).alias("df"),
    )


def t_two_sided_p(t, dof):
    """Two-sided p-value of Student's t as a Column: the density from |t| on
    over the density from 0 on. With x = |t| + exp(w) both integrands fall off
    doubly exponentially, where equal steps of w are exact to rounding. Null
    without a positive number of degrees of freedom."""
    steps = F.transform(F.sequence(F.lit(-T_STEPS), F.lit(T_STEPS)), lambda i: F.exp(i * F.lit(T_STEP)))

    def beyond(start):
        density = lambda x: F.exp(-(dof + 1.0) / 2.0 * F.log1p(x * x / dof))
        return F.aggregate(steps, F.lit(0.0), lambda s, w: s + density(start + w) * w)

    return F.when(dof > 0, beyond(F.abs(t)) / beyond(F.lit(0.0)))


#: Steps of w on each side of 0, and their size.
T_STEPS, T_STEP = 900, 0.05


def welch_with_p(df: DataFrame, group: str, a: str, b: str, value) -> DataFrame:
    """Welch test plus the two-sided p-value (one row)."""
    w = welch_ttest(df, group, a, b, value)
    return w.withColumn("p_value", t_two_sided_p(F.col("t"), F.col("df")))


# ------------------------------------------------------------------ V3
def adjusted_rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """ARI of two labelings from the contingency table (all aggregates;
    nothing leaves the executors)."""
    base = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return ari_of_counts(base.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n")))


def ari_of_counts(counts: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, n, ari) of contingency tables (by, a, b, n), one for each ``by``."""
    pairs = lambda c: c * (c - 1) / 2.0
    # each kind of sum is a grouping of the same counts: cells, rows and columns
    kinds = F.inline(F.array(*[F.struct(F.lit(i).alias("kind"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate([
        (F.col("a").cast("string"), F.col("b").cast("string")), (F.col("a").cast("string"), F.lit(None).cast("string")), (F.lit(None).cast("string"), F.col("b").cast("string"))])]))
    sums = counts.select(*by, "n", kinds).groupBy(*by, "kind", "x", "y").agg(F.sum("n").alias("n"))
    total = lambda i, v: F.sum(F.when(F.col("kind") == i, v))
    j = sums.groupBy(*by).agg(total(0, F.col("n")).alias("n"), total(0, pairs(F.col("n"))).alias("sij"), total(1, pairs(F.col("n"))).alias("sa"), total(2, pairs(F.col("n"))).alias("sb"))
    expected = F.col("sa") * F.col("sb") / pairs(F.col("n"))
    max_index = (F.col("sa") + F.col("sb")) / 2.0
    ari = F.when(max_index == expected, F.lit(1.0)).otherwise((F.col("sij") - expected) / (max_index - expected))
    return j.select(*by, "n", ari.alias("ari"))


# ------------------------------------------------------------------ V2, V7
def bootstrap_ari(df: DataFrame, id_col: str, cols: list, base_col: str, runs: int = 20, k: int = 5, starts: int = 5, seed: int = 42) -> DataFrame:
    """Resample with replacement (Poisson(1) row weights, no row copies),
    refit k-means, relabel the original rows, ARI vs the base labels. All runs
    and starts advance in the same scans. Returns (run, ari)."""
    with Scratch(df.sparkSession) as scratch:
        pts = lloyd.points(df, id_col, cols, (base_col,), seed, scratch)
        fits = lloyd.fit(pts, [lloyd.Replica(k, s, run) for run in range(runs) for s in range(starts)], seed)
        chosen = [lloyd.best([f for f in fits if f.replica.run == run]) for run in range(runs)]
        counts = cut_lineage(lloyd.contingency(pts, base_col, chosen), "bootstrap-counts")  # runs x k x k rows
    return ari_of_counts(counts, ("fit",)).select(F.col("fit").alias("run"), "ari")


# ------------------------------------------------------------------ V4, V5, V6
def hashed_split(df: DataFrame, id_col: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(about ``share`` of the rows, the rest) by a portable hash of the id."""
    first = unit(F.col(id_col), F.lit(seed)) < share
    return df.filter(first), df.filter(~first)


def cluster_predictor(df: DataFrame, features: list, label: str, id_col: str, seed: int = 42, trees: int = 50, depth: int = 30):
    """70/30 split, random forest, accuracy on the test part. Returns
    (model, test DataFrame with features, accuracy). Trees grow until their
    leaves are pure, at most ``depth`` levels (30 is the most MLlib allows)."""
    vec = VectorAssembler(inputCols=features, outputCol="features").transform(df).withColumn("label", F.col(label).cast("double"))
    train, test = hashed_split(vec, id_col, 0.7, seed)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features").fit(train)
    acc = accuracy(model.transform(test))
    return model, test, acc


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction, metricName="accuracy").evaluate(pred)


#: Rows that one slice of a hash bucket, and one task of the permutation's sorts, holds on average.
SLICE_ROWS, TASK_ROWS = 50_000, 500_000


def hashed_rank(df: DataFrame, by: list, id_col: str, buckets: int, seed: int, name: str, slices: int = 1, tasks: int | None = None) -> DataFrame:
    """Rank (from 1) of every row within ``by`` in the order of a hash of the
    id: rows are numbered inside hash buckets and the sizes of the earlier
    buckets (groups x buckets numbers) are added. ``slices`` cuts each bucket
    into as many ranges of the hash, which leaves the order as it is;
    ``tasks`` is the number of tasks that sort them."""
    dealt = df.withColumn("_h", hash52(F.col(id_col), *[F.col(c) for c in by], F.lit(seed))).withColumns({
        "_b": F.pmod("_h", F.lit(buckets)), "_s": F.floor(F.col("_h") / F.lit(float(1 << 52)) * slices)})
    cells = [*by, "_b", "_s"]
    sorted_by = dealt if tasks is None else dealt.repartition(tasks, *cells)
    local = sorted_by.withColumn("_n", F.row_number().over(Window.partitionBy(*cells).orderBy("_h", id_col)))
    sizes = dealt.groupBy(*cells).agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*by).orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*cells, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_start"))
    return local.join(starts, cells).withColumn(name, F.col("_start") + F.col("_n")).drop("_h", "_b", "_s", "_n", "_start")


def permutation_importance(model, test: DataFrame, features: list, id_col: str, repeats: int = 5, seed: int = 42, rows_per_bucket: int = 200_000) -> DataFrame:
    """Mean accuracy drop when one column is shuffled over the whole test set.

    All (feature, repeat) variants run in one pass: each has its own hashed
    order of the rows, and the row at rank r of the plain order takes the value
    of the row at rank r of the variant's order. The orders are those of a
    portable hash of the id, whatever the file layout. The number of tasks
    follows the rows of all variants, so that a task's sorts and predictions
    stay at about TASK_ROWS rows at every size."""
    base = cut_lineage(test.select(*features, "label", F.col(id_col).alias("_rid")), "perm-test")
    n = base.count()
    buckets = max(8, n // rows_per_bucket + 1)
    slices = n // buckets // SLICE_ROWS + 1
    tasks = max(8, n * len(features) * repeats // TASK_ROWS + 1)
    of_variant = F.floor(F.col("_var") / repeats)
    donors = base.select("_rid", F.explode(F.sequence(F.lit(0), F.lit(len(features) * repeats - 1))).alias("_var"), *features)
    value = F.element_at(F.array(*[F.col(f).cast("double") for f in features]), (of_variant + 1).cast("int"))
    donors = hashed_rank(donors.select("_rid", "_var", value.alias("_v")), ["_var"], "_rid", buckets, seed, "_rank", slices, tasks).select("_var", "_rank", "_v")
    plain = hashed_rank(base.withColumn("_all", F.lit(-1)), ["_all"], "_rid", buckets, seed, "_rank", slices).select("_rank", "label", *features)
    # every rank has one donor of each variant: the plain rows are copied by the join alone
    rows = plain.repartition(tasks, "_rank").join(donors.repartition(tasks, "_rank"), "_rank")
    mixed = rows.select("_var", "label", *[F.when(of_variant == i, F.col("_v")).otherwise(F.col(f)).alias(f) for i, f in enumerate(features)])
    own = base.select(F.lit(-1).alias("_var"), "label", *features)
    scored = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(mixed.unionByName(own)))
    right = {r["_var"]: r["acc"] for r in scored.groupBy("_var").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("acc")).collect()}
    rows = []
    for i, f in enumerate(features):
        drops = [right[-1] - right[i * repeats + r] for r in range(repeats)]
        rows.append((f, sum(drops) / len(drops), min(drops), max(drops)))
    return test.sparkSession.createDataFrame(
        rows, "feature string, importance_mean double, importance_min double, importance_max double").orderBy("importance_mean")
