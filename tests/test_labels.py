"""Segments, anomalies, reports and pair lookups on deterministic labels."""

import numpy as np
import pytest
from conftest import SF_SMALL
from oracle_harness import compare
from pyspark.sql import functions as F

import __spark_entry__ as E

LABELLED = sorted(n for n in E.oracle_sql() if n.startswith("labelled_"))


@pytest.mark.parametrize("name", LABELLED)
def test_labelled_query_matches_sql(spark, name):
    res = compare(E.queries()[name](spark, SF_SMALL), E.oracle_sql()[name], SF_SMALL)
    assert res["ok"], res


def test_nearest_centre_matches_numpy_and_breaks_ties_low(spark):
    from firmscope.operators.segment import kmeans_assign

    rng = np.random.default_rng(3)
    points, centres = rng.normal(size=(500, 3)), rng.normal(size=(6, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, x double, y double, z double")
    got = {r["id"]: r["cluster"] for r in kmeans_assign(df, ["x", "y", "z"], centres).collect()}
    want = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [got[i] for i in range(500)] == want.tolist()
    tie = spark.createDataFrame([(0.0,)], "x double")
    assert kmeans_assign(tie, ["x"], [(1.0,), (-1.0,), (1.0,)]).first()["cluster"] == 0


@pytest.fixture
def small_shares(monkeypatch):
    from firmscope.operators import stats

    monkeypatch.setattr(stats, "ROWS_PER_SHARE", 100)


def test_lookup_of_a_hot_key_is_dealt_over_shares(spark, small_shares):
    from firmscope.operators.stats import attach_by_key

    rows = spark.range(5000).select("id", F.when(F.col("id") < 3000, F.lit(7)).otherwise(F.col("id")).alias("k"))
    lookup = spark.range(0, 6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).filter("k <> 4999")
    out = attach_by_key(rows, lookup, ["k"], ["id"])
    assert out.count() == 4999 and out.filter("v <> 2 * k").count() == 0
    left = attach_by_key(rows, lookup, ["k"], ["id"], "left")
    assert left.count() == 5000 and left.filter("v is null").select("id").first()["id"] == 4999


def test_pairs_plan_has_no_join_on_a_hot_id_alone(spark, small_shares):
    from firmscope.operators.queries import pair_columns

    df = spark.range(1000).select(F.col("id").alias("company_id"), F.col("id").cast("double").alias("m"))
    pairs = spark.range(1, 1000).select(F.col("id").alias("id_a"), (F.col("id") % 2).alias("id_b")).filter("id_a <> id_b")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pair_columns(df, pairs, ["m"])
        assert out.filter("a_m <> id_a or b_m <> id_b").count() == 0 and out.count() == pairs.count()
        joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
        # rows are joined by (id, share) alone; the joins by the bare id have the broadcast list of hot ids on their right
        assert sum("_share" in j.split("(")[1].split(")")[0] or "_share#" in j for j in joins) >= 2
        assert sum("rightHint=(strategy=broadcast)" in j for j in joins) == 4 and len(joins) == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_column_without_donors_takes_its_mean(spark):
    from firmscope.operators.impute import knn_impute

    df = spark.createDataFrame([(1, 2.0, None, 1.0), (2, None, None, 1.0)], "id int, a double, b double, o double")
    out, scaler = knn_impute(df, "id", "a", "b", "o", [1.0, 2.0])
    rows = {r["id"]: r for r in out.collect()}
    assert rows[2]["imp_a"] == 2.0 and rows[1]["imp_b"] == scaler["b"][0]


def test_range_histogram_covers_negative_and_equal_values(spark):
    from firmscope.operators.queries import range_histogram

    df = spark.createDataFrame([(v,) for v in (-0.02, 0.0, 0.5, 0.98)], "v double")
    assert sorted((r["bin"], r["n"]) for r in range_histogram(df, "v", 10).collect()) == [(0, 2), (5, 1), (9, 1)]
    same = spark.createDataFrame([(0.4,), (0.4,)], "v double")
    assert [(r["bin"], r["n"]) for r in range_histogram(same, "v").collect()] == [(0, 2)]


def test_spec_reply_gives_a_market_filter(spark):
    from firmscope.operators.queries import MarketSpec, market_spec
    from firmscope.operators.report import SPEC_REPLY_SCHEMA, parse_responses

    replies = spark.createDataFrame([
        ("a", '{"region": "ASIA", "industry_keywords": ["steel"], "target_tiers": [1, 2], "min_revenue": 5, "country": null}'),
        ("b", "Error: no answer"), ("c", "not json"), ("d", None)], "id string, reply string")
    got = {r["id"]: r for r in parse_responses(replies, schema=SPEC_REPLY_SCHEMA).collect()}
    assert market_spec(got["a"]["parsed"].asDict()) == MarketSpec(
        region="ASIA", industry_keywords=("steel",), target_tiers=(1, 2), min_revenue=5.0)
    assert [got[i]["parsed"] for i in "bcd"] == [None] * 3 and got["c"]["error"] == "unparsable reply"


def test_hashed_rank_is_a_permutation_whatever_the_buckets(spark):
    from firmscope.operators.validate import hashed_rank

    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    for buckets in (1, 8):
        out = hashed_rank(df, ["g"], "id", buckets, 5, "r").collect()
        for g in (0, 1):
            ranks = [r["r"] for r in sorted(out, key=lambda r: r["id"]) if r["g"] == g]
            assert sorted(ranks) == list(range(1, 501)) and ranks != sorted(ranks)


def test_permutation_importance_finds_the_feature_in_use(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from firmscope.operators.validate import permutation_importance

    df = spark.range(2000).select("id", F.hash("id").cast("double").alias("h")).select(
        "id", ((F.col("h") % 100) / 100).alias("used"), ((F.floor(F.col("h") / 1000) % 100) / 100).alias("idle")).withColumn(
        "label", (F.col("used") > 0).cast("double"))
    model = LogisticRegression().fit(VectorAssembler(inputCols=["used", "idle"], outputCol="features").transform(df))
    got = {r["feature"]: r["importance_mean"] for r in permutation_importance(model, df, ["used", "idle"], "id", repeats=3).collect()}
    assert got["used"] > 0.4 and abs(got["idle"]) < 0.05


def test_slices_leave_the_hashed_order_as_it_is(spark):
    from firmscope.operators.validate import hashed_rank

    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    whole, cut = (sorted((r["id"], r["r"]) for r in hashed_rank(df, ["g"], "id", 8, 5, "r", slices, tasks).collect()) for slices, tasks in ((1, None), (7, 5)))
    assert whole == cut


def test_permuted_rows_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    from firmscope.operators import validate as V

    class Model:
        def transform(self, df):
            sizes = df.groupBy(F.spark_partition_id().alias("p"), "_var").count().groupBy("p").agg(F.sum(F.when(F.col("_var") >= 0, F.col("count"))).alias("n"))
            self.most, self.rows = sizes.agg(F.max("n"), F.sum("n")).first()
            return df.withColumn("prediction", (F.col("used") > 0.5).cast("double"))

    monkeypatch.setattr(V, "TASK_ROWS", 1000)
    monkeypatch.setattr(V, "SLICE_ROWS", 20)
    df = spark.range(3000).select("id", (F.abs(F.hash("id")) % 100 / 100).alias("used"), F.lit(1.0).alias("idle")).withColumn("label", (F.col("used") > 0.5).cast("double"))
    model = Model()
    got = {r["feature"]: r["importance_mean"] for r in V.permutation_importance(model, df, ["used", "idle"], "id", repeats=3).collect()}
    assert model.rows == 18000 and model.most <= 3000  # one task held the copies of a whole bucket or table
    assert got["used"] > 0.4 and got["idle"] == 0


def test_nearest_centres_equal_the_full_distances_also_on_ties():
    import numpy as np

    from firmscope.operators import lloyd

    rng = np.random.default_rng(5)
    q = np.rint(rng.normal(size=(3000, 6)) * lloyd.UNIT)
    centres = np.rint(rng.normal(size=(100, 5, 6)) * lloyd.UNIT)
    centres[::7, 3] = centres[::7, 1]  # the same centre twice
    q[:50, 0] = 0
    centres[1, 2], centres[1, 4] = centres[1, 0] * [-1, 1, 1, 1, 1, 1], centres[1, 0]  # mirrored: as far from rows at 0
    assert (lloyd._nearest(q, centres) == lloyd._distances(q, centres).argmin(axis=2)).all()


def test_boosted_trees_are_walked_by_node():
    import numpy as np

    from firmscope.operators import boosting as B

    rng = np.random.default_rng(2)
    tree = B.Tree(rng.integers(-1, 5, 16), rng.integers(0, B.BINS, 16), np.zeros(16))
    tree.feature[1] = 2
    tree.feature[8:] = -1
    bins = rng.integers(0, B.BINS, (500, 5))
    for levels in range(4):
        for row, got in zip(bins, B.walk(tree, bins, levels)):
            at = 1
            for _ in range(levels):
                if tree.feature[at] >= 0:
                    at = 2 * at + (row[tree.feature[at]] > tree.last[at])
            assert at == got
