"""Column functions on hand-made rows: cleaners, null rules, bins, score."""

import pytest
from pyspark.sql import functions as F

from firmscope.config import ENTITY_MAP_EVALUATOR, ENTITY_MAP_FEATURE, ENTITY_MAP_IMPUTE
from firmscope.functions import clean as C
from firmscope.functions import features as FE
from firmscope.functions import scoring as S


def one(spark, expr, value, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("o")).first()["o"]


@pytest.mark.parametrize(
    "raw,expected",
    [("$1,234.5", 1234.5), ("-5", 5.0), ("1e6", 16.0), ("1.2.3", None), ("abc", None), ("", None), (".", None), (None, None), ("0", 0.0)],
)
def test_clean_numeric(spark, raw, expected):
    assert one(spark, C.clean_numeric("v"), raw) == expected


@pytest.mark.parametrize("raw,expected", [("1,500", 1500.0), (" -5 ", -5.0), ("$7", None), ("1e3", 1000.0), (None, None)])
def test_clean_number_strict(spark, raw, expected):
    assert one(spark, C.clean_number_strict("v"), raw) == expected


@pytest.mark.parametrize("raw,expected", [("Yes", 1), ("TRUE", 1), ("1", 1), ("1.0", 0), ("no", 0), (None, 0)])
def test_clean_boolean(spark, raw, expected):
    assert one(spark, C.clean_boolean("v"), raw) == expected


def test_entity_maps(spark):
    df = spark.createDataFrame([(x,) for x in ["Headquarters", "Parent", "Single Location", "Subsidiary", "Branch", "Other", None]], "v string")
    imp = [r[0] for r in df.select(C.entity_ordinal("v", ENTITY_MAP_IMPUTE)).collect()]
    feat = [r[0] for r in df.select(C.entity_ordinal("v", ENTITY_MAP_FEATURE)).collect()]
    ev = [r[0] for r in df.select(C.entity_ordinal("v", ENTITY_MAP_EVALUATOR)).collect()]
    assert imp == [4, 3, 3, 2, 1, 1, 1]
    assert feat == [1, 3, 1, 2, 1, 1, 1]
    assert ev == [3, 3, 3, 2, 1, 1, 1]


def test_missing_and_log(spark):
    df = spark.createDataFrame([(0.0,), (None,), (9.0,)], "v double")
    rows = df.select(C.is_missing(F.col("v")).alias("m"), C.zero_to_null_log1p(F.col("v")).alias("l")).collect()
    assert [r.m for r in rows] == [True, True, False]
    assert rows[0].l is None and rows[1].l is None and abs(rows[2].l - 2.302585092994046) < 1e-12


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (900.0,), (50.0,)], "v double")
    got = [r[0] for r in df.select(C.null_guarded_clip(F.col("v"), 0.0, 200.0)).collect()]
    assert got == [None, 0.0, 200.0, 50.0]


def test_sic2_and_ratio(spark):
    assert one(spark, FE.sic2(F.col("v")), None) == "na"
    assert one(spark, FE.sic2(F.col("v")), "5812") == "58"
    df = spark.createDataFrame([(10.0, 0.0), (10.0, None), (10.0, 4.0)], "a double, b double")
    got = [r[0] for r in df.select(FE.it_spend_per_employee(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 0.0, 2.5]
    got = [r[0] for r in df.select(FE.revenue_per_employee(F.col("a"), F.col("b"), "one")).collect()]
    assert got == [10.0, None, 2.5]


def test_vs_industry(spark):
    df = spark.createDataFrame([(300.0, 100.0), (1000.0, 100.0), (0.0, 100.0), (5.0, 0.0), (5.0, None), (None, 10.0)], "v double, m double")
    got = [r[0] for r in df.select(FE.vs_industry(F.col("v"), F.col("m"))).collect()]
    assert got == [200.0, 500.0, -100.0, 0.0, 0.0, None]


@pytest.mark.parametrize(
    "score,pipeline,evaluator,dashboard",
    [(0.0, None, "Cold", "Cold"), (30.0, "Cold", "Warm", "Warm"), (30.5, "Warm", "Warm", "Warm"), (50.0, "Warm", "Hot", "Hot"),
     (70.0, "Hot", "Hot", "Priority"), (75.0, "Hot", "Priority", "Priority"), (75.5, "Priority", "Priority", "Priority"), (100.0, "Priority", "Priority", "Priority")],
)
def test_tier_rules(spark, score, pipeline, evaluator, dashboard):
    df = spark.createDataFrame([(score,)], "s double")
    r = df.select(*[S.lead_tier(F.col("s"), rule).alias(rule) for rule in ("pipeline", "evaluator", "dashboard")]).first()
    assert (r.pipeline, r.evaluator, r.dashboard) == (pipeline, evaluator, dashboard)


def test_lead_score_sample_row(spark):
    """Sample new company: revenue 15M, 50 employees, Parent, founded 2010,
    domestic ultimate; no IT spend or market value; completeness 4/7.
    25 + 15 + 0 + 0 + 0 + 5 (age 16) = 45 -> Warm (evaluator bins)."""
    df = spark.createDataFrame([(15e6, 1, 3.0, 15e6 / 50, 0.0, 0.0, 16.0, 4 / 7)],
                               "rev double, du int, es double, rpe double, it double, mv double, age double, comp double")
    s = df.select(S.lead_score_v2(*[F.col(c) for c in df.columns]).alias("s")).first()["s"]
    assert s == 45.0
    assert df.select(S.lead_tier(F.lit(s), "evaluator")).first()[0] == "Warm"


def test_lead_score_penalty_and_bounds(spark):
    df = spark.createDataFrame([(2e8, 0, 3.0, 6e5, 2000.0, 1.0, 5.0, 0.4), (None, 0, 1.0, None, 0.0, 0.0, None, 1.0)],
                               "rev double, du int, es double, rpe double, it double, mv double, age double, comp double")
    got = [r[0] for r in df.select(S.lead_score_v2(*[F.col(c) for c in df.columns])).collect()]
    assert got[0] == pytest.approx((35 + 9 + 10 + 10 + 15 + 10) * 0.8)
    assert got[1] == 3.0  # minimum: entity 1 x 3


def test_risk_rules_null_safe(spark):
    df = spark.createDataFrame([("Subsidiary", 0, 2e5, True, 0.3), (None, 0, None, True, None), ("Subsidiary", 1, 50.0, False, 0.9)],
                               "et string, hp int, rev double, em boolean, comp double")
    rows = df.select(
        S.risk_orphan_sub(F.col("et"), F.col("hp")).alias("o"), S.risk_shell(F.col("rev"), F.col("em")).alias("s"),
        S.risk_data_quality(F.col("comp")).alias("q"),
    ).collect()
    assert [(r.o, r.s, r.q) for r in rows] == [(True, True, True), (False, False, False), (False, False, False)]


def test_risk_flag_list(spark):
    df = spark.createDataFrame([(True, False, True, False), (False, False, False, False)], "a boolean, b boolean, c boolean, d boolean")
    cols = {"risk_shell": F.col("a"), "risk_data_quality": F.col("b"), "risk_orphan_sub": F.col("c"), "is_anomaly": F.col("d")}
    got = [r[0] for r in df.select(S.risk_flag_list(cols)).collect()]
    assert got[0] == ["Shell Company Risk (high revenue, zero employees)", "Orphan Subsidiary (no parent linkage)"]
    assert got[1] == ["No risk flags detected"]
