"""Physical-plan properties: no cross joins anywhere; region filters prune
partitions and value filters reach the parquet scan; top-k is a TakeOrdered."""

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins(spark):
    import __spark_entry__ as E

    bad = {}
    for name, fn in E.queries().items():
        plan = _plan(fn(spark, SF_SMALL))
        hits = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad


def test_pruning_and_pushdown(spark):
    import __spark_entry__ as E

    q = E.queries()
    plan = _plan(q["sidebar_anomalies"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(region" in plan and "PushedFilters: [IsNotNull(anomaly_label)" in plan
    plan = _plan(q["market_summary"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(region" in plan and "GreaterThanOrEqual(revenue_clean,100000.0)" in plan
    plan = _plan(q["top_leads"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan
