"""Operators against brute force and properties: exact kNN imputation,
exact quantiles, partition invariance, isolation forest,
adjusted Rand index, Welch p-value."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from firmscope.functions.portable import hash52
from firmscope.operators import iforest as IF
from firmscope.operators import impute as I
from firmscope.operators import stats as ST
from firmscope.operators import validate as V
from firmscope.plans import pipeline as P
from firmscope.sources.companies import read_tables


def brute_knn(ids, a, b, o, k=5):
    """NaN-Euclidean kNN imputation over standardised (a, b, o), ties by id."""
    X = np.column_stack([a, b, o]).astype(float)
    mu, sd = np.nanmean(X, axis=0), np.nanstd(X, axis=0)
    sd[sd == 0] = 1.0
    Z = (X - mu) / sd
    out = X.copy()
    for col in (0, 1):
        donors = np.flatnonzero(~np.isnan(X[:, col]))
        for r in np.flatnonzero(np.isnan(X[:, col])):
            diff = Z[donors] - Z[r]
            present = ~np.isnan(diff)
            d2 = np.where(present, diff * diff, 0.0).sum(axis=1) * 3.0 / present.sum(axis=1)
            order = np.lexsort((ids[donors], d2))[:k]
            out[r, col] = X[donors[order], col].mean()
    return out


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_knn_matches_brute_force(spark, sf):
    df = P.clean_stage(read_tables(spark, sf))
    groups = [1, 2, 3, 4]
    out, _ = I.knn_impute(df, "company_id", "log_rev_in", "log_emp_in", "entity_ord", groups, 5, 8)
    got = out.select("company_id", "imp_log_rev_in", "imp_log_emp_in").toPandas().sort_values("company_id")
    src = df.select("company_id", "log_rev_in", "log_emp_in", "entity_ord").toPandas().sort_values("company_id")
    exp = brute_knn(src.company_id.to_numpy(), src.log_rev_in.to_numpy(dtype=float), src.log_emp_in.to_numpy(dtype=float), src.entity_ord.to_numpy(dtype=float))
    np.testing.assert_allclose(got.imp_log_rev_in.to_numpy(dtype=float), exp[:, 0], rtol=1e-12)
    np.testing.assert_allclose(got.imp_log_emp_in.to_numpy(dtype=float), exp[:, 1], rtol=1e-12)


def test_knn_partition_invariant(spark):
    df = P.clean_stage(read_tables(spark, SF_MID))
    a, _ = I.knn_impute(df, "company_id", "log_rev_in", "log_emp_in", "entity_ord", [1, 2, 3, 4], 5, 1)
    b, _ = I.knn_impute(df.repartition(13), "company_id", "log_rev_in", "log_emp_in", "entity_ord", [1, 2, 3, 4], 5, 16)
    pa = a.select("company_id", "imp_log_rev_in", "imp_log_emp_in").toPandas().sort_values("company_id").reset_index(drop=True)
    pb = b.select("company_id", "imp_log_rev_in", "imp_log_emp_in").toPandas().sort_values("company_id").reset_index(drop=True)
    assert pa.equals(pb)


@pytest.mark.parametrize("sort_rows", [None, 40])
def test_quantiles_match_pandas(spark, sort_rows):
    """One dominant group, 60 % ties, negative, tiny and missing values, a null group and a group without values."""
    rng = np.random.default_rng(3)
    n = 30_000
    v = np.where(rng.random(n) < 0.6, 7.0, rng.normal(0, 1, n) * 10.0 ** rng.integers(-8, 9, n))
    v = np.where(rng.random(n) < 0.05, np.nan, v)
    g = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 6, n))
    rows = [(None if int(b) == 5 else int(b), None if (np.isnan(x) or b == 4) else float(x), float(i)) for i, (x, b) in enumerate(zip(v, g))]
    df = spark.createDataFrame(rows, "g int, v double, w double").repartition(8).cache()
    pdf = pd.DataFrame(rows, columns=["g", "v", "w"])
    for p in (0.0, 0.05, 0.5, 0.75, 1.0) if sort_rows is None else (0.05, 1.0):
        got = ST.quantiles(df, ["v", "w"], ["g"], p, ["qv", "qw"], aggs=[F.count("v").alias("n")], sort_rows=sort_rows).toPandas().set_index("g").sort_index()
        want = pdf.groupby("g", dropna=False)[["v", "w"]].quantile(p).sort_index()
        np.testing.assert_allclose(got[["qv", "qw"]].to_numpy(), want.to_numpy(), rtol=1e-12)
        assert got.n.tolist() == pdf.groupby("g", dropna=False).v.count().sort_index().tolist()
    row = ST.quantiles(df, ["v"], (), [0.25, 0.5], ["a", "b"], aggs=[F.count("v").alias("n")], sort_rows=sort_rows).first()
    assert row.n == pdf.v.count()
    np.testing.assert_allclose([row.a, row.b], pdf.v.quantile([0.25, 0.5]).to_numpy(), rtol=1e-12)
    empty = ST.quantiles(df.filter("false"), ["v"], (), 0.5, ["a"]).collect()
    assert [r.a for r in empty] == [None]


def test_quantile_reads_the_table_once_when_it_is_small(spark, tmp_path):
    spark.range(1000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).alias("g"), F.lit(1).alias("unused")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = ST.quantiles(df, ["v"], ["g"], 0.5, ["q"], aggs=[F.count(F.lit(1)).alias("n")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "unused" not in plan


def test_quantile_narrows_close_values_with_a_pushed_range(spark, tmp_path, monkeypatch):
    """All values within a hundredth of a per cent of each other: no range of
    more than ``sort_rows`` rows is left to order, every pass after the first has its
    bounds pushed into the scan, and no pass orders rows of the table."""
    spark.range(50_000).select((0.5 + F.col("id") * 1e-9).alias("v")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    seen = []
    cut = ST.cut_lineage

    def spy(frame, name="stage", partition_by=None):
        seen.append((name, frame._jdf.queryExecution().executedPlan().toString()))
        return cut(frame, name, partition_by)

    monkeypatch.setattr(ST, "cut_lineage", spy)
    base, held = ST._narrowed(df, [F.col("v")], [], F.array(F.struct(
        F.lit(0).alias("_t"), F.lit(0).alias("_tj"), F.lit(0).alias("_side"), F.lit(31_234).cast("long").alias("_k"), F.lit(0.0).alias("_frac"))), 20)
    row = held.filter("_t is not null").first()
    assert 0 < row["_n"] <= 20 and row["_lo"] <= 0.5 + 31_234e-9 <= row["_hi"]
    passes = [p for name, p in seen if name == "quantile-ranges"][1:]
    assert 1 <= len(passes) <= 3
    for plan in passes:
        assert "GreaterThanOrEqual(v," in plan and "LessThanOrEqual(v," in plan and "TakeOrdered" not in plan and "rangepartitioning" not in plan


def test_page_near_the_end_sorts_only_its_range(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.integers(0, 50, 3000), rng.integers(10**6, 10**9, 3000)])
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "company_id long, v long").repartition(7)
    order = sorted(range(len(v)), key=lambda i: (v[i], i))
    for first, size in ((5950, 50), (0, 50), (2990, 40), (5990, 50), (1234, 7), (7000, 50)):
        rows, total = ST.rows_at(df, "v", first, size, "company_id", sort_rows=90)
        assert [r.company_id for r in rows.collect()] == order[first : first + size] and total == 6000


def test_forest_sample_does_not_depend_on_layout(spark):
    df = spark.range(60_000).withColumn("x", F.rand(1))
    parts = [IF.sample_trees(d.select("id"), "id", 100, 256, 42, 60_000).select("tree", "id") for d in (df, df.repartition(13))]
    a, b = (set(map(tuple, p.collect())) for p in parts)
    assert a == b and len(a) == 100 * 256


def test_smallest_k_per_group(spark):
    df = spark.range(0, 1000).withColumn("g", F.col("id") % 3)
    got = ST.smallest_k_per_group(df, ["g"], [F.col("id").desc()], 2).orderBy("g", "id").collect()
    assert [(r.g, r.id) for r in got] == [(0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998)]


def test_ari_properties(spark):
    rows = [(i, i % 3, (i % 3) * 10, (i // 3) % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a int, b int, c int")
    assert V.adjusted_rand_index(df, "a", "a").first()["ari"] == pytest.approx(1.0)
    assert V.adjusted_rand_index(df, "a", "b").first()["ari"] == pytest.approx(1.0)
    # hand case: labels (0,0,1,1) vs (0,0,1,2): index 1, expected 1*2/6 = 1/3, max 1.5 -> (1-1/3)/(1.5-1/3)
    hand = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "a int, b int")
    assert V.adjusted_rand_index(hand, "a", "b").first()["ari"] == pytest.approx((1 - 1 / 3) / (1.5 - 1 / 3))


def test_t_pvalue_known_values(spark):
    # two-sided Student t tail values: tabulated, and the closed forms of one and two degrees of freedom
    rows = [(2.228, 10.0, 0.05, 2e-4), (1.96, 1e6, 0.05, 2e-4), (0.0, 5.0, 1.0, 1e-12), (1.0, 1.0, 0.5, 1e-12), (-3.0, 1.0, 1 - 2 / math.pi * math.atan(3.0), 1e-12),
            (2.0, 2.0, 1 - 2 / math.sqrt(6.0), 1e-12), (40.0, 2.0, 1 - 40 / math.sqrt(1602.0), 1e-13), (60.0, 1e9, 0.0, 1e-300)]
    df = spark.createDataFrame([r[:2] for r in rows], "t double, dof double")
    for (t, dof, want, near), r in zip(rows, df.select(V.t_two_sided_p(F.col("t"), F.col("dof")).alias("p")).collect()):
        assert r.p == pytest.approx(want, abs=near), (t, dof)
    odd = spark.createDataFrame([(1.0, 0.0), (1.0, None), (None, 3.0)], "t double, dof double")
    assert [r.p for r in odd.select(V.t_two_sided_p(F.col("t"), F.col("dof")).alias("p")).collect()] == [None] * 3


def test_iforest_properties(spark):
    from firmscope.config import CLUSTER_FEATURES
    from firmscope.operators import iforest as IF
    from firmscope.operators.segment import cluster_matrix
    from firmscope.plans.results import prepared

    vec, _, _ = cluster_matrix(prepared(spark, SF_MID), CLUSTER_FEATURES)
    z = [f"z_{c}" for c in CLUSTER_FEATURES]
    nodes = IF.iforest_fit(vec, "company_id", z, 100, 256, 42).toPandas()
    assert nodes.tree.nunique() == 100
    again = IF.iforest_fit(vec.repartition(11), "company_id", z, 100, 256, 42).toPandas()
    key = ["tree", "node"]
    assert again.sort_values(key).reset_index(drop=True).equals(nodes.sort_values(key).reset_index(drop=True))
    leaves = nodes[nodes.feature < 0]
    assert (leaves.groupby("tree")["size"].sum() == 256).all()  # every sampled row ends in one leaf
    roots = nodes[nodes.node == 1]
    assert (roots["size"] == 256).all()
    assert nodes.depth.max() <= 8
    scored = IF.iforest_score(vec, nodes, z)
    thr = IF.anomaly_threshold(scored, 0.05)
    out = IF.anomaly_columns(scored, thr).select("iforest_s", "is_anomaly", *z).toPandas()
    assert out.iforest_s.between(0, 1).all()
    share = out.is_anomaly.mean()
    assert 0.04 <= share <= 0.06
    spread = np.abs(out[z].to_numpy()).max(axis=1)
    assert spread[out.is_anomaly.to_numpy()].mean() > spread[~out.is_anomaly.to_numpy()].mean()


def test_path_length_constants():
    from firmscope.operators.iforest import avg_path_length

    c = avg_path_length([0, 1, 2, 256])
    assert c[0] == 0 and c[1] == 0 and c[2] == 1
    assert c[3] == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_impute_cv_matches_brute_force(spark):
    from pyspark.sql import functions as F

    df = P.clean_stage(read_tables(spark, SF_SMALL))
    got = I.impute_cv(df, "company_id", "log_rev_in", "log_emp_in", "entity_ord", [1, 2, 3, 4], ks=(3, 5), folds=5, seed=42)
    got = got.toPandas().set_index(["target", "k"]).sort_index()
    src = df.select("company_id", "log_rev_in", "log_emp_in", "entity_ord",
                    F.pmod(hash52(F.col("company_id"), F.lit(42)), F.lit(5)).alias("fold")).toPandas()
    X = src[["log_rev_in", "log_emp_in", "entity_ord"]].to_numpy(dtype=float)
    ids = src.company_id.to_numpy()
    mu, sd = np.nanmean(X, axis=0), np.nanstd(X, axis=0)
    Z = (X - mu) / sd
    for col, name in ((0, "log_rev_in"), (1, "log_emp_in")):
        for k in (3, 5):
            mses = []
            for f in range(5):
                hold = np.flatnonzero((src.fold.to_numpy() == f) & ~np.isnan(X[:, col]))
                donors = np.flatnonzero((src.fold.to_numpy() != f) & ~np.isnan(X[:, col]))
                errs = []
                for r in hold:
                    zr = Z[r].copy()
                    zr[col] = np.nan
                    diff = Z[donors] - zr
                    present = ~np.isnan(diff)
                    d2 = np.where(present, diff * diff, 0.0).sum(axis=1) * 3.0 / present.sum(axis=1)
                    order = np.lexsort((ids[donors], d2))[:k]
                    errs.append((X[donors[order], col].mean() - X[r, col]) ** 2)
                mses.append(np.mean(errs))
            assert got.loc[(name, k), "mse"] == pytest.approx(np.mean(mses), rel=1e-9)


def test_knn_hot_key_matches_brute_force(spark):
    """A third of the rows share one employee value: long runs of equal keys
    must still give the k smallest-id donors at equal distance."""
    base = P.clean_stage(read_tables(spark, SF_MID))
    hot = base.withColumn(
        "log_emp_in", F.when((F.col("company_id") % 3 == 0) & F.col("log_emp_in").isNotNull(), F.lit(4.0)).otherwise(F.col("log_emp_in"))
    )
    out, _ = I.knn_impute(hot, "company_id", "log_rev_in", "log_emp_in", "entity_ord", [1, 2, 3, 4], 5, 8)
    got = out.select("company_id", "imp_log_rev_in", "imp_log_emp_in").toPandas().sort_values("company_id")
    src = hot.select("company_id", "log_rev_in", "log_emp_in", "entity_ord").toPandas().sort_values("company_id")
    exp = brute_knn(src.company_id.to_numpy(), src.log_rev_in.to_numpy(dtype=float), src.log_emp_in.to_numpy(dtype=float), src.entity_ord.to_numpy(dtype=float))
    np.testing.assert_allclose(got.imp_log_rev_in.to_numpy(dtype=float), exp[:, 0], rtol=1e-12)
    np.testing.assert_allclose(got.imp_log_emp_in.to_numpy(dtype=float), exp[:, 1], rtol=1e-12)


def test_replicas_equal_single_fits_and_plain_lloyd(spark):
    """All replicas of one call give what each gives alone, on any layout, and
    a fit is a fixed point of Lloyd's step on the same points."""
    from firmscope.operators import lloyd as L

    rng = np.random.default_rng(9)
    centres = rng.normal(0, 4, (4, 3))
    x = np.concatenate([c + rng.normal(0, 0.5, (100, 3)) for c in centres])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id int, x double, y double, z double")
    cols = ["x", "y", "z"]
    replicas = [L.Replica(4, 0), L.Replica(4, 1), L.Replica(2, 0), L.Replica(4, 0, 3)]
    pts = L.points(df, "id", cols)
    together = L.fit(pts, replicas)
    moved = L.points(df.repartition(5, "x"), "id", cols)
    for f, r in zip(together, replicas):
        alone = L.fit(moved, [r])[0]
        np.testing.assert_array_equal(alone.centres, f.centres)
        assert alone.iterations == f.iterations and alone.mean_cost == pytest.approx(f.mean_cost)
    best = L.best(together[:2])
    near = ((x[:, None] - best.centres[None]) ** 2).sum(axis=2)
    np.testing.assert_allclose(best.centres, [x[near.argmin(axis=1) == c].mean(axis=0) for c in range(4)], atol=0.02)
    assert best.cost == pytest.approx(near.min(axis=1).sum(), rel=1e-3)
    # silhouettes against the definition by squared distances between all pairs
    label = near.argmin(axis=1)
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    own = np.array([d2[i][label == label[i]].sum() / ((label == label[i]).sum() - 1) for i in range(len(x))])
    other = np.array([min(d2[i][label == c].mean() for c in range(4) if c != label[i]) for i in range(len(x))])
    assert L.silhouettes(pts, [best])[0] == pytest.approx(((other - own) / np.maximum(own, other)).mean(), abs=1e-3)


def test_poisson_weights_have_mean_and_variance_one(spark):
    from firmscope.operators import lloyd as L

    pts = L.points(spark.range(20_000).select("id", F.lit(0.0).alias("x")), "id", ["x"]).toPandas()
    w = L._weights(pts.a.to_numpy(), pts.b.to_numpy(), [L.Replica(1, 0, 0), L.Replica(1, 0, 1)], 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and abs(np.corrcoef(w.T)[0, 1]) < 0.03


def test_kmeans_of_odd_tables(spark):
    from firmscope.operators import lloyd as L

    few = L.points(spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 5.0)], "id int, x double"), "id", ["x"])
    f = L.fit(few, [L.Replica(5, 0)])[0]
    assert sorted(set(np.round(f.centres[:, 0], 6))) == [0.0, 5.0] and f.cost == 0
    assert L.fit(L.points(spark.createDataFrame([], "id int, x double"), "id", ["x"]), [L.Replica(2, 0)]) == []


@pytest.mark.parametrize("block", [4, 512])
def test_donor_index_answers_equal_brute_force(spark, monkeypatch, block):
    """New rows (missing either or both values, ids of stored rows again,
    repeated rows, keys below, above and between the stored ones) against
    every stored donor; with blocks of 4 the tree has several levels."""
    from firmscope.operators import donor_index as D

    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "PART_BLOCKS", 8 if block == 4 else 4096)
    rng = np.random.default_rng(11)
    n, groups = 900, [1.0, 2.0, 3.0]
    a, b = np.round(rng.normal(10, 3, n), 1), np.round(rng.normal(5, 2, n), 1)
    a[rng.random(n) < 0.2], b[rng.random(n) < 0.2] = np.nan, np.nan
    o = rng.choice(groups, n, p=[0.9, 0.09, 0.01])
    clean = lambda v: None if np.isnan(v) else float(v)
    schema = "company_id int, a double, b double, o double"
    stored = spark.createDataFrame([(i, clean(x), clean(y), float(z)) for i, (x, y, z) in enumerate(zip(a, b, o))], schema)
    _, scaler, make = I.knn_fit(stored, "company_id", "a", "b", "o", groups, 5, 8)
    index = make()
    assert index.depth == (0 if block == 512 else index.depth) and (block == 512 or index.depth >= 3)
    new = [(i, None, float(x), float(z)) for i, (x, z) in enumerate(zip(np.concatenate([rng.normal(5, 2, 60), [-99.0, 99.0, 5.0]]), rng.choice(groups, 63)))]
    new += [(i, float(x), None, float(z)) for i, (x, z) in enumerate(zip(rng.normal(10, 3, 40), rng.choice(groups, 40)))]
    new += [(5, None, None, 1.0), (5, None, None, 1.0), (6, None, None, 3.0), (7, 1.5, 2.5, 2.0)]
    windows = []
    cut = I.cut_lineage
    monkeypatch.setattr(I, "cut_lineage", lambda f, name="stage", **kw: windows.append((name, f._jdf.queryExecution().executedPlan().toString())) or cut(f, name, **kw))
    out = I.knn_apply(spark.createDataFrame(new, schema), index, "a", "b", "o", groups, scaler, 5)
    assert out.columns == ["company_id", "a", "b", "o", "imp_a", "imp_b"]
    got = sorted(tuple(r) for r in out.fillna(-1e9).collect())
    # the stored table is looked up, never put in order: one window, over the candidates
    assert [p.count("Window [") for name, p in windows if name == "knn-answers"] == [1] and "Window" not in out._jdf.queryExecution().executedPlan().toString()
    # one new key reads the folders around its block alone
    if block == 4:
        one = spark.createDataFrame([("a", 1.0, 0.0, 1.0, 0.1)], "tgt string, g double, rzo double, rg double, rkey double")
        plan = D.near_values(index, one, 5)._jdf.queryExecution().executedPlan().toString()
        filters = [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]]
        assert any("part#" in x and (" IN " in x or " = " in x) for x in filters), filters
    (ma, sa), (mb, sb), (mo, so) = scaler["a"], scaler["b"], scaler["o"]

    def imputed(row, col):
        if row[col + 1] is not None:
            return row[col + 1]
        x, mean, std, other = ((b, mb, sb, row[2]), (a, ma, sa, row[1]))[col]
        t = (a, b)[col]
        dzo = ((row[3] - o) / so) ** 2
        both = ~np.isnan(x) if other is not None else np.zeros(n, bool)
        d2 = np.where(both, 1.5 * (((other if other is not None else 0.0) - np.nan_to_num(x)) / std) ** 2 + 1.5 * dzo, 3.0 * dzo)
        d2 = np.where(np.isnan(t), np.inf, d2)
        return t[np.lexsort((np.arange(n), np.round(d2, 9)))[:5]].mean()

    want = sorted(tuple(-1e9 if v is None else v for v in r) + (imputed(r, 0), imputed(r, 1)) for r in new)
    np.testing.assert_allclose(np.array(got), np.array(want), rtol=1e-9)


def test_lookup_against_an_empty_index_takes_the_mean(spark):
    schema = "company_id int, a double, b double, o double"
    _, scaler, make = I.knn_fit(spark.createDataFrame([(1, None, 2.0, 1.0)], schema), "company_id", "a", "b", "o", [1.0], 5, 8)
    out = I.knn_apply(spark.createDataFrame([(2, None, 3.0, 1.0)], schema), make(), "a", "b", "o", [1.0], scaler, 5).first()
    assert out.imp_a == scaler["a"][0] and out.imp_b == 3.0


def test_boosting_round_equals_brute_force(spark):
    """One round of depth 2 for two targets against gradients, gains and leaf
    values worked out row by row on the binned table; the layout does not matter."""
    from firmscope.operators import boosting as B

    rng = np.random.default_rng(21)
    n = 400
    x, y = rng.normal(size=n), rng.integers(0, 5, n).astype(float)
    a = np.where(x > 0.3, "hi", np.where(y > 2, "mid", "lo"))
    b = np.where(x + y > 2, "yes", "no")
    df = spark.createDataFrame([(i, float(u) if i % 50 else None, float(v), str(p), str(q)) for i, (u, v, p, q) in enumerate(zip(x, y, a, b))], "id int, x double, y double, a string, b string")
    targets = {"a": ["lo", "mid", "hi"], "b": ["no", "yes"]}
    model = B.fit(df, "id", ["x", "y"], targets, rounds=1, depth=2)
    again = B.fit(df.repartition(7), "id", ["x", "y"], targets, rounds=1, depth=2)
    rows = df.select(B.binned(df, model).alias("bins"), "a", "b").collect()
    bins = np.array([r.bins for r in rows])
    slot = 0
    for t, classes in targets.items():
        label = np.array([r[t] for r in rows])
        for c in classes:
            p = 1 / len(classes)
            g, h = p - (label == c), np.full(n, p * (1 - p))
            g, h = np.rint(g * B.STEPS) / B.STEPS, np.rint(h * B.STEPS) / B.STEPS
            tree, other = model.trees[0][slot], again.trees[0][slot]
            for field in ("feature", "last", "value"):
                np.testing.assert_array_equal(getattr(tree, field), getattr(other, field))

            def grow(inside, heap, level):
                value = -g[inside].sum() / (h[inside].sum() + B.SMOOTHING)  # noqa: B023
                assert tree.value[heap] == pytest.approx(value, abs=1e-12)  # noqa: B023
                if level == 2:
                    return
                gains = {}
                for f in range(2):
                    for last in range(B.BINS - 1):
                        left = inside & (bins[:, f] <= last)
                        right = inside & ~left
                        if left.any() and right.any():
                            score = lambda m: g[m].sum() ** 2 / (h[m].sum() + B.SMOOTHING)  # noqa: B023, E731
                            gains[f, last] = score(left) + score(right) - score(inside)
                if not gains or max(gains.values()) <= 1e-9:
                    assert tree.feature[heap] == -1  # noqa: B023
                    return
                at = (int(tree.feature[heap]), int(tree.last[heap]))  # noqa: B023
                assert gains[at] == pytest.approx(max(gains.values()), abs=1e-9)
                left = inside & (bins[:, at[0]] <= at[1])
                grow(left, 2 * heap, level + 1)
                grow(inside & ~left, 2 * heap + 1, level + 1)

            grow(np.ones(n, bool), 1, 0)
            slot += 1
    assert B.accuracy(df, B.fit(df, "id", ["x", "y"], targets, rounds=12, depth=3, rate=0.5))["b"] > 0.95


def test_boosting_beats_one_against_the_rest(spark):
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import VectorAssembler

    from firmscope.config import TIER_LABELS
    from firmscope.operators import boosting as B
    from firmscope.plans.results import prepared

    feats = ["log_revenue", "log_employees", "entity_score", "revenue_per_employee", "company_age", "market_value_clean", "it_spend_per_emp", "data_completeness"]
    df = prepared(spark, SF_MID).select("company_id", "lead_tier", *feats)
    train, test = V.hashed_split(df, "company_id", 0.7, 42)
    model = B.fit(train, "company_id", feats, {"lead_tier": list(TIER_LABELS)}, rounds=20, rate=0.3)
    own = B.accuracy(test, model)["lead_tier"]
    number = F.array_position(F.array(*[F.lit(x) for x in TIER_LABELS]), F.col("lead_tier")).cast("double") - 1
    vec = lambda d: VectorAssembler(inputCols=feats, outputCol="features").transform(d.withColumn("label", number))
    rest = OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=3, seed=1), parallelism=4).fit(vec(train))
    assert own >= V.accuracy(rest.transform(vec(test))) and own > 0.9


def test_forest_levels_are_jobs_of_their_own(spark):
    """No task holds the sorts of several levels: the node table is read, not windowed."""
    df = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("u"), F.sqrt("id").alias("v"))
    nodes = IF.iforest_fit(df, "id", ["u", "v"], 5, 64, 42)
    assert "Window" not in nodes._jdf.queryExecution().executedPlan().toString()
    got = nodes.toPandas()
    assert got[got.feature < 0].groupby("tree")["size"].sum().tolist() == [64] * 5


def test_forest_walk_of_fixed_length_ends_in_the_leaf():
    """A tree with leaves at several depths and a place without rows, against a walk that stops at leaves."""
    nodes = pd.DataFrame([(1, 0, 0.5, 9, 0), (2, -1, 0.0, 4, 1), (3, 1, -1.0, 5, 1), (6, 0, 2.0, 2, 2), (12, -1, 0.0, 2, 3), (7, -1, 0.0, 3, 2)], columns=["node", "feature", "cut", "size", "depth"])
    feat, cut, length = IF._walked(nodes, 4)
    known = {n: (f, c, IF.leaf_steps([d], [s])[0]) for n, f, c, s, d in nodes.itertuples(index=False)}
    odd = [0.0, 0.5, 1.0, 2.0, 3.0, -1.0, -2.0, float("inf"), float("-inf"), float("nan")]
    for x in [(u, v) for u in odd for v in odd]:
        at = 1
        while known.get(at, (-1,))[0] >= 0:
            at = 2 * at + (x[known[at][0]] >= known[at][1])
        want = known[at][2] if at in known else IF.leaf_steps([int(np.log2(at))], [0])[0]
        at = 1
        for _ in range(4):
            at = 2 * at + (x[feat[at]] >= cut[at])
        assert length[at] == want


def test_places_in_a_donor_block_are_found_by_halving(spark):
    """Counts of values not above a key, at every place of blocks of every size; not one value after the other."""
    from firmscope.operators import donor_index as DI

    rows = [(sorted(float(i // 2) for i in range(n)), key) for n in (0, 1, 2, 3, 255, 256, 511, DI.BLOCK) for key in (-1.0, 0.0, 0.5, 1.0, n / 4, n / 2 - 1.0, n / 2, 1e9)]
    df = spark.createDataFrame(rows, "v array<double>, key double").select("v", "key", DI._upto(F.col("v"), F.col("key")).alias("at"))
    assert "filter(" not in df._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        assert r["at"] == sum(v <= r["key"] for v in r["v"])
