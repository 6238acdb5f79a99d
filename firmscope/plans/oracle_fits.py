"""SQL statements of the two fits, k-means and the isolation forest, and of the
tables behind them, for DuckDB over the driver's tables.

The Spark side takes its starts, weights, samples, features and cuts from
portable hashes; the statements here follow the same hashes with joins,
windows and a recursive query, so labels, scores and flags can be compared
row by row. Only the coefficients of the universal hashes are shared.
"""

from __future__ import annotations

from firmscope.config import CLUSTER_FEATURES, DEFAULT, VALIDATION_FEATURES
from firmscope.functions.portable import hash52_sql, unit_sql
from firmscope.operators.iforest import EULER_GAMMA, STEPS, max_depth
from firmscope.operators.lloyd import HALF, PRIME, TOLERANCE, UNIT, Replica, poisson_steps, stream
from firmscope.plans.oracle import CORE_SQL, EVALUATOR_CTES

SEED = DEFAULT.seed


def z_columns(table: str, cols, name: str) -> str:
    """``{name}fit`` and ``{name}rows``: the table with z0, z1, ... standardised."""
    fit = ", ".join(f"avg({c}) AS m{j}, stddev_pop({c}) AS s{j}" for j, c in enumerate(cols))
    z = ", ".join(f"(p.{c} - m{j}) / s{j} AS z{j}" for j, c in enumerate(cols))
    return f"{name}fit AS MATERIALIZED (SELECT {fit} FROM {table}), {name}rows AS MATERIALIZED (SELECT p.*, {z} FROM {table} p, {name}fit)"


def segment_tail(assigned: str) -> str:
    """From rows with ``cluster`` and the score ``s`` to tier names, cut and flags."""
    return f"""{assigned},
modes AS (SELECT cluster, entity_score AS entity_mode FROM (
  SELECT cluster, entity_score, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, entity_score) AS rk
  FROM (SELECT cluster, entity_score, count(*) AS n FROM assigned GROUP BY cluster, entity_score)) WHERE rk = 1),
profile AS (SELECT cluster, median(revenue_clean) AS median_revenue, count(*) AS size FROM assigned GROUP BY cluster),
tiers AS (SELECT profile.*, entity_mode, rank() OVER (ORDER BY median_revenue DESC NULLS LAST) AS cluster_tier FROM profile JOIN modes USING (cluster)),
names AS (SELECT cluster, cluster_tier, 'Tier ' || CAST(cluster_tier AS VARCHAR) || ' ' || CASE WHEN cluster_tier = 1 THEN 'Global HQ'
  WHEN cluster_tier >= 4 AND entity_mode >= 2.8 THEN 'Local HQ' WHEN entity_mode >= 2.8 THEN 'Parent HQ'
  WHEN entity_mode >= 1.8 THEN 'Subsidiary' ELSE 'Branch' END AS cluster_name FROM tiers),
cut AS (SELECT quantile_cont(-s, 0.05) AS t FROM assigned),
decided AS (SELECT assigned.*, cluster_tier, cluster_name, -s - t AS anomaly_score FROM assigned JOIN names USING (cluster), cut),
labelled AS MATERIALIZED (SELECT *, anomaly_score < 0 AS is_anomaly, CASE WHEN anomaly_score < 0 THEN 'Anomaly' ELSE 'Normal' END AS anomaly_label,
  CAST(risk_shell AS INTEGER) + CAST(risk_data_quality AS INTEGER) + CAST(risk_orphan_sub AS INTEGER)
  + CAST(anomaly_score < 0 AS INTEGER) AS risk_flags FROM decided)
"""


# ---------------------------------------------------------------- k-means
def _row(values) -> str:
    return "(" + ", ".join("NULL" if v is None else str(v) for v in values) + ")"


def _d2(left: str, right: str, dims: int) -> str:
    return " + ".join(f"({left}{j} - {right}{j}) * ({left}{j} - {right}{j})" for j in range(dims))


def _unit31(x: str, y: str, z: str) -> str:
    return f"(CAST(({x} * a + {y} * b + {z}) % {PRIME} AS DOUBLE) / {PRIME})"


def points_ctes(table: str, dims: int, name: str, keep: str = "", id_col: str = "company_id") -> str:
    """``{name}pts``: id, the halves of its hash, and whole-number coordinates."""
    q = ", ".join(f"CAST(round(z{j} * {UNIT}) AS DOUBLE) AS q{j}" for j in range(dims))
    h = hash52_sql(id_col, str(SEED))
    return (f"{name}pts AS MATERIALIZED (SELECT {id_col} AS id, {h} >> {HALF} AS a, {h} & {(1 << HALF) - 1} AS b, {q}{keep} FROM {table})")


def lloyd_ctes(name: str, dims: int, replicas: list[Replica], max_iter: int = 300) -> str:
    """``{name}best``: (grp, c, m0, ...) the centres of the best start for each
    run, or each k, of the replicas over ``{name}pts``."""
    group = lambda r: r.k if r.run is None else r.run
    js = range(dims)
    ms, qs = ", ".join(f"m{j}" for j in js), ", ".join(f"q{j}" for j in js)
    reps = ", ".join(_row((i, r.k, r.start, r.run, group(r))) for i, r in enumerate(replicas))
    out = [f"{name}reps AS MATERIALIZED (SELECT * FROM (VALUES {reps}) t(r, k, start, run, grp))"]
    runs = sorted({r.run for r in replicas if r.run is not None})
    if runs:
        steps, u = poisson_steps(), _unit31("wx", "wy", "wz")
        case = " ".join(f"WHEN u < {p!r} THEN {i}" for i, p in enumerate(steps))
        coefficients = ", ".join(_row((run, *stream(SEED, "weight", run))) for run in runs)
        out.append(f"{name}w AS MATERIALIZED (SELECT id, run, CAST(CASE {case} ELSE {len(steps)} END AS DOUBLE) AS w FROM "
                   f"(SELECT id, run, {u} AS u FROM {name}pts, (VALUES {coefficients}) t(run, wx, wy, wz)))")
        weighted = f"(SELECT p.*, r.r, w.w FROM {name}pts p JOIN {name}w w USING (id) JOIN {name}reps r ON r.run = w.run WHERE w.w > 0)"
    else:
        weighted = f"(SELECT p.*, r.r, 1.0 AS w FROM {name}pts p, {name}reps r)"
    out.append(f"{name}rows AS MATERIALIZED {weighted}")
    most = max(r.k for r in replicas)
    for step in range(most):
        names = ", ".join(_row((i, *stream(SEED, "start", r.k, r.start, "" if r.run is None else r.run, step))) for i, r in enumerate(replicas) if r.k > step)
        near = "w" if not step else f"w * min({_d2('q', 'm', dims)})"
        source = f"{name}rows" if not step else f"{name}rows JOIN {name}c{step - 1} c USING (r)"
        speed = f"SELECT r, id, any_value(a) AS a, any_value(b) AS b, {', '.join(f'any_value(q{j}) AS q{j}' for j in js)}, {near if not step else f'any_value(w) * min({_d2(chr(113), chr(109), dims)})'} AS speed FROM {source} GROUP BY r, id"
        if not step:
            speed = f"SELECT r, id, a, b, {qs}, w AS speed FROM {name}rows"
        key = f"-ln(1.0 - {_unit31('x', 'y', 'z')}) / speed"
        out.append(
            f"{name}n{step} AS MATERIALIZED (SELECT r, {step} AS c, {', '.join(f'q.q{j} AS m{j}' for j in js)} FROM (SELECT r, arg_min({{{', '.join(f'q{j}: q{j}' for j in js)}}}, {{k: {key}, a: a, b: b}}) AS q "
            f"FROM ({speed}) JOIN (VALUES {names}) t(r, x, y, z) USING (r) WHERE speed > 0 GROUP BY r))")
        both = f"SELECT * FROM {name}n{step}" + (f" UNION ALL SELECT * FROM {name}c{step - 1}" if step else "")
        out.append(f"{name}c{step} AS MATERIALIZED ({both})")
    sums = ", ".join(f"sum(w * q{j}) / sum(w) AS n{j}" for j in js)
    old = ", ".join(f"coalesce(n{j}, m{j}) AS m{j}" for j in js)
    moved = " + ".join(f"(coalesce(n{j}, m{j}) - m{j}) * (coalesce(n{j}, m{j}) - m{j})" for j in js)
    out.append(
        f"{name}st AS (SELECT 0 AS it, r, c, {ms}, CAST(1e300 AS DOUBLE) AS shift FROM {name}c{most - 1} UNION ALL "
        f"SELECT it + 1, r, c, {old}, sum({moved}) OVER (PARTITION BY r) / {float(UNIT) ** 2!r} FROM "
        f"(SELECT * FROM {name}st WHERE shift > {TOLERANCE} AND it < {max_iter}) s LEFT JOIN "
        f"(SELECT r, c, {sums} FROM (SELECT r, id, any_value(w) AS w, {', '.join(f'any_value(q{j}) AS q{j}' for j in js)}, arg_min(c, {{d: {_d2('q', 'm', dims)}, c: c}}) AS c "
        f"FROM {name}rows JOIN (SELECT * FROM {name}st WHERE shift > {TOLERANCE} AND it < {max_iter}) o USING (r) GROUP BY r, id) GROUP BY r, c) n USING (r, c))")
    out.append(f"{name}end AS MATERIALIZED (SELECT r, c, {ms} FROM {name}st QUALIFY it = max(it) OVER (PARTITION BY r))")
    out.append(f"{name}cost AS MATERIALIZED (SELECT r, sum(w * d2) / {float(UNIT) ** 2!r} AS cost, sum(w) AS w FROM (SELECT r, id, any_value(w) AS w, min({_d2('q', 'm', dims)}) AS d2 "
               f"FROM {name}rows JOIN {name}end USING (r) GROUP BY r, id) GROUP BY r)")
    out.append(f"{name}best AS MATERIALIZED (SELECT grp, c, {ms}, cost FROM {name}end JOIN (SELECT r, grp, cost FROM {name}cost JOIN {name}reps USING (r) "
               f"QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(cost / w, 9), start) = 1) USING (r))")
    return ",\n".join(out)


def nearest_cte(name: str, rows: str, fits: str, dims: int) -> str:
    """``{name}near``: (company_id, cluster) by standardised columns."""
    d2 = " + ".join(f"(z{j} - m{j} / {UNIT}) * (z{j} - m{j} / {UNIT})" for j in range(dims))
    return f"{name}near AS MATERIALIZED (SELECT company_id, arg_min(c, {{d: {d2}, c: c}}) AS cluster FROM {rows}, {fits} GROUP BY company_id)"


# ---------------------------------------------------------------- isolation forest
def forest_ctes(rows: str, dims: int, trees: int, psi: int) -> str:
    """``finner`` and ``fleaf``: the nodes of a forest grown over ``rows``."""
    js = range(dims)
    h = hash52_sql("company_id", str(SEED))
    deal = ", ".join(_row((t, *stream(SEED, "tree", t))) for t in range(trees))
    own = f"(x * (h >> {HALF}) + y * (h & {(1 << HALF) - 1}) + z) % {PRIME}"
    zs = ", ".join(f"z{j}" for j in js)
    out = [
        f"fn AS MATERIALIZED (SELECT count(*) AS n, least({psi}, count(*)) AS psi FROM {rows})",
        f"fpool AS MATERIALIZED (SELECT company_id, {zs}, {h} AS h FROM {rows}, fn WHERE {h} < CAST(floor(least(1.0, {trees * psi} / n) * {2**52}) AS BIGINT))",
        f"f0 AS MATERIALIZED (SELECT tree, {zs}, 1 AS node FROM fpool, (VALUES {deal}) t(tree, x, y, z), fn QUALIFY row_number() OVER (PARTITION BY tree ORDER BY {own}, h) <= any_value(psi) OVER ())",
    ]
    deepest = max_depth(psi)
    for level in range(deepest):
        ends = ", ".join(f"{{j: {j}, lo: min(z{j}) OVER w, hi: max(z{j}) OVER w}}" for j in js)
        value = "CASE f.j " + " ".join(f"WHEN {j} THEN z{j}" for j in js) + " END"
        pick = f"varies[({hash52_sql('tree', 'node', str(SEED))} % len(varies)) + 1]"
        cut = f"f.lo + {unit_sql('node', 'tree', str(SEED))} * (f.hi - f.lo)"
        out.append(
            f"g{level} AS MATERIALIZED (SELECT *, CASE WHEN f IS NOT NULL THEN {cut} END AS cut, {value} AS v FROM (SELECT *, CASE WHEN len(varies) > 0 THEN {pick} END AS f FROM "
            f"(SELECT tree, {zs}, node, count(*) OVER w AS size, list_filter([{ends}], lambda e: e.hi > e.lo) AS varies FROM f{level} WINDOW w AS (PARTITION BY tree, node))))")
        out.append(f"f{level + 1} AS MATERIALIZED (SELECT tree, {zs}, CASE WHEN f IS NULL THEN node ELSE 2 * node + CAST(v >= cut AS INTEGER) END AS node FROM g{level})")
    inner = " UNION ".join(f"SELECT tree, node, f.j AS j, cut FROM g{level} WHERE f IS NOT NULL" for level in range(deepest))
    out.append(f"finner AS MATERIALIZED ({inner})")
    out.append(f"fleaf AS MATERIALIZED (SELECT tree, node, count(*) AS size FROM f{deepest} GROUP BY tree, node)")
    return ",\n".join(out)


def walk_ctes(rows: str, dims: int, trees: int, psi: int, name: str) -> str:
    """``{name}score``: (company_id, s) of the rows by the grown forest."""
    zs = ", ".join(f"z{j}" for j in range(dims))
    out = [f"{name}0 AS MATERIALIZED (SELECT company_id, {zs}, tree, 1 AS node FROM {rows}, range({trees}) t(tree))"]
    deepest = max_depth(psi)
    for level in range(deepest):
        value = "CASE i.j " + " ".join(f"WHEN {j} THEN z{j}" for j in range(dims)) + " END"
        out.append(f"{name}{level + 1} AS MATERIALIZED (SELECT company_id, {zs}, w.tree, CASE WHEN i.j IS NULL THEN w.node ELSE 2 * w.node + CAST({value} >= i.cut AS INTEGER) END AS node "
                   f"FROM {name}{level} w LEFT JOIN finner i ON i.tree = w.tree AND i.node = w.node)")
    expected = f"CASE WHEN {{n}} = 2 THEN 1.0 WHEN {{n}} > 2 THEN 2.0 * (ln({{n}} - 1.0) + {EULER_GAMMA!r}) - 2.0 * ({{n}} - 1.0) / {{n}} ELSE 0.0 END"
    length = f"CAST(round((floor(log2(w.node)) + {expected.format(n='coalesce(l.size, 0)')}) * {STEPS}) AS BIGINT)"
    norm = expected.format(n="any_value(psi)")
    out.append(f"{name}score AS MATERIALIZED (SELECT company_id, pow(2.0, -(CAST(sum({length}) AS DOUBLE) / {STEPS} / {trees}) / ({norm})) AS s "
               f"FROM {name}{deepest} w LEFT JOIN fleaf l ON l.tree = w.tree AND l.node = w.node, fn GROUP BY company_id)")
    return ",\n".join(out)


# ---------------------------------------------------------------- the pipeline's results
_RECURSIVE_CORE = CORE_SQL.rstrip().replace("WITH ", "WITH RECURSIVE ", 1).replace("prepared AS (", "prepared AS MATERIALIZED (")
_DIMS = len(CLUSTER_FEATURES)
_FOREST = (DEFAULT.iforest_trees, DEFAULT.iforest_sample)
_STARTS = [Replica(DEFAULT.k, s) for s in range(DEFAULT.kmeans_starts)]

SEGMENTS_SQL = ",\n".join([
    _RECURSIVE_CORE, z_columns("prepared", CLUSTER_FEATURES, "z"), points_ctes("zrows", _DIMS, "km"), lloyd_ctes("km", _DIMS, _STARTS), nearest_cte("km", "zrows", "kmbest", _DIMS)])

RESULTS_SQL = ",\n".join([
    SEGMENTS_SQL, forest_ctes("zrows", _DIMS, *_FOREST), walk_ctes("zrows", _DIMS, *_FOREST, "f_"),
    segment_tail("assigned AS MATERIALIZED (SELECT zrows.*, kmnear.cluster, f_score.s FROM zrows JOIN kmnear USING (company_id) JOIN f_score USING (company_id))")])


def results_sql(select: str) -> str:
    """A statement over ``labelled``: the pipeline's results."""
    return RESULTS_SQL + select


# the evaluator's rows against the pipeline's models: scaler, centres, names, forest and cut are those of ``prepared``
_E_FEATURES = ("ln(1 + revenue_clean)", "ln(1 + employees_clean)", "ord_e", "has_parent_e", "rpe", "company_age", "du_e")
EVALUATOR_RESULTS_SQL = ",\n".join([
    RESULTS_SQL, EVALUATOR_CTES,
    "ev AS MATERIALIZED (SELECT e.company_id, " + ", ".join(f"({c} - m{j}) / s{j} AS z{j}" for j, c in enumerate(_E_FEATURES)) + " FROM evaluated e, zfit)",
    nearest_cte("ev", "ev", "kmbest", _DIMS),
    walk_ctes("ev", _DIMS, *_FOREST, "e_"),
    "evaluator_results AS (SELECT e.company_id, cluster_name, lead_score, CASE WHEN lead_score >= 75 THEN 'Priority' WHEN lead_score >= 50 THEN 'Hot' WHEN lead_score >= 30 THEN 'Warm' ELSE 'Cold' END AS lead_tier, "
    "CASE WHEN -es.s - t < 0 THEN 'Anomaly' ELSE 'Normal' END AS anomaly_label, revenue_clean, employees_clean, company_age "
    "FROM evaluated e JOIN evnear USING (company_id) JOIN names USING (cluster) JOIN e_score es USING (company_id), cut)\n"])


# ---------------------------------------------------------------- validation
_V_DIMS = len(VALIDATION_FEATURES)
_VALIDATION_ROWS = (
    "vrows0 AS (SELECT company_id, coalesce(log_revenue, 0.0) AS log_revenue, coalesce(log_employees, 0.0) AS log_employees, entity_score, "
    "coalesce(revenue_clean / CASE WHEN employees_clean = 0 THEN 1.0 ELSE employees_clean END, 0.0) AS revenue_per_employee_v, company_age, is_domestic_ultimate_clean FROM prepared)"
)


def bootstrap_sql(select: str, runs: int = 20, k: int = 5, starts: int = 5) -> str:
    """A statement over ``boot_ari`` (run, ari)."""
    d2 = _d2("q", "m", _V_DIMS)
    pairs = lambda c: f"({c} * ({c} - 1) / 2.0)"
    return ",\n".join([
        _RECURSIVE_CORE, _VALIDATION_ROWS, z_columns("vrows0", VALIDATION_FEATURES, "v"), points_ctes("vrows", _V_DIMS, "vb"), lloyd_ctes("vb", _V_DIMS, _STARTS),
        nearest_cte("vb", "vrows", "vbbest", _V_DIMS), points_ctes("vrows", _V_DIMS, "bt"),
        lloyd_ctes("bt", _V_DIMS, [Replica(k, s, run) for run in range(runs) for s in range(starts)]),
        f"btlabel AS MATERIALIZED (SELECT grp AS run, id AS company_id, arg_min(c, {{d: {d2}, c: c}}) AS b FROM btpts, btbest GROUP BY grp, id)",
        "btcount AS MATERIALIZED (SELECT run, cluster AS a, b, count(*) AS n FROM btlabel JOIN vbnear USING (company_id) GROUP BY run, cluster, b)",
        f"bta AS (SELECT run, sum({pairs('n')}) AS sa FROM (SELECT run, a, sum(n) AS n FROM btcount GROUP BY run, a) GROUP BY run)",
        f"btb AS (SELECT run, sum({pairs('n')}) AS sb FROM (SELECT run, b, sum(n) AS n FROM btcount GROUP BY run, b) GROUP BY run)",
        f"btc AS (SELECT run, sum({pairs('n')}) AS sij, {pairs('sum(n)')} AS every FROM btcount GROUP BY run)",
        "boot_ari AS (SELECT run, CASE WHEN (sa + sb) / 2.0 = sa * sb / every THEN 1.0 ELSE (sij - sa * sb / every) / ((sa + sb) / 2.0 - sa * sb / every) END AS ari "
        "FROM bta JOIN btb USING (run) JOIN btc USING (run))",
    ]) + "\n" + select


def sweep_sql(ks=range(2, 9), starts: int = 10) -> str:
    """(k, cost, silhouette) of the best start for each k."""
    d2 = _d2("q", "m", _DIMS)
    js = range(_DIMS)
    return ",\n".join([
        _RECURSIVE_CORE, z_columns("prepared", CLUSTER_FEATURES, "z"), points_ctes("zrows", _DIMS, "sw"), lloyd_ctes("sw", _DIMS, [Replica(k, s) for k in ks for s in range(starts)]),
        f"own AS MATERIALIZED (SELECT grp, id, arg_min(c, {{d: {d2}, c: c}}) AS c FROM swpts, swbest GROUP BY grp, id)",
        f"mid AS MATERIALIZED (SELECT grp, c, count(*) AS size, {', '.join(f'avg(q{j}) AS m{j}' for j in js)} FROM own JOIN swpts USING (id) GROUP BY grp, c)",
        f"mids AS MATERIALIZED (SELECT grp, c, any_value(size) AS size, {', '.join(f'any_value(m{j}) AS m{j}' for j in js)}, avg({d2}) AS spread FROM own JOIN swpts USING (id) JOIN mid USING (grp, c) GROUP BY grp, c)",
        f"far AS MATERIALIZED (SELECT own.grp, own.id, CASE WHEN own.c = m.c THEN 1 ELSE 0 END AS mine, m.size, ({d2}) + m.spread AS d FROM own JOIN swpts USING (id) JOIN mids m ON m.grp = own.grp)",
        "ab AS (SELECT grp, id, max(CASE WHEN mine = 1 THEN size END) AS size, max(CASE WHEN mine = 1 THEN d * size / greatest(size - 1, 1) END) AS x, min(CASE WHEN mine = 0 THEN d END) AS y FROM far GROUP BY grp, id)",
        "sil AS (SELECT grp, avg(CASE WHEN size <= 1 OR y IS NULL OR greatest(x, y) <= 0 THEN 0.0 ELSE (y - x) / greatest(x, y) END) AS silhouette FROM ab GROUP BY grp)",
    ]) + "\nSELECT DISTINCT CAST(grp AS INTEGER) AS k, round(cost, 4) AS cost, round(silhouette, 6) AS silhouette FROM swbest JOIN sil USING (grp)"


def embeddings_sql(dims: int, k: int, starts: int = 10) -> str:
    """(n, ari, k): k-means of the embedding vectors against their labels."""
    pairs = lambda c: f"({c} * ({c} - 1) / 2.0)"
    zs = ", ".join(f"CAST(embedding[{j + 1}] AS DOUBLE) AS z{j}" for j in range(dims))
    return ",\n".join([
        f"WITH RECURSIVE em AS (SELECT vec_id, label, {zs} FROM embeddings)", points_ctes("em", dims, "em", ", label", "vec_id"), lloyd_ctes("em", dims, [Replica(k, s) for s in range(starts)]),
        f"l AS MATERIALIZED (SELECT id, any_value(label) AS a, arg_min(c, {{d: {_d2('q', 'm', dims)}, c: c}}) AS b FROM empts, embest GROUP BY id)",
        "n AS MATERIALIZED (SELECT a, b, count(*) AS n FROM l GROUP BY a, b)",
        f"s AS (SELECT (SELECT sum({pairs('n')}) FROM n) AS sij, (SELECT sum({pairs('n')}) FROM (SELECT sum(n) AS n FROM n GROUP BY a)) AS sa, "
        f"(SELECT sum({pairs('n')}) FROM (SELECT sum(n) AS n FROM n GROUP BY b)) AS sb, (SELECT sum(n) FROM n) AS n)",
    ]) + f"\nSELECT CAST(n AS BIGINT) AS n, round((sij - sa * sb / {pairs('n')}) / ((sa + sb) / 2.0 - sa * sb / {pairs('n')}), 6) AS ari, CAST({k} AS INTEGER) AS k FROM s"


def impute_cv_sql(ks=(1, 3, 5, 7, 10), folds: int = 5) -> str:
    """(target, k, mse, se, chosen) by ranking all donors of every hidden value."""
    parts = []
    for target, value, mine, other in (("log_rev_in", "va", "za", "zb"), ("log_emp_in", "vb", "zb", "za")):
        parts.append(
            f"SELECT '{target}' AS target, r.fold, r.id, r.{value} AS truth, d.{value} AS t, row_number() OVER (PARTITION BY r.id ORDER BY CASE WHEN r.{other} IS NOT NULL AND d.{other} IS NOT NULL "
            f"THEN 1.5 * ((r.{other} - d.{other}) * (r.{other} - d.{other}) + (r.zo - d.zo) * (r.zo - d.zo)) ELSE 3.0 * ((r.zo - d.zo) * (r.zo - d.zo)) END, d.id) AS rk "
            f"FROM zf r JOIN zf d ON r.{value} IS NOT NULL AND d.{value} IS NOT NULL AND r.fold <> d.fold")
    return CORE_SQL.rstrip() + f""",
zf AS MATERIALIZED (SELECT *, {hash52_sql('id', str(SEED))} % {folds} AS fold FROM z),
ranked AS ({' UNION ALL '.join(parts)}),
preds AS (SELECT target, fold, id, any_value(truth) AS truth, k, avg(t) AS pred FROM ranked, (SELECT unnest([{', '.join(map(str, ks))}]) AS k) WHERE rk <= k GROUP BY target, fold, id, k),
mses AS (SELECT target, fold, k, avg((pred - truth) * (pred - truth)) AS mse FROM preds GROUP BY target, fold, k),
summary AS (SELECT target, k, avg(mse) AS mse, stddev_samp(mse) / sqrt(count(*)) AS se FROM mses GROUP BY target, k),
lowest AS (SELECT target, min(mse) AS m, arg_min(se, mse) AS s FROM summary GROUP BY target),
pick AS (SELECT target, max(k) AS k FROM summary JOIN lowest USING (target) WHERE mse <= m + s GROUP BY target)
SELECT s.target, CAST(s.k AS INTEGER) AS k, round(mse, 6) AS mse, round(se, 6) AS se, s.k = pick.k AS chosen FROM summary s JOIN pick USING (target)"""
