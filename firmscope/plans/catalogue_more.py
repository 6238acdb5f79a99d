"""Further named queries: report-only analytics, statistics, validation,
report facts, and queries over the k-means / isolation-forest results.

The queries over k-means, its bootstrap and the isolation forest are compared
with statements that follow the fits' hashes (``oracle_fits``); classifiers are
checked by property tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from firmscope.config import CLUSTER_FEATURES, VALIDATION_FEATURES
from firmscope.operators import extra as X
from firmscope.operators import lloyd
from firmscope.operators import queries as Q
from firmscope.operators import report as G
from firmscope.operators import validate as V
from firmscope.plans import oracle_fits as F_SQL
from firmscope.functions.portable import hash52_sql
from firmscope.plans.catalogue import LEAD_COLS_SQL, MARKET, MARKET_WHERE, _lead_cols, r2, r6, register
from firmscope.plans.catalogue_labels import flat_market_facts, market_facts_sql
from firmscope.plans.oracle import ADAPTER_SQL, EVALUATOR_SQL, with_prepared
from firmscope.plans.results import companies_raw, prepared, results, results_models
from firmscope.session import cut_lineage


# ------------------------------------------------------------------ X1–X5
@register("size_bands", with_prepared(
    ", b AS (SELECT CASE WHEN employees_clean <= 10 THEN '1-10' WHEN employees_clean <= 50 THEN '11-50' "
    "WHEN employees_clean <= 200 THEN '51-200' WHEN employees_clean <= 1000 THEN '201-1000' ELSE '1000+' END AS band "
    "FROM prepared WHERE employees_clean IS NOT NULL) "
    "SELECT band, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM b GROUP BY band"))
def size_bands(spark, sf):
    return X.size_bands(prepared(spark, sf)).select("band", "n", r6("pct").alias("pct"))


@register("correlations", with_prepared(
    "SELECT round(corr(revenue_clean, employees_clean), 6) AS rev_emp, round(corr(revenue_clean, market_value_clean), 6) AS rev_market_value, "
    "round(corr(revenue_clean, entity_score), 6) AS rev_entity_score FROM prepared"))
def correlations(spark, sf):
    c = X.correlations(prepared(spark, sf))
    return c.select(*[r6(x).alias(x) for x in c.columns])


@register("founding_summary", with_prepared(
    "SELECT count(*) AS n, round(avg(CAST(year_found_clean > 2015 AS DOUBLE)), 6) AS share_after, "
    "round(median(year_found_clean), 6) AS median_year FROM prepared WHERE year_found_clean IS NOT NULL"))
def founding_summary(spark, sf):
    s = X.founding_summary(prepared(spark, sf))
    return s.select("n", r6("share_after").alias("share_after"), r6("median_year").alias("median_year"))


@register("founding_by_year", with_prepared(
    "SELECT year_found_clean AS year, count(*) AS n FROM prepared WHERE year_found_clean IS NOT NULL GROUP BY 1"))
def founding_by_year(spark, sf):
    return X.founding_by_year(prepared(spark, sf))


@register("sic_sparsity", with_prepared(
    ", s4 AS (SELECT COALESCE(sic_code, 'nan') AS g, count(*) AS size FROM prepared GROUP BY 1), "
    "s2 AS (SELECT sic2 AS g, count(*) AS size FROM prepared GROUP BY 1) "
    "SELECT 'sic4' AS level, count(*) AS groups, round(avg(CAST(size < 5 AS DOUBLE)), 6) AS share_small, round(median(size), 6) AS median_size FROM s4 "
    "UNION ALL SELECT 'sic2', count(*), round(avg(CAST(size < 5 AS DOUBLE)), 6), round(median(size), 6) FROM s2"))
def sic_sparsity(spark, sf):
    s = X.sic_sparsity(prepared(spark, sf))
    return s.select("level", "groups", r6("share_small").alias("share_small"), r6(F.col("median_size").cast("double")).alias("median_size"))


@register("segment_insights", with_prepared(
    "SELECT CAST(count_if(revenue_clean > 1e8) AS BIGINT) AS large_enterprises, "
    "CAST(count_if(corporate_family_size > 100 AND revenue_per_employee > 5e4) AS BIGINT) AS efficient_groups, "
    "CAST(count_if(revenue_clean < 1e6 AND revenue_vs_industry > 100) AS BIGINT) AS small_outperformers FROM prepared"))
def segment_insights(spark, sf):
    return X.segment_insights(prepared(spark, sf))


# ------------------------------------------------------------------ X7, X11, X12
def _score_sql(rev=1.0, power=1.0, eff=1.0, tech=1.0, mv=1.0, stab=1.0):
    return (
        "least(100.0, greatest(0.0, ("
        f"CASE WHEN revenue_clean >= 1e8 THEN 35.0 WHEN revenue_clean >= 1e7 THEN 25.0 WHEN revenue_clean >= 1e6 THEN 15.0 WHEN revenue_clean >= 1e5 THEN 5.0 ELSE 0.0 END * {rev}"
        f" + CASE WHEN is_domestic_ultimate_clean = 1 THEN 15.0 ELSE entity_score * 3.0 END * {power}"
        f" + CASE WHEN revenue_per_employee >= 5e5 THEN 10.0 ELSE 0.0 END * {eff}"
        f" + CASE WHEN it_spend_per_emp > 1000 THEN 10.0 WHEN it_spend_per_emp > 0 THEN 5.0 ELSE 0.0 END * {tech}"
        f" + CASE WHEN market_value_clean > 0 THEN 15.0 ELSE 0.0 END * {mv}"
        f" + CASE WHEN company_age >= 3 AND company_age <= 10 THEN 10.0 WHEN company_age > 10 THEN 5.0 ELSE 0.0 END * {stab}"
        ") * CASE WHEN data_completeness < 0.5 THEN 0.8 ELSE 1.0 END))"
    )


def _ws_sql():
    base = f"(SELECT company_id FROM prepared ORDER BY CAST({_score_sql()} AS DOUBLE) DESC, company_id LIMIT 100)"
    parts = []
    for name, kw in (("revenue_up_20", dict(rev=1.2)), ("power_down_20", dict(power=0.8)),
                     ("value_up_10_stability_down_10", dict(mv=1.1, stab=0.9))):
        other = f"(SELECT company_id FROM prepared ORDER BY CAST({_score_sql(**kw)} AS DOUBLE) DESC, company_id LIMIT 100)"
        parts.append(
            f"SELECT '{name}' AS variant, round((SELECT count(*) FROM ({base} INTERSECT {other})) * 1.0 / "
            f"(SELECT count(*) FROM ({base} UNION {other})), 6) AS jaccard"
        )
    return with_prepared(" UNION ALL ".join(parts))


@register("weight_sensitivity", _ws_sql())
def weight_sensitivity(spark, sf):
    return X.weight_sensitivity(prepared(spark, sf)).select("variant", r6("jaccard").alias("jaccard"))


@register("profile_vs_market", with_prepared(
    ", st AS (SELECT min(revenue_clean) lr, max(revenue_clean) hr, min(employees_clean) le, max(employees_clean) he, "
    "min(lead_score) ls, max(lead_score) hs, min(company_age) la, max(company_age) ha FROM prepared), "
    "nm AS (SELECT company_id, CASE WHEN hr > lr THEN (revenue_clean - lr) / (hr - lr) ELSE 0.0 END AS revenue_clean, "
    "CASE WHEN he > le THEN (employees_clean - le) / (he - le) ELSE 0.0 END AS employees_clean, "
    "CASE WHEN hs > ls THEN (lead_score - ls) / (hs - ls) ELSE 0.0 END AS lead_score, "
    "CASE WHEN ha > la THEN (company_age - la) / (ha - la) ELSE 0.0 END AS company_age FROM prepared, st), "
    "av AS (SELECT avg(revenue_clean) a1, avg(employees_clean) a2, avg(lead_score) a3, avg(company_age) a4 FROM nm) "
    "SELECT company_id, metric, round(value, 6) AS value, round(market_avg, 6) AS market_avg FROM ("
    "SELECT company_id, 'revenue_clean' AS metric, revenue_clean AS value, a1 AS market_avg FROM nm, av "
    "UNION ALL SELECT company_id, 'employees_clean', employees_clean, a2 FROM nm, av "
    "UNION ALL SELECT company_id, 'lead_score', lead_score, a3 FROM nm, av "
    "UNION ALL SELECT company_id, 'company_age', company_age, a4 FROM nm, av)"))
def profile_vs_market(spark, sf):
    p = X.profile_vs_market(prepared(spark, sf))
    return p.select("company_id", "metric", r6("value").alias("value"), r6("market_avg").alias("market_avg"))


@register("territory_balance", with_prepared(
    "SELECT region, count(*) AS leads, round(sum(revenue_clean), 2) AS revenue FROM prepared "
    "WHERE lead_tier = 'Hot' AND region IS NOT NULL GROUP BY region"))
def territory_balance(spark, sf):
    return X.territory_balance(prepared(spark, sf)).select("region", "leads", r2("revenue").alias("revenue"))


@register("territory_top_leads", with_prepared(
    "SELECT region, rank, company_id, round(lead_score, 6) AS lead_score FROM (SELECT region, company_id, lead_score, "
    "CAST(row_number() OVER (PARTITION BY region ORDER BY lead_score DESC, company_id) AS INTEGER) AS rank FROM prepared "
    "WHERE lead_tier = 'Hot' AND region IS NOT NULL) WHERE rank <= 50"))
def territory_top_leads(spark, sf):
    t = X.territory_top_leads(prepared(spark, sf))
    return t.select("region", "rank", "company_id", r6("lead_score").alias("lead_score"))


# ------------------------------------------------------------------ V1, V3
LOG_EFF = "ln(1 + revenue_clean / CASE WHEN employees_clean = 0 THEN 1.0 ELSE employees_clean END)"


@register("welch_ttest", with_prepared(
    f", m AS (SELECT lead_tier, count({LOG_EFF}) AS n, avg({LOG_EFF}) AS mean, var_samp({LOG_EFF}) AS var FROM prepared "
    "WHERE lead_tier IN ('Priority', 'Cold') GROUP BY lead_tier), a AS (SELECT * FROM m WHERE lead_tier = 'Priority'), "
    "b AS (SELECT * FROM m WHERE lead_tier = 'Cold') "
    "SELECT 'Priority' AS group_a, 'Cold' AS group_b, a.n AS na, b.n AS nb, round(a.mean, 6) AS mean_a, round(b.mean, 6) AS mean_b, "
    "round((a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n), 6) AS t, "
    "round((a.var / a.n + b.var / b.n) * (a.var / a.n + b.var / b.n) / ((a.var / a.n) * (a.var / a.n) / (a.n - 1) + (b.var / b.n) * (b.var / b.n) / (b.n - 1)), 6) AS df "
    "FROM a, b"))
def welch_ttest(spark, sf):
    from firmscope.plans.catalogue import _log_eff

    w = V.welch_ttest(prepared(spark, sf), "lead_tier", "Priority", "Cold", _log_eff())
    return w.select("group_a", "group_b", "na", "nb", *[r6(c).alias(c) for c in ("mean_a", "mean_b", "t", "df")])


_BEYOND = (
    "list_sum(list_transform(range(-900, 901), lambda i: exp(-(df + 1) / 2 * ln(1 + ({t} + exp(i * 0.05)) * ({t} + exp(i * 0.05)) / df)) * exp(i * 0.05)))"
)


@register("welch_pvalue", with_prepared(
    f", m AS (SELECT lead_tier, count({LOG_EFF}) AS n, avg({LOG_EFF}) AS mean, var_samp({LOG_EFF}) AS var FROM prepared "
    "WHERE lead_tier IN ('Priority', 'Cold') GROUP BY lead_tier), "
    "w AS (SELECT a.n AS na, b.n AS nb, (a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n) AS t, (a.var / a.n + b.var / b.n) * (a.var / a.n + b.var / b.n) "
    "/ ((a.var / a.n) * (a.var / a.n) / (a.n - 1) + (b.var / b.n) * (b.var / b.n) / (b.n - 1)) AS df "
    "FROM (SELECT * FROM m WHERE lead_tier = 'Priority') a, (SELECT * FROM m WHERE lead_tier = 'Cold') b), "
    f"p AS (SELECT *, {_BEYOND.format(t='abs(t)')} / {_BEYOND.format(t='0.0')} AS p FROM w) "
    "SELECT 'Priority' AS group_a, 'Cold' AS group_b, na, nb, round(t, 6) AS t, round(df, 6) AS df, round(p, 12) AS p_value, round(log10(p), 6) AS log10_p FROM p"))
def welch_pvalue(spark, sf):
    from firmscope.plans.catalogue import _log_eff

    w = V.welch_with_p(prepared(spark, sf), "lead_tier", "Priority", "Cold", _log_eff())
    return w.select("group_a", "group_b", "na", "nb", r6("t").alias("t"), r6("df").alias("df"), F.round("p_value", 12).alias("p_value"), r6(F.log10("p_value")).alias("log10_p"))


@register("ari_tier_region", with_prepared(
    ", c AS (SELECT lead_tier AS a, region AS b, count(*) AS nij FROM prepared WHERE lead_tier IS NOT NULL AND region IS NOT NULL GROUP BY 1, 2), "
    "s AS (SELECT sum(nij * (nij - 1) / 2.0) AS sij, sum(nij) AS n FROM c), "
    "sa AS (SELECT sum(ai * (ai - 1) / 2.0) AS sa FROM (SELECT a, sum(nij) AS ai FROM c GROUP BY a)), "
    "sb AS (SELECT sum(bj * (bj - 1) / 2.0) AS sb FROM (SELECT b, sum(nij) AS bj FROM c GROUP BY b)) "
    "SELECT CAST(n AS BIGINT) AS n, round(CASE WHEN (sa + sb) / 2.0 = sa * sb / (n * (n - 1) / 2.0) THEN 1.0 "
    "ELSE (sij - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2.0 - sa * sb / (n * (n - 1) / 2.0)) END, 6) AS ari FROM s, sa, sb"))
def ari_tier_region(spark, sf):
    a = V.adjusted_rand_index(prepared(spark, sf), "lead_tier", "region")
    return a.select("n", r6("ari").alias("ari"))


# ------------------------------------------------------------------ G1 (financial facts), G7, G8
@register("due_diligence_financials", with_prepared(
    ", b AS (SELECT sic2, median(revenue_clean) AS bench_revenue, "
    "median(revenue_clean / CASE WHEN employees_clean = 0 THEN 1.0 ELSE employees_clean END) AS bench_productivity FROM prepared GROUP BY sic2), "
    "f AS (SELECT p.*, CASE WHEN employees_clean > 0 THEN revenue_clean / employees_clean ELSE 0.0 END AS productivity, "
    "COALESCE(b.bench_revenue, 1000000.0) AS rm, COALESCE(b.bench_productivity, 50000.0) AS pm FROM prepared p LEFT JOIN b USING (sic2)), "
    "g AS (SELECT *, CASE WHEN rm > 0 THEN (revenue_clean / rm - 1) * 100 ELSE 0.0 END AS rv, "
    "CASE WHEN pm > 0 THEN (productivity / pm - 1) * 100 ELSE 0.0 END AS pv FROM f) "
    "SELECT company_id, company_name AS name, COALESCE(sic_description, 'N/A') AS industry, COALESCE(region, 'N/A') AS region, "
    "COALESCE(country, 'N/A') AS country, CAST(company_age AS VARCHAR) || ' years' AS age, COALESCE(entity_type, 'N/A') AS entity_type, "
    "'$' || printf('%,.0f', revenue_clean) AS revenue, printf('%,.0f', employees_clean) AS employees, "
    "'$' || printf('%,.0f', productivity) || '/employee' AS productivity, printf('%+.0f', rv) || '%' AS revenue_vs_industry, "
    "printf('%+.0f', pv) || '%' AS productivity_vs_industry, CASE WHEN rv > 0 THEN 'B' ELSE 'C' END AS health_grade, "
    "is_domestic_ultimate_clean = 1 AS is_decision_maker, has_parent = 1 AS has_parent FROM g"))
def due_diligence_financials(spark, sf):
    return G.financial_facts(prepared(spark, sf))


REPLY_SQL = (
    "CASE WHEN lead_tier = 'Priority' THEN '```json' || chr(10) || '{\"Verdict\": \"' || lead_tier || ' lead\", \"Reason\": \"score ' "
    "|| CAST(CAST(round(lead_score) AS BIGINT) AS VARCHAR) || '\", \"Risk\": \"' || CASE WHEN risk_shell THEN 'shell' ELSE 'none' END "
    "|| '\", \"Action\": \"call\"}' || chr(10) || '```' "
    "WHEN lead_tier = 'Hot' THEN '{\"Verdict\": \"' || lead_tier || ' lead\", \"Reason\": \"score ' || CAST(CAST(round(lead_score) AS BIGINT) AS VARCHAR) "
    "|| '\", \"Risk\": \"' || CASE WHEN risk_shell THEN 'shell' ELSE 'none' END || '\"}' "
    "WHEN lead_tier = 'Warm' THEN '{\"Verdict\": \"Watch\"' ELSE 'Error: quota exceeded' END"
)


def _replies(df):
    score = F.round("lead_score").cast("bigint").cast("string")
    risk = F.when(F.col("risk_shell"), "shell").otherwise("none")
    body_hot = F.concat(F.lit('{"Verdict": "'), F.col("lead_tier"), F.lit(' lead", "Reason": "score '), score, F.lit('", "Risk": "'), risk, F.lit('"}'))
    body_pri = F.concat(F.lit('{"Verdict": "'), F.col("lead_tier"), F.lit(' lead", "Reason": "score '), score, F.lit('", "Risk": "'), risk,
                        F.lit('", "Action": "call"}'))
    reply = (
        F.when(F.col("lead_tier") == "Priority", F.concat(F.lit("```json\n"), body_pri, F.lit("\n```")))
        .when(F.col("lead_tier") == "Hot", body_hot)
        .when(F.col("lead_tier") == "Warm", F.lit('{"Verdict": "Watch"'))
        .otherwise(F.lit("Error: quota exceeded"))
    )
    return df.select("company_id", reply.alias("reply"))


@register("parsed_action_reports", with_prepared(
    f", r AS (SELECT company_id, {REPLY_SQL} AS reply FROM prepared), "
    "s AS (SELECT company_id, trim(reply) AS t, trim(regexp_replace(regexp_replace(trim(reply), '^```[A-Za-z]*\\s*', ''), '\\s*```$', '')) AS j FROM r), "
    "p AS (SELECT company_id, t, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.Verdict') END AS v, "
    "CASE WHEN json_valid(j) THEN json_extract_string(j, '$.Reason') END AS re, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.Risk') END AS ri, "
    "CASE WHEN json_valid(j) THEN json_extract_string(j, '$.Action') END AS a FROM s), "
    "q AS (SELECT *, starts_with(t, 'Error') OR COALESCE(v, re, ri, a) IS NULL AS bad FROM p) "
    "SELECT pr.company_id, round(pr.lead_score, 6) AS lead_score, COALESCE(CASE WHEN NOT bad THEN v END, 'Review Required') AS verdict, "
    "COALESCE(CASE WHEN NOT bad THEN re END, 'N/A') AS reason, COALESCE(CASE WHEN NOT bad THEN ri END, 'N/A') AS risk, "
    "COALESCE(CASE WHEN NOT bad THEN a END, 'N/A') AS action, "
    "CASE WHEN starts_with(t, 'Error') THEN t WHEN COALESCE(v, re, ri, a) IS NULL THEN 'unparsable reply' END AS error "
    "FROM prepared pr JOIN q USING (company_id)"))
def parsed_action_reports(spark, sf):
    df = prepared(spark, sf)
    parsed = G.parse_responses(_replies(df))
    facts = df.select("company_id", r6("lead_score").alias("lead_score"))
    return G.merge_report(facts, parsed)


# ------------------------------------------------------------------ S1, S4: CSV round trip of the raw table
@register("csv_roundtrip", "WITH " + ADAPTER_SQL
          + " SELECT company_id, company_name, region, country, sic_code, entity_type, revenue_usd, employees_total FROM raw")
def csv_roundtrip(spark, sf):
    """Write the raw company table as a headered CSV of 72 columns, the
    reference's names among 51 others in a mixed order, and read it back with
    the raw reader (by header, all text, null tokens)."""
    import uuid
    import zlib

    from firmscope.session import checkpoint_dir
    from firmscope.sources.companies import RAW_COLUMNS, read_companies

    raw = companies_raw(spark, sf)
    known = [(F.col(e).cast("string") if e in raw.columns else F.lit(None).cast("string")).alias(r) for r, e in RAW_COLUMNS]
    full = raw.select(*known, *[F.concat(F.lit(f"extra {i}, "), F.col("company_name")).alias(f"Extra {i}") for i in range(51)])
    path = f"{checkpoint_dir(spark).rstrip('/')}/firmscope-csv-{uuid.uuid4().hex}"
    full.select(*sorted(full.columns, key=lambda c: zlib.crc32(c.encode()))).write.option("header", "true").csv(path)
    df = read_companies(spark, path)
    return df.select(
        F.col("company_id").cast("long").alias("company_id"), "company_name", "region", "country", "sic_code", "entity_type",
        "revenue_usd", "employees_total",
    )


# ------------------------------------------------------------------ S2, S4: the results written and read again
@register("results_roundtrip", F_SQL.results_sql(
    "SELECT company_id, region, cluster_name, lead_tier, anomaly_label, risk_flags, CAST(has_parent AS DOUBLE) AS has_parent, round(revenue_clean, 2) AS revenue_clean, "
    "round(data_completeness, 6) AS data_completeness, round(anomaly_score, 6) AS anomaly_score, form FROM labelled, (SELECT unnest(['csv', 'parquet']) AS form)"))
def results_roundtrip(spark, sf):
    """Write the results as Parquet by region and as headered CSV, and read both back."""
    import uuid

    from firmscope.session import checkpoint_dir
    from firmscope.sources.companies import read_results, write_results

    out = None
    for form in ("parquet", "csv"):
        path = f"{checkpoint_dir(spark).rstrip('/')}/firmscope-results-{form}-{uuid.uuid4().hex}"
        write_results(results(spark, sf), path, form, partition_by="region" if form == "parquet" else None)
        back = read_results(spark, path, form)
        part = back.select(
            F.col("company_id").cast("long").alias("company_id"), "region", "cluster_name", "lead_tier", "anomaly_label", F.col("risk_flags").cast("int").alias("risk_flags"),
            F.col("has_parent").cast("double").alias("has_parent"), r2(F.col("revenue_clean").cast("double")).alias("revenue_clean"), r6(F.col("data_completeness").cast("double")).alias("data_completeness"),
            r6(F.col("anomaly_score").cast("double")).alias("anomaly_score"), F.lit(form).alias("form"))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ over the pipeline's results
@register("kmeans_segments", F_SQL.results_sql("SELECT cluster, cluster_tier, cluster_name, count(*) AS n FROM labelled GROUP BY ALL"))
def kmeans_segments(spark, sf):
    """Cluster tiers and names with their sizes."""
    r = results(spark, sf)
    return r.groupBy("cluster", "cluster_tier", "cluster_name").agg(F.count(F.lit(1)).alias("n"))


@register("cluster_tier_profile", F_SQL.results_sql("SELECT cluster, round(median_revenue, 4) AS median_revenue, entity_mode, size FROM tiers"))
def cluster_tier_profile(spark, sf):
    from firmscope.operators.segment import cluster_tier_profile as ctp

    return ctp(results(spark, sf)).withColumn("median_revenue", F.round("median_revenue", 4))


@register("sidebar_anomalies", F_SQL.results_sql("SELECT company_id, company_name, cluster_name FROM labelled WHERE region = 'ASIA' AND is_anomaly"))
def sidebar_anomalies(spark, sf):
    """Region + anomalies-only view."""
    return Q.sidebar_filter(results(spark, sf), region="ASIA", anomalies_only=True).select("company_id", "company_name", "cluster_name")


@register("market_full_spec", F_SQL.results_sql(
    f"SELECT {LEAD_COLS_SQL}, cluster_name FROM labelled WHERE region = 'AMERICA' AND regexp_matches(sic_description, '(?i)auto|furn') "
    "AND cluster_tier IN (1, 2, 3) AND risk_flags < 2 ORDER BY labelled.lead_score DESC, company_id LIMIT 50"))
def market_full_spec(spark, sf):
    """P2 with tier targets (tier number, not raw label) and high-risk exclusion."""
    spec = Q.MarketSpec(region="AMERICA", industry_keywords=("auto", "furn"), target_tiers=(1, 2, 3), exclude_high_risk=True)
    return Q.top_by(Q.market_filter(results(spark, sf), spec), "lead_score", 50, [*_lead_cols(), "cluster_name"])


@register("sample_scatter", F_SQL.results_sql(
    "SELECT company_id, round(employees_clean, 4) AS employees_clean, round(revenue_clean, 2) AS revenue_clean, cluster_name FROM labelled "
    f"ORDER BY {hash52_sql('company_id', '7')}, company_id LIMIT 1000"))
def sample_scatter(spark, sf):
    s = Q.sample_scatter(results(spark, sf).select("company_id", "employees_clean", "revenue_clean", "cluster_name"), 1000)
    return s.withColumns({"employees_clean": F.round("employees_clean", 4), "revenue_clean": r2("revenue_clean")})


@register("market_facts", F_SQL.results_sql(market_facts_sql(MARKET_WHERE.replace("prepared", "labelled"), "'EUROPE'", 1e5, "min_revenue")))
def market_facts(spark, sf):
    """G6, flattened as ``labelled_market_facts`` is."""
    m = Q.market_filter(results(spark, sf), MARKET)
    return flat_market_facts(G.market_facts(m, Q.country_breakdown(m), spec=MARKET), "min_revenue")


@register("score_companies", F_SQL.results_sql(
    "SELECT company_id, cluster_name, round(lead_score, 6) AS lead_score, lead_tier, anomaly_label, round(revenue_clean, 2) AS revenue_clean, "
    "round(employees_clean, 4) AS employees_clean, round(company_age, 6) AS company_age FROM labelled"))
def score_companies_q(spark, sf):
    """Score the company table as new rows with the stored models
    (saved to and loaded from the checkpoint folder first)."""
    from firmscope.plans.pipeline import score_companies
    from firmscope.sources.models import load_models, save_models
    from firmscope.session import checkpoint_dir
    import uuid

    results(spark, sf)
    models = results_models(spark, sf)
    path = f"{checkpoint_dir(spark).rstrip('/')}/firmscope-models-{uuid.uuid4().hex}"
    save_models(models, path)
    loaded = load_models(spark, path)
    return _scored_columns(score_companies(companies_raw(spark, sf), loaded))


def _scored_columns(out):
    return out.select(
        "company_id", "cluster_name", r6("lead_score").alias("lead_score"), "lead_tier", "anomaly_label", r2("revenue_clean").alias("revenue_clean"),
        F.round("employees_clean", 4).alias("employees_clean"), r6("company_age").alias("company_age"))


# ------------------------------------------------------------------ validation
# fixed values: components and planted labels of the embeddings table
EMBEDDING_WIDTH, EMBEDDING_LABELS = 64, 10
VALIDATION_Z = [f"z_{c}" for c in VALIDATION_FEATURES]
_VALIDATION: dict = {}


def _validation_base(spark, sf):
    """The validation features of every company, standardised, with the label of the base fit."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _VALIDATION:
        from firmscope.operators.segment import cluster_matrix, kmeans_assign, kmeans_fit

        r = prepared(spark, sf).withColumn(
            "revenue_per_employee_v",
            F.col("revenue_clean") / F.when(F.col("employees_clean") == 0, F.lit(1.0)).otherwise(F.col("employees_clean")),
        ).fillna(0.0, subset=list(VALIDATION_FEATURES))
        z, _, _ = cluster_matrix(r, VALIDATION_FEATURES)
        z = cut_lineage(z.select("company_id", *VALIDATION_FEATURES, *VALIDATION_Z), "validation-features")
        centres = kmeans_fit(z, "company_id", VALIDATION_Z, 5, 10, 42).centres
        _VALIDATION[key] = cut_lineage(kmeans_assign(z, VALIDATION_Z, centres).withColumnRenamed("cluster", "base"), "validation-base")
    return _VALIDATION[key]


@register("bootstrap_ari", F_SQL.bootstrap_sql("SELECT run, round(ari, 6) AS ari FROM boot_ari"))
def bootstrap_ari(spark, sf):
    """V2: 20 bootstrap refits (5 starts each), ARI vs the base labels."""
    key = ("boot", spark.sparkContext.applicationId, sf)
    if key not in _VALIDATION:
        base = _validation_base(spark, sf)
        _VALIDATION[key] = cut_lineage(V.bootstrap_ari(base, "company_id", VALIDATION_Z, "base", runs=20, k=5, starts=5), "bootstrap")
    return _VALIDATION[key].select("run", r6("ari").alias("ari"))


@register("ari_histogram", F_SQL.bootstrap_sql(
    "SELECT CAST(least(floor((ari - lo) / w), 9) AS BIGINT) AS bin, round(lo + least(floor((ari - lo) / w), 9) * w, 6) AS bin_start, count(*) AS n, round(any_value(mean), 6) AS mean_ari "
    "FROM (SELECT round(ari, 6) AS ari FROM boot_ari), (SELECT min(round(ari, 6)) AS lo, (max(round(ari, 6)) - min(round(ari, 6))) / 10 AS w, avg(round(ari, 6)) AS mean FROM boot_ari) GROUP BY 1, 2"))
def ari_histogram(spark, sf):
    """V7: 10-bin histogram of the bootstrap ARIs and their mean."""
    b = bootstrap_ari(spark, sf)
    h = Q.range_histogram(b, "ari", 10)
    mean = Q.stat_row(b.agg(F.avg("ari").alias("mean_ari")))["mean_ari"]
    return h.select("bin", r6("bin_start").alias("bin_start"), "n", F.round(F.lit(mean).cast("double"), 6).alias("mean_ari"))


@register("cluster_predictor")
def cluster_predictor(spark, sf):
    """V4, V6: random forest (50 trees, 70/30) predicting the base labels."""
    _, test, acc = V.cluster_predictor(_validation_base(spark, sf), list(VALIDATION_FEATURES), "base", "company_id")
    return spark.createDataFrame([(float(acc), test.count())], "accuracy double, test_rows long")


@register("permutation_importance")
def permutation_importance(spark, sf):
    """V5: mean accuracy drop per shuffled feature, 5 repeats."""
    model, test, _ = V.cluster_predictor(_validation_base(spark, sf), list(VALIDATION_FEATURES), "base", "company_id")
    return V.permutation_importance(model, test.drop("features"), list(VALIDATION_FEATURES), "company_id", repeats=5)


@register("k_sweep", F_SQL.sweep_sql())
def k_sweep(spark, sf):
    """Cost and silhouette for k = 2..8 on the cluster features."""
    from firmscope.operators.segment import cluster_matrix

    z, _, _ = cluster_matrix(prepared(spark, sf), CLUSTER_FEATURES)
    sweep = X.k_sweep(z, "company_id", [f"z_{c}" for c in CLUSTER_FEATURES])
    return sweep.select("k", F.round("cost", 4).alias("cost"), r6("silhouette").alias("silhouette"))


#: Boosting rounds of the registered query (the operator's default is 100).
TIER_ROUNDS = 30


@register("tier_classifier")
def tier_classifier(spark, sf):
    """Boosted trees for the lead tier (four classes) and for
    Hot-or-Priority, trained together on 70 % of the companies; test accuracy of each."""
    from firmscope.config import TIER_LABELS
    from firmscope.operators import boosting as B

    feats = ["log_revenue", "log_employees", "entity_score", "revenue_per_employee", "company_age", "is_domestic_ultimate_clean",
             "market_value_clean", "it_spend_per_emp", "data_completeness"]
    df = prepared(spark, sf).filter(F.col("lead_tier").isNotNull()).withColumn("hot_or_priority", F.col("lead_tier").isin("Hot", "Priority").cast("string"))
    train, test = V.hashed_split(df.select("company_id", "lead_tier", "hot_or_priority", *feats), "company_id", 0.7, 42)
    model = B.fit(train, "company_id", feats, {"lead_tier": list(TIER_LABELS), "hot_or_priority": ["false", "true"]}, rounds=TIER_ROUNDS)
    return spark.createDataFrame([(t, float(a)) for t, a in B.accuracy(test, model).items()], "model string, accuracy double")


@register("impute_cv", F_SQL.impute_cv_sql())
def impute_cv(spark, sf):
    """5-fold CV of the kNN imputer for k in 1, 3, 5, 7, 10 (log scale),
    with the one-standard-error choice per target."""
    from firmscope.config import DEFAULT as cfg
    from firmscope.operators.impute import impute_cv as cv
    from firmscope.plans.pipeline import clean_stage

    clean = cut_lineage(clean_stage(companies_raw(spark, sf)), "cv-clean")
    groups = set(cfg.entity_map_impute.values()) | {cfg.entity_default}
    out = cv(clean, "company_id", "log_rev_in", "log_emp_in", "entity_ord", groups)
    return out.select("target", "k", r6("mse").alias("mse"), r6("se").alias("se"), "chosen")


@register("embeddings_kmeans_ari", F_SQL.embeddings_sql(EMBEDDING_WIDTH, EMBEDDING_LABELS))
def embeddings_kmeans_ari(spark, sf):
    """K1 + V3 on data with known structure: k-means (k = number of planted
    labels, best of 10 starts) on the embedding vectors, ARI against the
    planted labels."""
    emb = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding")
    cols = [f"x{j}" for j in range(EMBEDDING_WIDTH)]
    wide = cut_lineage(emb.select("vec_id", "label", *[F.col("embedding")[j].cast("double").alias(c) for j, c in enumerate(cols)]), "embeddings")
    pts = lloyd.points(wide, "vec_id", cols, ("label",))
    chosen = lloyd.best(lloyd.fit(pts, [lloyd.Replica(EMBEDDING_LABELS, s) for s in range(10)]))
    ari = V.ari_of_counts(lloyd.contingency(pts, "label", [chosen]))
    return ari.select("n", r6("ari").alias("ari"), F.lit(EMBEDDING_LABELS).alias("k"))


@register("score_companies_evaluator", F_SQL.EVALUATOR_RESULTS_SQL + (
    "SELECT company_id, cluster_name, round(lead_score, 6) AS lead_score, lead_tier, anomaly_label, round(revenue_clean, 2) AS revenue_clean, "
    "round(employees_clean, 4) AS employees_clean, round(company_age, 6) AS company_age FROM evaluator_results"))
def score_companies_evaluator(spark, sf):
    """E1 with the reference evaluator's rules (D1, D12, I6 variants) over the
    whole company table, with the pipeline's stored models."""
    from firmscope.plans.pipeline import score_companies

    return _scored_columns(score_companies(companies_raw(spark, sf), results_models(spark, sf), variant="evaluator"))


@register("evaluator_scores", EVALUATOR_SQL + (
    "SELECT company_id, round(lead_score, 6) AS lead_score, CASE WHEN lead_score >= 75 THEN 'Priority' WHEN lead_score >= 50 THEN 'Hot' "
    "WHEN lead_score >= 30 THEN 'Warm' ELSE 'Cold' END AS lead_tier, round(revenue_clean, 2) AS revenue_clean, "
    "round(employees_clean, 4) AS employees_clean, round(company_age, 6) AS company_age FROM evaluated"))
def evaluator_scores(spark, sf):
    """The deterministic columns of the evaluator variant."""
    from firmscope.plans.pipeline import score_companies

    out = score_companies(companies_raw(spark, sf), results_models(spark, sf), variant="evaluator")
    return out.select(
        "company_id", r6("lead_score").alias("lead_score"), "lead_tier", r2("revenue_clean").alias("revenue_clean"),
        F.round("employees_clean", 4).alias("employees_clean"), r6("company_age").alias("company_age"),
    )
