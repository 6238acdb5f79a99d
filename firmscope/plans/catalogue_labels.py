"""Queries over segments and anomalies with a SQL oracle.

Each query over a result table is registered twice: over the pipeline's own
results, whose k-means and forest SQL repeats hash by hash (``oracle_fits``), and over
a table of fixed labels, where companies belong to the nearest of five given centres and
a plain formula over the standardised features stands for the forest's score.
The second kind checks what comes after the fits (assignment, tier names, threshold,
flags, views, report facts) on segments of other shapes.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmscope.config import CLUSTER_FEATURES, RISK_TEXTS
from firmscope.functions import scoring as S
from firmscope.operators import extra as X
from firmscope.operators import iforest as IF
from firmscope.operators import queries as Q
from firmscope.operators import report as G
from firmscope.operators import segment as SG
from firmscope.operators import validate as V
from firmscope.operators.stats import smallest_k_per_group
from firmscope.plans import oracle_fits as OF
from firmscope.plans.catalogue import LEAD_COLS_SQL, _lead_cols, r2, r6, register
from firmscope.plans.oracle import CORE_SQL
from firmscope.plans.pipeline import flag_stage
from firmscope.plans.results import companies_raw, prepared, results, results_models
from firmscope.session import cut_lineage

#: Five centres over the standardised ``CLUSTER_FEATURES``.
CENTRES = (
    (0.9, 0.6, 0.2, 0.7, 0.1, 0.3, -0.5),
    (-0.8, -0.4, 1.1, -0.6, -0.2, 0.2, 0.9),
    (0.2, -1.3, -0.7, 0.1, 0.8, -0.9, 0.3),
    (0.5, 0.9, -0.9, -0.5, -0.3, 0.7, 0.6),
    (-1.1, 0.3, -0.4, 0.9, -0.1, -0.6, -0.7),
)
FEATS = list(CLUSTER_FEATURES)
ZCOLS = [f"z_{c}" for c in FEATS]

_lock = threading.RLock()
_labelled: dict = {}


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """The prepared table with segment, score, label and flags; written once."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    with _lock:
        if key not in _labelled:
            z, _, _ = SG.cluster_matrix(prepared(spark, sf), FEATS)
            gap = F.lit(0.0)
            for c in ZCOLS:
                gap = gap + F.abs(c)
            scored = SG.kmeans_assign(z, ZCOLS, CENTRES).withColumn("iforest_s", gap / (gap + 7.0)).drop(*ZCOLS)
            scored = cut_lineage(scored, "labelled-scores")  # read by the profile, the threshold and the table
            named = SG.attach_cluster_name(scored, SG.name_clusters(SG.cluster_tier_profile(scored)))
            _labelled[key] = cut_lineage(flag_stage(named, IF.anomaly_threshold(scored)), "labelled", partition_by="region")
        return _labelled[key]


def _values() -> str:
    rows = ", ".join(f"({i}, " + ", ".join(f"CAST({v} AS DOUBLE)" for v in c) + ")" for i, c in enumerate(CENTRES))
    return f"SELECT * FROM (VALUES {rows}) AS t(cluster, " + ", ".join(f"c{j}" for j in range(len(FEATS))) + ")"


_D2 = " + ".join(f"(z{j} - c{j}) * (z{j} - c{j})" for j in range(len(FEATS)))
_GAP = " + ".join(f"abs(z{j})" for j in range(len(FEATS)))

LABELLED_SQL = ",\n".join([CORE_SQL.rstrip(), OF.z_columns("prepared", FEATS, "z"), f"centres AS ({_values()})", OF.segment_tail(f"""nearest AS (SELECT company_id, cluster FROM (
  SELECT company_id, cluster, row_number() OVER (PARTITION BY company_id ORDER BY {_D2}, cluster) AS rk FROM zrows, centres) WHERE rk = 1),
assigned AS (SELECT zrows.*, nearest.cluster, ({_GAP}) / (({_GAP}) + 7.0) AS s FROM zrows JOIN nearest USING (company_id))""")])


def with_labelled(select: str) -> str:
    return LABELLED_SQL + select


def both(name: str, select: str, labelled_name: str | None = None):
    """Register a function of a result table twice: as ``name`` over the
    pipeline's results, whose fits SQL follows by their hashes, and as
    ``labelled_<name>`` over the fixed labels."""
    def deco(fn):
        register(name, OF.results_sql(select))(lambda spark, sf: fn(results(spark, sf)))
        register(f"labelled_{labelled_name or name}", with_labelled(select))(lambda spark, sf: fn(labelled(spark, sf)))
        return fn
    return deco


_FLAG_TEXTS = "COALESCE(NULLIF(concat_ws('; ', " + ", ".join(f"CASE WHEN {n} THEN '{t}' END" for n, t in RISK_TEXTS) + "), ''), 'No risk flags detected')"


# ------------------------------------------------------------------ K2–K4, A2, J2
@both("company_segments", ("SELECT company_id, cluster, cluster_tier, cluster_name FROM labelled"), "assignment")
def company_segments(df):
    return df.select("company_id", "cluster", "cluster_tier", "cluster_name")


@both("segment_profile", (
    "SELECT cluster, size, entity_mode, round(median_revenue, 4) AS median_revenue, cluster_tier, cluster_name FROM tiers JOIN names USING (cluster, cluster_tier)"), "segments")
def segment_profile(df):
    profile = SG.cluster_tier_profile(df)
    named = profile.join(SG.name_clusters(profile), "cluster")
    return named.select("cluster", "size", "entity_mode", F.round("median_revenue", 4).alias("median_revenue"), "cluster_tier", "cluster_name")


# ------------------------------------------------------------------ R5–R9, X10
@both("anomalies", ("SELECT company_id, round(anomaly_score, 6) AS anomaly_score, is_anomaly, anomaly_label FROM labelled"))
def anomalies(df):
    return df.select("company_id", r6("anomaly_score").alias("anomaly_score"), "is_anomaly", "anomaly_label")


@both("risk_flags", (
    f"SELECT company_id, risk_flags, {_FLAG_TEXTS} AS flag_texts, CASE WHEN risk_flags > 0 THEN 'Medium' ELSE 'Low' END AS risk_grade FROM labelled"))
def risk_flags(df):
    flags = S.risk_flag_list({name: F.col(name) for name, _ in RISK_TEXTS})
    return df.select(
        "company_id", "risk_flags", F.concat_ws("; ", flags).alias("flag_texts"), S.risk_grade(F.col("risk_flags")).alias("risk_grade"))


_EDGES = "(SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM labelled)"


@both("anomaly_histogram", (
    "SELECT CAST(least(floor((anomaly_score - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n, "
    f"round(min(anomaly_score), 6) AS min_score, CAST(count_if(anomaly_score < 0) AS BIGINT) AS below_cut FROM labelled, {_EDGES} GROUP BY 1"))
def anomaly_histogram(df):
    return X.anomaly_histogram(df).select("bin", "n", r6("min_score").alias("min_score"), "below_cut")


# ------------------------------------------------------------------ A4, A5, A12, P1, T3, A18
@both("risk_summary", (
    "SELECT CAST(count_if(risk_shell) AS BIGINT) AS shells, CAST(count_if(is_anomaly) AS BIGINT) AS anomalies, "
    "CAST(count_if(risk_flags >= 2) AS BIGINT) AS high_risk, round(avg(CASE WHEN risk_flags > 0 THEN 100.0 ELSE 0.0 END), 6) AS risk_rate_pct FROM labelled"))
def risk_summary(df):
    return df.agg(
        F.count_if("risk_shell").alias("shells"), F.count_if(F.col("anomaly_label") == "Anomaly").alias("anomalies"),
        F.count_if(F.col("risk_flags") >= 2).alias("high_risk"), r6(F.avg((F.col("risk_flags") > 0).cast("double")) * 100).alias("risk_rate_pct"))


@both("dataset_stats", (
    "SELECT count(*) AS companies, count(DISTINCT cluster) AS clusters, CAST(count_if(is_anomaly) AS BIGINT) AS anomalies, "
    "round(count_if(is_anomaly) * 100.0 / count(*), 6) AS anomaly_pct FROM labelled"))
def dataset_stats(df):
    odd = F.count_if(F.col("anomaly_label") == "Anomaly")
    return df.agg(
        F.count(F.lit(1)).alias("companies"), F.countDistinct("cluster").alias("clusters"), odd.alias("anomalies"),
        r6(odd.cast("double") * 100 / F.count(F.lit(1))).alias("anomaly_pct"))


@both("overview_with_anomalies", (
    "SELECT count(*) AS companies, round(avg(revenue_clean), 2) AS avg_revenue, round(avg(employees_clean), 4) AS avg_employees, "
    "CAST(count_if(is_anomaly) AS BIGINT) AS anomalies FROM labelled WHERE region = 'EUROPE'"), "overview")
def overview_with_anomalies(df):
    return Q.sidebar_filter(df, region="EUROPE").agg(
        F.count(F.lit(1)).alias("companies"), r2(F.avg("revenue_clean")).alias("avg_revenue"),
        F.round(F.avg("employees_clean"), 4).alias("avg_employees"), F.count_if(F.col("anomaly_label") == "Anomaly").alias("anomalies"))


@register("labelled_sidebar", with_labelled(
    "SELECT company_id, company_name FROM labelled WHERE region = 'ASIA' AND cluster_name = 'Tier 1 Global HQ' AND is_anomaly"))
def labelled_sidebar(spark, sf):
    v = Q.sidebar_filter(labelled(spark, sf), region="ASIA", cluster="Tier 1 Global HQ", anomalies_only=True)
    return v.select("company_id", "company_name")


@both("value_counts_cluster", ("SELECT cluster_name, count(*) AS n FROM labelled GROUP BY cluster_name"))
def value_counts_cluster(df):
    return Q.value_counts(df, "cluster_name")


@both("top_anomalies", (
    "SELECT company_id, company_name, round(revenue_clean, 2) AS revenue_clean, round(employees_clean, 4) AS employees_clean, cluster_name "
    "FROM labelled WHERE is_anomaly ORDER BY labelled.revenue_clean DESC, company_id LIMIT 10"))
def top_anomalies(df):
    odd = df.filter(F.col("anomaly_label") == "Anomaly")
    return Q.top_by(odd, "revenue_clean", 10, [
        "company_id", "company_name", r2("revenue_clean").alias("revenue_clean"), F.round("employees_clean", 4).alias("employees_clean"), "cluster_name"])


@both("anomaly_names", (
    "SELECT DISTINCT company_name FROM labelled WHERE is_anomaly AND company_name IS NOT NULL ORDER BY company_name LIMIT 20"))
def anomaly_names(df):
    return Q.distinct_values(df.filter(F.col("anomaly_label") == "Anomaly"), "company_name", limit=20)


# ------------------------------------------------------------------ P2, G6, G7: a saved reply drives the market filter
SPEC_REPLY = """```json
{"region": "AMERICA", "country": null, "industry_keywords": ["auto", "furn", "build"], "min_revenue": 1000,
 "max_revenue": 50000000, "target_tiers": [1, 2, 3], "exclude_high_risk": true, "limit": 50}
```"""
SPEC_WHERE = (
    "region = 'AMERICA' AND regexp_matches(sic_description, '(?i)auto|furn|build') AND revenue_clean >= 1000 AND revenue_clean <= 50000000 "
    "AND cluster_tier IN (1, 2, 3) AND risk_flags < 2"
)


def _spec_market(spark, sf):
    reply = G.parse_responses(spark.createDataFrame([(SPEC_REPLY,)], "reply string"), schema=G.SPEC_REPLY_SCHEMA)
    spec = Q.market_spec(reply.select("parsed.*").first().asDict())
    return Q.market_filter(labelled(spark, sf), spec), spec


@register("labelled_market", with_labelled(
    f"SELECT {LEAD_COLS_SQL}, cluster_name FROM labelled WHERE {SPEC_WHERE} ORDER BY labelled.lead_score DESC, company_id LIMIT 50"))
def labelled_market(spark, sf):
    market, spec = _spec_market(spark, sf)
    return Q.top_by(market, "lead_score", spec.limit, [*_lead_cols(), "cluster_name"])


def market_facts_sql(where: str, region: str, bound: float, bound_name: str) -> str:
    return (
        f", m AS (SELECT * FROM labelled WHERE {where}), "
        "ct AS (SELECT country, count(*) AS companies FROM m WHERE country IS NOT NULL GROUP BY country ORDER BY companies DESC, country LIMIT 10), "
        "inds AS (SELECT sic_description, count(*) AS n FROM m WHERE sic_description IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5) "
        "SELECT (SELECT count(*) FROM m) AS total_companies, (SELECT round(median(revenue_clean), 4) FROM m) AS median_revenue, "
        "(SELECT round(avg(lead_score), 6) FROM m) AS avg_lead_score, "
        "(SELECT string_agg(country || '=' || CAST(companies AS VARCHAR), ';' ORDER BY country) FROM ct) AS countries, "
        "(SELECT string_agg(sic_description || '=' || CAST(n AS VARCHAR), ';' ORDER BY sic_description) FROM inds) AS top_industries, "
        f"{region} AS filtered_region, CAST({bound} AS DOUBLE) AS filtered_{bound_name}")


def flat_market_facts(f: DataFrame, bound_name: str) -> DataFrame:
    """G6, flattened: lists as ``name=count`` texts by name, two of the filters."""
    def text(pairs):  # by name
        return F.concat_ws(";", F.transform(F.array_sort(pairs), lambda p: F.concat(p["name"], F.lit("="), p["n"].cast("string"))))

    countries = F.transform("countries", lambda c: F.struct(c["country"].alias("name"), c["companies"].alias("n")))
    industries = F.transform(F.map_entries("top_industries"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("n")))
    return f.select(
        "total_companies", F.round("median_revenue", 4).alias("median_revenue"), r6("avg_lead_score").alias("avg_lead_score"),
        text(countries).alias("countries"), text(industries).alias("top_industries"),
        F.get_json_object("filters_applied", "$.region").alias("filtered_region"),
        F.get_json_object("filters_applied", f"$.{bound_name}").cast("double").alias(f"filtered_{bound_name}"))


@register("labelled_market_facts", with_labelled(market_facts_sql(SPEC_WHERE, "'AMERICA'", 50000000, "max_revenue")))
def labelled_market_facts(spark, sf):
    market, spec = _spec_market(spark, sf)
    return flat_market_facts(G.market_facts(market, Q.country_breakdown(market), spec=spec), "max_revenue")


# ------------------------------------------------------------------ A11, A13, J3, G2–G5
_PROFILE_SQL = (
    ", top_of AS (SELECT cluster_name, region, sic_description FROM "
    " (SELECT cluster_name, region FROM (SELECT cluster_name, region, row_number() OVER (PARTITION BY cluster_name ORDER BY count(*) DESC, region) AS rk "
    "  FROM labelled WHERE region IS NOT NULL GROUP BY cluster_name, region) WHERE rk = 1) FULL JOIN "
    " (SELECT cluster_name, sic_description FROM (SELECT cluster_name, sic_description, row_number() OVER (PARTITION BY cluster_name ORDER BY count(*) DESC, "
    "  sic_description) AS rk FROM labelled WHERE sic_description IS NOT NULL GROUP BY cluster_name, sic_description) WHERE rk = 1) USING (cluster_name)), "
    "prof AS (SELECT cluster_name, count(*) AS size, round(median(revenue_clean), 4) AS median_revenue, round(median(employees_clean), 4) AS median_employees, "
    " printf('%.1f', round(count(*) * 100.0 / sum(count(*)) OVER (), 1)) || '%' AS percentage FROM labelled GROUP BY cluster_name) "
)


@both("cluster_profiles", (
    _PROFILE_SQL + "SELECT cluster_name, size, median_revenue, median_employees, COALESCE(region, 'N/A') AS top_region, "
    "COALESCE(sic_description, 'N/A') AS top_industry, percentage FROM prof LEFT JOIN top_of USING (cluster_name)"))
def cluster_profiles(df):
    p = G.cluster_profiles(df)
    return p.select("cluster_name", "size", F.round("median_revenue", 4).alias("median_revenue"),
                    F.round("median_employees", 4).alias("median_employees"), "top_region", "top_industry", "percentage")


@both("cluster_facts", (
    _PROFILE_SQL + "SELECT cluster_name AS cluster_id, size AS \"Size\", percentage AS \"Percentage\", median_revenue AS \"Median_Revenue_USD\", "
    "median_employees AS \"Median_Employees\", COALESCE(region, 'N/A') AS \"Top_Region\", COALESCE(sic_description, 'N/A') AS \"Top_Industry\", "
    "'Mixed' AS \"Top_Entity_Type\" FROM prof LEFT JOIN top_of USING (cluster_name)"))
def cluster_facts(df):
    f = G.cluster_facts(df)
    return f.withColumns({c: F.round(c, 4) for c in ("Median_Revenue_USD", "Median_Employees")})


@both("anomaly_facts", (
    ", av AS (SELECT cluster_name, round(avg(revenue_clean), 2) AS cluster_avg_revenue, round(avg(employees_clean), 4) AS cluster_avg_employees "
    "FROM labelled GROUP BY cluster_name) SELECT company_id, cluster_name, round(revenue_clean, 2) AS revenue_clean, round(employees_clean, 4) AS employees_clean, "
    "region, round(company_age, 6) AS company_age, it_spend_clean, market_value_clean, cluster_avg_revenue, cluster_avg_employees "
    "FROM labelled JOIN av USING (cluster_name) WHERE is_anomaly"))
def anomaly_facts(df):
    f = G.anomaly_facts(df)
    return f.withColumns({
        "revenue_clean": r2("revenue_clean"), "employees_clean": F.round("employees_clean", 4), "company_age": r6("company_age"),
        "cluster_avg_revenue": r2("cluster_avg_revenue"), "cluster_avg_employees": F.round("cluster_avg_employees", 4)})


@both("action_facts", (
    "SELECT company_id, cluster_name, round(revenue_clean, 2) AS revenue_clean, round(employees_clean, 4) AS employees_clean, round(lead_score, 6) AS lead_score, "
    "lead_tier, market_value_clean, it_spend_clean, round(company_age, 6) AS company_age, "
    "CAST(is_domestic_ultimate_clean AS DOUBLE) AS is_domestic_ultimate_clean, risk_flags, anomaly_label, risk_shell FROM labelled"))
def action_facts(df):
    """G5; the domestic flag is a cluster feature and thereby a double."""
    f = G.action_facts(df)
    return f.withColumns({"revenue_clean": r2("revenue_clean"), "employees_clean": F.round("employees_clean", 4),
                          "lead_score": r6("lead_score"), "company_age": r6("company_age")})


@both("comparison_facts", (
    ", lead AS (SELECT cluster, company_id AS id_b FROM (SELECT cluster, company_id, row_number() OVER (PARTITION BY cluster ORDER BY revenue_clean DESC, company_id) AS rk "
    "FROM labelled) WHERE rk = 1) SELECT a.company_id AS id_a, id_b, round(a.employees_clean, 4) AS a_employees_clean, round(a.revenue_clean, 2) AS a_revenue_clean, "
    "a.region AS a_region, a.sic_description AS a_sic_description, round(b.employees_clean, 4) AS b_employees_clean, round(b.revenue_clean, 2) AS b_revenue_clean, "
    "b.region AS b_region, b.sic_description AS b_sic_description "
    "FROM labelled a JOIN lead USING (cluster) JOIN labelled b ON b.company_id = id_b WHERE a.company_id <> id_b"))
def comparison_facts(df):
    leader = smallest_k_per_group(df, ["cluster"], [F.col("revenue_clean").desc(), F.col("company_id")], 1).select(
        "cluster", F.col("company_id").alias("id_b"))  # one row per centre
    pairs = df.select("cluster", F.col("company_id").alias("id_a")).join(F.broadcast(leader), "cluster").filter(F.col("id_a") != F.col("id_b"))
    f = G.comparison_facts(df, pairs.select("id_a", "id_b"))
    return f.withColumns({f"{s}_{c}": F.round(f"{s}_{c}", n) for s in "ab" for c, n in (("employees_clean", 4), ("revenue_clean", 2))})


# ------------------------------------------------------------------ G1, G8
_REPLY_JSON = (
    '{"executive_summary": "Grade $", "financial_health": {"health_grade": "A", "key_strength": "cash $5"}, '
    '"risk_assessment": {"overall_risk": "High", "red_flags": ["late filing", "one owner"]}, "recommendation": {"verdict": "Proceed", "timeline": "90 days"}}'
)


def _due_replies(df: DataFrame) -> DataFrame:
    reply = (
        F.when(F.col("company_id") % 5 == 0, F.lit(f"```json\n{_REPLY_JSON}\n```"))
        .when(F.col("company_id") % 5 == 1, F.lit('{"risk_assessment": {"explanation": "costs $9"}}'))
        .when(F.col("company_id") % 5 == 2, F.lit("Error: quota exceeded"))
        .when(F.col("company_id") % 5 == 3, F.lit('{"executive_summary": "cut o'))
    )
    return df.select("company_id", reply.alias("reply")).filter(F.col("reply").isNotNull())


_DD = "company_id % 5"


@both("due_diligence_facts", (
    f"SELECT company_id, 'Mock DD Report for ' || COALESCE(company_name, 'Unknown') || '. Enable LLM for full analysis.' AS executive_summary, "
    f"CASE WHEN risk_flags > 0 THEN 'Medium' ELSE 'Low' END AS overall_risk, risk_flags AS risk_score, {_FLAG_TEXTS} AS flags, "
    "'Enable LLM for detailed risk analysis.' AS explanation, is_domestic_ultimate_clean = 1 AS is_decision_maker, "
    "COALESCE(entity_type, 'N/A') AS entity_type, has_parent = 1 AS has_parent, 'Review Required' AS verdict, "
    "'Enable LLM for specific recommendations' AS action, 'N/A' AS timeline, 'Low (Mock Mode)' AS confidence FROM labelled"), "due_diligence")
def due_diligence_facts(df):
    """G1, flattened (its financial part is ``due_diligence_financials``)."""
    f = G.due_diligence_facts(df)
    return f.select(
        "company_id", "executive_summary", "risk_assessment.overall_risk", "risk_assessment.risk_score",
        F.concat_ws("; ", "risk_assessment.flags").alias("flags"), "risk_assessment.explanation", "hierarchy_analysis.is_decision_maker",
        "hierarchy_analysis.entity_type", "hierarchy_analysis.has_parent", "recommendation.*")


@register("labelled_due_diligence_merged", with_labelled(
    f"SELECT company_id, CASE WHEN {_DD} = 0 THEN 'Grade \\$' ELSE '' END AS executive_summary, "
    f"CASE WHEN {_DD} = 0 THEN 'A' ELSE 'N/A' END AS health_grade, CASE WHEN {_DD} = 0 THEN 'cash \\$5' ELSE '' END AS key_strength, '' AS key_concern, "
    f"CASE WHEN {_DD} = 0 THEN 'High' ELSE 'Unknown' END AS overall_risk, risk_flags AS risk_score, {_FLAG_TEXTS} AS flags, "
    f"CASE WHEN {_DD} = 1 THEN 'costs \\$9' ELSE '' END AS explanation, CASE WHEN {_DD} = 0 THEN 'late filing; one owner' ELSE '' END AS red_flags, "
    f"'' AS mitigating_factors, CASE WHEN {_DD} = 0 THEN 'Proceed' ELSE 'Review Required' END AS verdict, '' AS action, "
    f"CASE WHEN {_DD} = 0 THEN '90 days' ELSE 'N/A' END AS timeline, 'Medium' AS confidence, "
    f"CASE {_DD} WHEN 2 THEN 'Error: quota exceeded' WHEN 3 THEN 'unparsable reply' WHEN 4 THEN 'no reply' END AS error FROM labelled"))
def labelled_due_diligence_merged(spark, sf):
    """G7 + G8, flattened: full, partial, failed, broken and absent replies."""
    df = labelled(spark, sf)
    m = G.merge_due_diligence(G.due_diligence_facts(df), G.parse_responses(_due_replies(df), schema=G.DUE_REPLY_SCHEMA))
    return m.select(
        "company_id", "executive_summary", "financial_health.health_grade", "financial_health.key_strength", "financial_health.key_concern",
        "risk_assessment.overall_risk", "risk_assessment.risk_score", F.concat_ws("; ", "risk_assessment.flags").alias("flags"),
        "risk_assessment.explanation", F.concat_ws("; ", "risk_assessment.red_flags").alias("red_flags"),
        F.concat_ws("; ", "risk_assessment.mitigating_factors").alias("mitigating_factors"), "recommendation.*", "error")


# ------------------------------------------------------------------ V6, V7, E1
@register("labelled_accuracy", with_labelled("SELECT round(avg(CASE WHEN cluster + 1 = cluster_tier THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labelled"))
def labelled_accuracy(spark, sf):
    """V6: share of companies whose centre's number is that of its tier."""
    pred = labelled(spark, sf).select(F.col("cluster").cast("double").alias("label"), (F.col("cluster_tier") - 1.0).alias("prediction"))
    return spark.createDataFrame([(round(float(V.accuracy(pred)), 6),)], "accuracy double")


@register("labelled_histogram", with_labelled(
    ", v AS (SELECT sic2, avg(anomaly_score) AS v FROM labelled GROUP BY sic2), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v) "
    "SELECT CAST(least(floor((v - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin, "
    "round(lo + least(floor((v - lo) / ((hi - lo) / 10)), 9) * ((hi - lo) / 10), 6) AS bin_start, count(*) AS n FROM v, e GROUP BY 1, 2"))
def labelled_histogram(spark, sf):
    """V7's histogram over the range of the values (mean decision value per industry)."""
    per = labelled(spark, sf).groupBy("sic2").agg(F.avg("anomaly_score").alias("v"))
    return Q.range_histogram(cut_lineage(per, "histogram-values"), "v", 10).select("bin", r6("bin_start").alias("bin_start"), "n")


@register("pipeline_scores", CORE_SQL + (
    "SELECT company_id, round(lead_score, 6) AS lead_score, lead_tier, round(revenue_clean, 2) AS revenue_clean, "
    "round(employees_clean, 4) AS employees_clean, round(company_age, 6) AS company_age, risk_shell, risk_data_quality, risk_orphan_sub FROM prepared"))
def pipeline_scores(spark, sf):
    """E1 with the pipeline's rules: the deterministic columns of scored rows."""
    from firmscope.plans.pipeline import score_companies

    out = score_companies(companies_raw(spark, sf), results_models(spark, sf))
    return out.select(
        "company_id", r6("lead_score").alias("lead_score"), "lead_tier", r2("revenue_clean").alias("revenue_clean"),
        F.round("employees_clean", 4).alias("employees_clean"), r6("company_age").alias("company_age"),
        "risk_shell", "risk_data_quality", "risk_orphan_sub")
