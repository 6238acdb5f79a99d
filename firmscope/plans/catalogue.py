"""Named queries: a Spark plan over the driver's tables and, where the result
is deterministic, an independent DuckDB statement computing the same table.

Doubles are rounded in both (money to 2 places, other values to 6) because
summation order differs between engines. Every query reads the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmscope.functions import clean as C
from firmscope.functions import scoring as S
from firmscope.operators import queries as Q
from firmscope.operators.benchmark import industry_stats
from firmscope.plans.oracle import ADAPTER_SQL, with_prepared
from firmscope.plans.results import companies_raw, prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r2(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 2)


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


LEAD_COLS_SQL = (
    "company_id, company_name, country, sic_description, round(revenue_clean, 2) AS revenue_clean, "
    "round(employees_clean, 2) AS employees_clean, round(lead_score, 6) AS lead_score, lead_tier"
)


def _lead_cols():
    return [
        "company_id", "company_name", "country", "sic_description", r2("revenue_clean").alias("revenue_clean"),
        r2("employees_clean").alias("employees_clean"), r6("lead_score").alias("lead_score"), "lead_tier",
    ]


# ------------------------------------------------------------------ T1 flagship
@register("top_leads", with_prepared(f"SELECT {LEAD_COLS_SQL}, round(revenue_vs_industry, 6) AS revenue_vs_industry FROM prepared ORDER BY lead_score DESC, company_id LIMIT 50"))
def top_leads(spark, sf):
    df = prepared(spark, sf)
    return Q.top_by(df, "lead_score", 50, [*_lead_cols(), r6("revenue_vs_industry").alias("revenue_vs_industry")])


# ------------------------------------------------------------------ S8, C1–C8
@register(
    "clean_fields",
    with_prepared(
        "SELECT company_id, revenue_raw, employees_raw, is_revenue_missing, is_employees_missing, entity_ord, entity_score, "
        "is_domestic_ultimate_clean, year_found_clean, market_value_clean, it_spend_clean, employees_site_clean, "
        "corporate_family_size, has_parent, sic2 FROM prepared"
    ),
)
def clean_fields(spark, sf):
    return prepared(spark, sf).select(
        "company_id", "revenue_raw", "employees_raw", "is_revenue_missing", "is_employees_missing", "entity_ord",
        "entity_score", "is_domestic_ultimate_clean", "year_found_clean", "market_value_clean", "it_spend_clean",
        "employees_site_clean", "corporate_family_size", "has_parent", "sic2",
    )


# texts as found in the wild, made of the headcount: thousands commas, sign, blanks, currency, exponent, words
@register(
    "clean_strict",
    "WITH " + ADAPTER_SQL
    + ", t AS (SELECT *, CASE company_id % 7 WHEN 0 THEN '1,' || employees_total || '00.50' WHEN 1 THEN ' ' || employees_total || ' ' "
    "WHEN 2 THEN '-' || employees_total WHEN 3 THEN '$' || employees_total WHEN 4 THEN employees_total || 'e2' "
    "WHEN 5 THEN 'about ' || employees_total ELSE '' END AS messy FROM raw)"
    " SELECT company_id, TRY_CAST(trim(replace(revenue_usd, ',', '')) AS DOUBLE) AS revenue_strict,"
    " TRY_CAST(trim(replace(employees_total, ',', '')) AS DOUBLE) AS employees_strict,"
    " TRY_CAST(trim(replace(messy, ',', '')) AS DOUBLE) AS messy_strict FROM t",
)
def clean_strict(spark, sf):
    text, kind = F.col("employees_total"), F.col("company_id") % 7
    messy = (
        F.when(kind == 0, F.concat(F.lit("1,"), text, F.lit("00.50"))).when(kind == 1, F.concat(F.lit(" "), text, F.lit(" ")))
        .when(kind == 2, F.concat(F.lit("-"), text)).when(kind == 3, F.concat(F.lit("$"), text)).when(kind == 4, F.concat(text, F.lit("e2")))
        .when(kind == 5, F.concat(F.lit("about "), text)).otherwise(F.lit(""))
    )
    raw = companies_raw(spark, sf).withColumn("messy", messy)
    return raw.select(
        "company_id", C.clean_number_strict("revenue_usd").alias("revenue_strict"),
        C.clean_number_strict("employees_total").alias("employees_strict"), C.clean_number_strict("messy").alias("messy_strict"),
    )


# ------------------------------------------------------------------ I1–I3, J5
@register(
    "knn_imputed",
    with_prepared(
        "SELECT company_id, is_revenue_missing, is_employees_missing, round(revenue_clean, 2) AS revenue_clean, "
        "round(employees_clean, 4) AS employees_clean FROM prepared"
    ),
)
def knn_imputed(spark, sf):
    return prepared(spark, sf).select(
        "company_id", "is_revenue_missing", "is_employees_missing", r2("revenue_clean").alias("revenue_clean"),
        F.round("employees_clean", 4).alias("employees_clean"),
    )


# ------------------------------------------------------------------ F1–F8, I5
@register(
    "company_features",
    with_prepared(
        "SELECT company_id, round(company_age, 6) AS company_age, round(it_spend_per_emp, 6) AS it_spend_per_emp, "
        "round(revenue_per_employee, 4) AS revenue_per_employee, round(log_revenue, 6) AS log_revenue, "
        "round(log_employees, 6) AS log_employees, round(data_completeness, 6) AS data_completeness FROM prepared"
    ),
)
def company_features(spark, sf):
    return prepared(spark, sf).select(
        "company_id", r6("company_age").alias("company_age"), r6("it_spend_per_emp").alias("it_spend_per_emp"),
        F.round("revenue_per_employee", 4).alias("revenue_per_employee"), r6("log_revenue").alias("log_revenue"),
        r6("log_employees").alias("log_employees"), r6("data_completeness").alias("data_completeness"),
    )


# ------------------------------------------------------------------ A1, S7, J1, B1
@register(
    "industry_stats",
    with_prepared(
        "SELECT sic2 AS sic_2digit, round(median(revenue_clean), 4) AS ind_revenue_median, round(avg(revenue_clean), 2) AS ind_revenue_mean, "
        "round(stddev_samp(revenue_clean), 2) AS ind_revenue_std, count(revenue_clean) AS ind_count, "
        "round(median(employees_clean), 4) AS ind_employees_median, round(avg(employees_clean), 4) AS ind_employees_mean, "
        "round(stddev_samp(employees_clean), 4) AS ind_employees_std FROM prepared GROUP BY sic2"
    ),
)
def industry_stats_q(spark, sf):
    st = industry_stats(prepared(spark, sf))
    return st.select(
        "sic_2digit", F.round("ind_revenue_median", 4).alias("ind_revenue_median"), r2("ind_revenue_mean").alias("ind_revenue_mean"),
        r2("ind_revenue_std").alias("ind_revenue_std"), "ind_count",
        F.round("ind_employees_median", 4).alias("ind_employees_median"), F.round("ind_employees_mean", 4).alias("ind_employees_mean"),
        F.round("ind_employees_std", 4).alias("ind_employees_std"),
    )


@register(
    "benchmark_position",
    with_prepared(
        "SELECT company_id, sic2, round(ind_rev_med, 4) AS ind_rev_med, round(revenue_vs_industry, 4) AS revenue_vs_industry, "
        "round(employees_vs_industry, 4) AS employees_vs_industry FROM prepared"
    ),
)
def benchmark_position(spark, sf):
    return prepared(spark, sf).select(
        "company_id", "sic2", F.round("ind_rev_med", 4).alias("ind_rev_med"), F.round("revenue_vs_industry", 4).alias("revenue_vs_industry"),
        F.round("employees_vs_industry", 4).alias("employees_vs_industry"),
    )


# ------------------------------------------------------------------ L1, L2
@register(
    "lead_scores",
    with_prepared(
        "SELECT company_id, round(lead_score, 6) AS lead_score, lead_tier, "
        "CASE WHEN lead_score >= 75 THEN 'Priority' WHEN lead_score >= 50 THEN 'Hot' WHEN lead_score >= 30 THEN 'Warm' ELSE 'Cold' END AS tier_evaluator, "
        "CASE WHEN lead_score >= 70 THEN 'Priority' WHEN lead_score >= 50 THEN 'Hot' WHEN lead_score >= 30 THEN 'Warm' ELSE 'Cold' END AS tier_dashboard "
        "FROM prepared"
    ),
)
def lead_scores(spark, sf):
    df = prepared(spark, sf)
    return df.select(
        "company_id", r6("lead_score").alias("lead_score"), "lead_tier",
        S.lead_tier(F.col("lead_score"), "evaluator").alias("tier_evaluator"),
        S.lead_tier(F.col("lead_score"), "dashboard").alias("tier_dashboard"),
    )


# ------------------------------------------------------------------ R1–R3
@register(
    "rule_risks",
    with_prepared(
        "SELECT company_id, risk_shell, risk_data_quality, risk_orphan_sub, "
        "CAST(risk_shell AS INTEGER) + CAST(risk_data_quality AS INTEGER) + CAST(risk_orphan_sub AS INTEGER) AS rule_flags FROM prepared"
    ),
)
def rule_risks(spark, sf):
    df = prepared(spark, sf)
    return df.select(
        "company_id", "risk_shell", "risk_data_quality", "risk_orphan_sub",
        S.risk_flags(F.col("risk_shell"), F.col("risk_data_quality"), F.col("risk_orphan_sub")).alias("rule_flags"),
    )


# ------------------------------------------------------------------ A3, A6, A7
@register("lead_tier_counts", with_prepared(
    "SELECT CAST(count_if(lead_score >= 70) AS BIGINT) AS priority, CAST(count_if(lead_score >= 50 AND lead_score < 70) AS BIGINT) AS hot, "
    "CAST(count_if(lead_score >= 30 AND lead_score < 50) AS BIGINT) AS warm, CAST(count_if(lead_score < 30) AS BIGINT) AS cold FROM prepared"))
def lead_tier_counts(spark, sf):
    return Q.lead_tier_counts(prepared(spark, sf))


for _col in ("region", "lead_tier", "sic_description", "country"):
    def _vc(spark, sf, _c=_col):
        return Q.value_counts(prepared(spark, sf), _c)
    register(f"value_counts_{_col}", with_prepared(
        f"SELECT {_col}, count(*) AS n FROM prepared WHERE {_col} IS NOT NULL GROUP BY {_col}"))(_vc)


@register("score_histogram", with_prepared(
    "SELECT CAST(least(floor(lead_score / 5.0), 19) AS BIGINT) AS bin, least(floor(lead_score / 5.0), 19) * 5.0 AS bin_start, "
    "count(*) AS n FROM prepared WHERE lead_score IS NOT NULL GROUP BY 1, 2"))
def score_histogram(spark, sf):
    return Q.histogram(prepared(spark, sf), "lead_score", 5.0, 20)


@register("overview_kpis", with_prepared(
    "SELECT count(*) AS companies, round(avg(revenue_clean), 2) AS avg_revenue, round(avg(employees_clean), 4) AS avg_employees, "
    "CAST(count_if(risk_shell) AS BIGINT) AS shells FROM prepared"))
def overview_kpis(spark, sf):
    return prepared(spark, sf).agg(
        F.count(F.lit(1)).alias("companies"), r2(F.avg("revenue_clean")).alias("avg_revenue"),
        F.round(F.avg("employees_clean"), 4).alias("avg_employees"), F.count_if("risk_shell").alias("shells"),
    )


# ------------------------------------------------------------------ P2, A8, A9, A10, T2
MARKET = Q.MarketSpec(region="EUROPE", country="nation_1", industry_keywords=("machin", "build"), min_revenue=1e5)
MARKET_WHERE = (
    "(NOT EXISTS (SELECT 1 FROM prepared WHERE region = 'EUROPE') OR region = 'EUROPE') "
    "AND COALESCE(contains(lower(trim(country)), 'nation_1'), false) "
    "AND COALESCE(regexp_matches(sic_description, '(?i)machin|build'), false) AND revenue_clean >= 100000.0"
)


def _market(spark, sf):
    return Q.market_filter(prepared(spark, sf), MARKET)


@register("market_summary", with_prepared(
    f", m AS (SELECT * FROM prepared WHERE {MARKET_WHERE}) "
    "SELECT count(*) AS companies, round(avg(lead_score), 6) AS avg_lead_score, count(DISTINCT country) AS countries, "
    "round(median(revenue_clean), 4) AS median_revenue FROM m"))
def market_summary(spark, sf):
    s = Q.market_summary(_market(spark, sf))
    return s.select("companies", r6("avg_lead_score").alias("avg_lead_score"), "countries", F.round("median_revenue", 4).alias("median_revenue"))


@register("country_breakdown", with_prepared(
    f", m AS (SELECT * FROM prepared WHERE {MARKET_WHERE}) "
    "SELECT country, count(*) AS companies, round(avg(lead_score), 6) AS avg_lead_score, round(median(revenue_clean), 4) AS median_revenue "
    "FROM m WHERE country IS NOT NULL GROUP BY country ORDER BY companies DESC, country LIMIT 10"))
def country_breakdown(spark, sf):
    s = Q.country_breakdown(_market(spark, sf))
    return s.select("country", "companies", r6("avg_lead_score").alias("avg_lead_score"), F.round("median_revenue", 4).alias("median_revenue"))


@register("top_prospects", with_prepared(
    f", m AS (SELECT * FROM prepared WHERE {MARKET_WHERE}) SELECT {LEAD_COLS_SQL} FROM m ORDER BY lead_score DESC, company_id LIMIT 50"))
def top_prospects(spark, sf):
    return Q.top_by(_market(spark, sf), "lead_score", 50, _lead_cols())


@register("top_industries", with_prepared(
    f", m AS (SELECT * FROM prepared WHERE {MARKET_WHERE}) "
    "SELECT sic_description, count(*) AS n FROM m WHERE sic_description IS NOT NULL GROUP BY 1 ORDER BY n DESC, sic_description LIMIT 5"))
def top_industries(spark, sf):
    return Q.value_counts(_market(spark, sf), "sic_description", 5)


@register("market_all_regions", with_prepared(
    "SELECT count(*) AS companies, round(avg(lead_score), 6) AS avg_lead_score FROM prepared "
    "WHERE (NOT EXISTS (SELECT 1 FROM prepared WHERE region = 'ATLANTIS') OR region = 'ATLANTIS') AND employees_clean >= 50 AND employees_clean <= 5000"))
def market_all_regions(spark, sf):
    """Unknown region is ignored; employee bounds applied (spec fields the
    reference carried but never applied)."""
    m = Q.market_filter(prepared(spark, sf), Q.MarketSpec(region="ATLANTIS", min_employees=50, max_employees=5000))
    return m.agg(F.count(F.lit(1)).alias("companies"), r6(F.avg("lead_score")).alias("avg_lead_score"))


# ------------------------------------------------------------------ P3, T4, P4
@register("search_page", with_prepared(
    ", s AS (SELECT * FROM prepared WHERE COALESCE(regexp_matches(company_name, '(?i)customer#0+1'), false)) "
    "SELECT company_id, company_name, country, round(revenue_clean, 2) AS revenue_clean, "
    "CAST(greatest(1, ceil((SELECT count(*) FROM s) / 50.0)) AS BIGINT) AS total_pages "
    "FROM s ORDER BY company_id LIMIT 50 OFFSET 50"))
def search_page(spark, sf):
    s = Q.search_name(prepared(spark, sf), "customer#0+1")
    p = Q.page(s.select("company_id", "company_name", "country", r2("revenue_clean").alias("revenue_clean")), 2, 50)
    return p


@register("company_lookup", with_prepared(
    ", names AS (SELECT DISTINCT company_name FROM prepared WHERE lead_tier = 'Priority') "
    ", hits AS (SELECT p.*, row_number() OVER (PARTITION BY p.company_name ORDER BY p.company_id) AS rk FROM prepared p JOIN names USING (company_name)) "
    "SELECT company_id, company_name, round(lead_score, 6) AS lead_score FROM hits WHERE rk = 1"))
def company_lookup(spark, sf):
    df = prepared(spark, sf)
    names = df.filter(F.col("lead_tier") == "Priority").select("company_name")
    return Q.company_lookup(df, names).select("company_id", "company_name", r6("lead_score").alias("lead_score"))


# ------------------------------------------------------------------ J4
@register("compare_with_leader", with_prepared(
    ", leader AS (SELECT sic2, company_id AS id_b FROM (SELECT sic2, company_id, row_number() OVER (PARTITION BY sic2 ORDER BY revenue_clean DESC, company_id) AS rk FROM prepared) WHERE rk = 1) "
    ", pairs AS (SELECT p.company_id AS id_a, l.id_b FROM prepared p JOIN leader l USING (sic2) WHERE p.company_id <> l.id_b) "
    "SELECT id_a, id_b, metric, round(value_a, 2) AS value_a, round(value_b, 2) AS value_b FROM ("
    " SELECT id_a, id_b, 'employees_clean' AS metric, a.employees_clean AS value_a, b.employees_clean AS value_b FROM pairs JOIN prepared a ON a.company_id = id_a JOIN prepared b ON b.company_id = id_b"
    " UNION ALL SELECT id_a, id_b, 'revenue_clean', a.revenue_clean, b.revenue_clean FROM pairs JOIN prepared a ON a.company_id = id_a JOIN prepared b ON b.company_id = id_b)"))
def compare_with_leader(spark, sf):
    """Every company beside its industry's revenue leader (pairs table built
    from the data; the leader per SIC-2 is a top-1 per group)."""
    from firmscope.operators.stats import bounded_broadcast, smallest_k_per_group

    df = prepared(spark, sf)
    leader = smallest_k_per_group(df, ["sic2"], [F.col("revenue_clean").desc(), F.col("company_id")], 1).select(
        "sic2", F.col("company_id").alias("id_b")
    )
    pairs = df.select("sic2", F.col("company_id").alias("id_a")).join(bounded_broadcast(leader), "sic2").filter(F.col("id_a") != F.col("id_b"))
    out = Q.compare_companies(df, pairs.select("id_a", "id_b"))
    return out.select("id_a", "id_b", "metric", r2("value_a").alias("value_a"), r2("value_b").alias("value_b"))


# ------------------------------------------------------------------ A14, A16, A17, A18
@register("global_medians", with_prepared(
    "SELECT round(median(revenue_clean), 4) AS median_revenue, "
    "round(median(revenue_clean / CASE WHEN employees_clean = 0 THEN 1.0 ELSE employees_clean END), 4) AS median_productivity FROM prepared"))
def global_medians(spark, sf):
    g = Q.global_medians(prepared(spark, sf))
    return g.select(F.round("median_revenue", 4).alias("median_revenue"), F.round("median_productivity", 4).alias("median_productivity"))


LOG_EFF_SQL = "ln(1 + revenue_clean / CASE WHEN employees_clean = 0 THEN 1.0 ELSE employees_clean END)"


def _log_eff():
    return F.log1p(F.col("revenue_clean") / F.when(F.col("employees_clean") == 0, F.lit(1.0)).otherwise(F.col("employees_clean")))


@register("group_moments", with_prepared(
    f"SELECT lead_tier, count({LOG_EFF_SQL}) AS n, round(avg({LOG_EFF_SQL}), 6) AS mean, round(var_samp({LOG_EFF_SQL}), 6) AS var "
    "FROM prepared WHERE lead_tier IS NOT NULL GROUP BY lead_tier"))
def group_moments(spark, sf):
    g = Q.group_moments(prepared(spark, sf), "lead_tier", _log_eff())
    return g.select("lead_tier", "n", r6("mean").alias("mean"), r6("var").alias("var"))


@register("box_summary", with_prepared(
    f", b AS (SELECT lead_tier, {LOG_EFF_SQL} AS v FROM prepared WHERE lead_tier IS NOT NULL) "
    ", q AS (SELECT lead_tier, quantile_cont(v, 0.25) AS q1, median(v) AS med, quantile_cont(v, 0.75) AS q3 FROM b WHERE v IS NOT NULL GROUP BY lead_tier) "
    "SELECT q.lead_tier, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, "
    "round(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END), 6) AS whisker_low, round(max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_high "
    "FROM q JOIN b USING (lead_tier) GROUP BY q.lead_tier, q1, med, q3"))
def box_summary(spark, sf):
    df = prepared(spark, sf).withColumn("v", _log_eff())
    b = Q.box_summary(df, "lead_tier", "v")
    return b.select("lead_tier", *[r6(c).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])


@register("distinct_countries_in_region", with_prepared(
    "SELECT DISTINCT country FROM prepared WHERE region = 'ASIA' AND country IS NOT NULL ORDER BY country"))
def distinct_countries_in_region(spark, sf):
    return Q.distinct_values(prepared(spark, sf), "country", where=F.col("region") == "ASIA")


@register("distinct_industries", with_prepared(
    "SELECT DISTINCT sic_description FROM prepared WHERE sic_description IS NOT NULL ORDER BY sic_description LIMIT 50"))
def distinct_industries(spark, sf):
    return Q.distinct_values(prepared(spark, sf), "sic_description", limit=50)


# ------------------------------------------------------------------ T3 (rule-based shells)
@register("top_shells", with_prepared(
    "SELECT company_id, company_name, round(revenue_clean, 2) AS revenue_clean, round(employees_clean, 4) AS employees_clean, sic_description "
    "FROM prepared WHERE risk_shell ORDER BY revenue_clean DESC, company_id LIMIT 10"))
def top_shells(spark, sf):
    df = prepared(spark, sf).filter("risk_shell")
    return Q.top_by(df, "revenue_clean", 10, [
        "company_id", "company_name", r2("revenue_clean").alias("revenue_clean"),
        F.round("employees_clean", 4).alias("employees_clean"), "sic_description",
    ])


def all_queries() -> dict:
    # report-only analytics, validation and model-based queries register on import
    from firmscope.plans import catalogue_labels, catalogue_more  # noqa: F401

    return dict(QUERIES)


def all_oracles() -> dict:
    all_queries()
    return dict(ORACLE)


# ------------------------------------------------------------------ A18: pick list of names, one excluded
@register("distinct_company_names", with_prepared(
    "SELECT DISTINCT company_name FROM prepared WHERE company_name IS NOT NULL AND company_name <> 'Customer#000000001' "
    "ORDER BY company_name LIMIT 500"))
def distinct_company_names(spark, sf):
    """Selection list for the second company of a comparison: distinct names
    (sorted), the first company excluded, capped at 500 as the list is."""
    return Q.distinct_values(prepared(spark, sf), "company_name", limit=500, exclude="Customer#000000001")
