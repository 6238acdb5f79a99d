"""Report documents as tables (G1–G8, A11, A13): the facts that go into a
report and the parsing of the replies that come back. Text generation by an
external model is not part of this library."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.functions import scoring as S
from firmscope.functions.features import vs_benchmark
from firmscope.operators.queries import MarketSpec, combine_rows, global_medians, pair_columns, stat_row, value_counts
from firmscope.operators.stats import quantiles

# Defaults used when no benchmark is available (fixed values).
DEFAULT_MEDIAN_REVENUE = 1_000_000.0
DEFAULT_MEDIAN_PRODUCTIVITY = 50_000.0
DEFAULT_VERDICT = "Review Required"
NA_TEXT = "N/A"
# Texts of a report to which no reply was merged (fixed values).
SUMMARY_FORMAT = "Mock DD Report for %s. Enable LLM for full analysis."
EXPLANATION_TEXT = "Enable LLM for detailed risk analysis."
ACTION_TEXT = "Enable LLM for specific recommendations"
CONFIDENCE_TEXT = "Low (Mock Mode)"
UNKNOWN_TEXT = "Unknown"
MERGED_CONFIDENCE = "Medium"


def money(c):
    return F.concat(F.lit("$"), F.format_number(c, 0))


def pct_signed(c):
    return F.concat(F.format_string("%+.0f", c), F.lit("%"))


def productivity(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "productivity", F.when(F.col("employees_clean") > 0, F.col("revenue_clean") / F.col("employees_clean")).otherwise(F.lit(0.0))
    )


def benchmarks(df: DataFrame, scope: str = "industry") -> DataFrame:
    """Attach bench_revenue / bench_productivity: per-industry medians
    (default) or the global medians the reference used."""
    df = productivity(df)
    if scope == "global":
        g = stat_row(global_medians(df))  # two fitted numbers
        return df.withColumns({"bench_revenue": F.lit(g.get("median_revenue")).cast("double"),
                               "bench_productivity": F.lit(g.get("median_productivity")).cast("double")})
    rpe = F.col("revenue_clean") / F.when(F.col("employees_clean") == 0, F.lit(1.0)).otherwise(F.col("employees_clean"))
    med = quantiles(df.withColumn("_rpe", rpe), ["revenue_clean", "_rpe"], ["sic2"], 0.5, ["bench_revenue", "bench_productivity"])
    return df.join(med, "sic2", "left")  # one row per SIC-2 prefix; Spark broadcasts it by its size


def financial_facts(df: DataFrame, scope: str = "industry", keep: tuple = ()) -> DataFrame:
    """Flat financial-health facts with the reference's text formats; columns in ``keep`` go along."""
    b = benchmarks(df, scope)
    rev_med = F.coalesce(F.col("bench_revenue"), F.lit(DEFAULT_MEDIAN_REVENUE))
    prod_med = F.coalesce(F.col("bench_productivity"), F.lit(DEFAULT_MEDIAN_PRODUCTIVITY))
    rv = vs_benchmark(F.col("revenue_clean"), rev_med)
    pv = vs_benchmark(F.col("productivity"), prod_med)
    return b.select(
        "company_id",
        F.col("company_name").alias("name"),
        F.coalesce(F.col("sic_description"), F.lit(NA_TEXT)).alias("industry"),
        F.coalesce(F.col("region"), F.lit(NA_TEXT)).alias("region"),
        F.coalesce(F.col("country"), F.lit(NA_TEXT)).alias("country"),
        F.concat(F.col("company_age").cast("string"), F.lit(" years")).alias("age"),
        F.coalesce(F.col("entity_type"), F.lit(NA_TEXT)).alias("entity_type"),
        money(F.col("revenue_clean")).alias("revenue"),
        F.format_number(F.col("employees_clean"), 0).alias("employees"),
        F.concat(money(F.col("productivity")), F.lit("/employee")).alias("productivity"),
        pct_signed(rv).alias("revenue_vs_industry"),
        pct_signed(pv).alias("productivity_vs_industry"),
        S.health_grade(rv).alias("health_grade"),
        (F.col("is_domestic_ultimate_clean") == 1).alias("is_decision_maker"),
        (F.col("has_parent") == 1).alias("has_parent"),
        *keep,
    )


def due_diligence_facts(df: DataFrame, scope: str = "industry", related: str | None = None) -> DataFrame:
    """Nested report document per company: summary, profile, financial health,
    risk, hierarchy and a default recommendation. ``related`` names an array
    column of related companies (none: an empty list)."""
    flags = S.risk_flag_list({"risk_shell": F.col("risk_shell"), "risk_data_quality": F.col("risk_data_quality"),
                              "risk_orphan_sub": F.col("risk_orphan_sub"), "is_anomaly": F.col("is_anomaly")})
    others = F.coalesce(F.col(related) if related else F.lit(None), F.array()).cast("array<string>")
    j = financial_facts(df.withColumns({"flags": flags, "related_entities": others}), scope, ("risk_flags", "flags", "related_entities"))
    return j.select(
        "company_id",
        F.format_string(SUMMARY_FORMAT, F.coalesce("name", F.lit(UNKNOWN_TEXT))).alias("executive_summary"),
        F.struct("name", "industry", "region", "country", "age", "entity_type").alias("company_profile"),
        F.struct("revenue", "employees", "productivity", "revenue_vs_industry", "productivity_vs_industry", "health_grade").alias("financial_health"),
        F.struct(S.risk_grade(F.col("risk_flags")).alias("overall_risk"), F.col("risk_flags").alias("risk_score"), "flags",
                 F.lit(EXPLANATION_TEXT).alias("explanation")).alias("risk_assessment"),
        F.struct("is_decision_maker", "entity_type", "has_parent", "related_entities").alias("hierarchy_analysis"),
        F.struct(F.lit(DEFAULT_VERDICT).alias("verdict"), F.lit(ACTION_TEXT).alias("action"), F.lit(NA_TEXT).alias("timeline"),
                 F.lit(CONFIDENCE_TEXT).alias("confidence")).alias("recommendation"),
    )


def modal(df: DataFrame, group: str, col: str, alias: str) -> DataFrame:
    """Most frequent non-null value per group (smallest of ties), 'N/A' if none.
    Counts per (group, value) aggregate partially before the shuffle."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(group, col).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group).orderBy(F.col("_c").desc(), F.col(col))
    top = counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(group, F.col(col).alias(alias))
    return top


def cluster_profiles(df: DataFrame) -> DataFrame:
    """Per cluster name: size, median revenue and employees, modal region and
    industry, share of all rows as text with one decimal and '%'."""
    base = df.filter(F.col("cluster_name").isNotNull())
    med = quantiles(base, ["revenue_clean", "employees_clean"], ["cluster_name"], 0.5, ["median_revenue", "median_employees"], aggs=[F.count(F.lit(1)).alias("size")])
    out = (
        med.join(modal(base, "cluster_name", "region", "top_region"), "cluster_name", "left")
        .join(modal(base, "cluster_name", "sic_description", "top_industry"), "cluster_name", "left")
        .fillna({"top_region": NA_TEXT, "top_industry": NA_TEXT})
    )
    share = F.col("size") * 100.0 / F.sum("size").over(Window.partitionBy())  # k rows
    return out.withColumn("percentage", F.concat(F.format_string("%.1f", F.round(share, 1)), F.lit("%")))


def cluster_facts(df: DataFrame) -> DataFrame:
    p = cluster_profiles(df)
    return p.select(
        F.col("cluster_name").alias("cluster_id"), F.col("size").alias("Size"), F.col("percentage").alias("Percentage"),
        F.col("median_revenue").alias("Median_Revenue_USD"), F.col("median_employees").alias("Median_Employees"),
        F.col("top_region").alias("Top_Region"), F.col("top_industry").alias("Top_Industry"), F.lit("Mixed").alias("Top_Entity_Type"),
    )


def cluster_average(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster_name").agg(F.avg("revenue_clean").alias("cluster_avg_revenue"), F.avg("employees_clean").alias("cluster_avg_employees"))


def anomaly_facts(df: DataFrame) -> DataFrame:
    """Every anomaly beside its cluster's mean revenue and employees (k rows
    of cluster means, broadcast)."""
    avgs = cluster_average(df)
    a = df.filter(F.col("anomaly_label") == "Anomaly")
    return a.join(F.broadcast(avgs), "cluster_name", "left").select(
        "company_id", "cluster_name", "revenue_clean", "employees_clean", "region", "company_age", "it_spend_clean",
        "market_value_clean", "cluster_avg_revenue", "cluster_avg_employees",
    )


def comparison_facts(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both companies of each pair (id_a, id_b) side by side."""
    return pair_columns(df, pairs, ["employees_clean", "revenue_clean", "region", "sic_description"])


def action_facts(df: DataFrame) -> DataFrame:
    return df.select(
        "company_id", "cluster_name", "revenue_clean", "employees_clean", "lead_score", "lead_tier", "market_value_clean",
        "it_spend_clean", "company_age", "is_domestic_ultimate_clean", "risk_flags", "anomaly_label", "risk_shell",
    )


def market_facts(market: DataFrame, countries: DataFrame, n_industries: int = 5, spec: MarketSpec | None = None) -> DataFrame:
    """One row: totals, per-country records (a top-10 list, bounded), median
    revenue, average score, top industries as a map, the filters that
    ``spec`` sets as JSON; plus the JSON text of all facts."""
    tot = quantiles(market, ["revenue_clean"], (), 0.5, ["median_revenue"], aggs=[F.count(F.lit(1)).alias("total_companies"), F.avg("lead_score").alias("avg_lead_score")])
    ctry = countries.agg(F.sort_array(F.collect_list(F.struct(F.col("companies").alias("companies"), "country", "median_revenue", "avg_lead_score")), False).alias("countries"))
    ind = value_counts(market, "sic_description", n_industries).agg(
        F.map_from_entries(F.collect_list(F.struct("sic_description", "n"))).alias("top_industries")
    )
    filters = {k: v for k, v in asdict(spec).items() if v not in (None, (), {}, False)} if spec else {}
    row = combine_rows(tot, ctry, ind).withColumn("filters_applied", F.lit(json.dumps(filters, sort_keys=True)))
    return row.withColumn("facts_json", F.to_json(F.struct(
        "total_companies", "median_revenue", "avg_lead_score", "countries", "top_industries", "filters_applied")))


ACTION_REPLY_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("Verdict", "Reason", "Risk", "Action")])


# Field names of the nested replies (fixed values).
_TEXT = T.StringType()


def _fields(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TEXT) for n in names])


DUE_REPLY_SCHEMA = T.StructType([
    T.StructField("executive_summary", _TEXT),
    T.StructField("financial_health", _fields("health_grade", "key_strength", "key_concern")),
    T.StructField("risk_assessment", T.StructType([
        *_fields("overall_risk", "explanation").fields,
        T.StructField("red_flags", T.ArrayType(_TEXT)), T.StructField("mitigating_factors", T.ArrayType(_TEXT))])),
    T.StructField("recommendation", _fields("verdict", "action", "timeline", "confidence")),
])
SPEC_REPLY_SCHEMA = T.StructType([
    *_fields("region", "country").fields,
    T.StructField("industry_keywords", T.ArrayType(_TEXT)),
    *[T.StructField(n, T.DoubleType()) for n in ("min_revenue", "max_revenue", "min_employees", "max_employees")],
    T.StructField("target_tiers", T.ArrayType(T.IntegerType())),
    T.StructField("exclude_high_risk", T.BooleanType()), T.StructField("limit", T.IntegerType()),
])


def parse_responses(replies: DataFrame, text_col: str = "reply", schema: T.StructType = ACTION_REPLY_SCHEMA) -> DataFrame:
    """Model replies -> struct: an ``Error`` prefix is an error; code fences
    (with or without a language tag) are stripped; JSON that does not parse
    into any field is an error."""
    text = F.trim(F.col(text_col))
    stripped = F.trim(F.regexp_replace(F.regexp_replace(text, r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    parsed = F.from_json(stripped, schema, {"mode": "PERMISSIVE"})
    nothing = F.lit(True)
    for f in schema.fields:
        nothing = nothing & parsed[f.name].isNull()
    nothing = parsed.isNull() | nothing
    is_error = text.startswith("Error") | nothing
    return replies.withColumn("parsed", F.when(~is_error, parsed)).withColumn(
        "error", F.when(text.startswith("Error"), text).when(nothing, F.lit("unparsable reply"))
    )


def merge_report(facts: DataFrame, parsed: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Left-join parsed replies onto the facts, field by field with defaults."""
    defaults = defaults or {"Verdict": DEFAULT_VERDICT, "Reason": NA_TEXT, "Risk": NA_TEXT, "Action": NA_TEXT}
    j = facts.join(parsed.select("company_id", "parsed", "error"), "company_id", "left")
    return j.select(
        *facts.columns,
        *[F.coalesce(F.col(f"parsed.{k}"), F.lit(v)).alias(k.lower()) for k, v in defaults.items()],
        "error",
    )


def escape_dollars(c: Column) -> Column:
    return F.replace(c, F.lit("$"), F.lit("\\$"))


def merge_due_diligence(facts: DataFrame, parsed: DataFrame) -> DataFrame:
    """``due_diligence_facts`` with the parsed reply (``DUE_REPLY_SCHEMA``) of
    each company, one at most: computed facts stay, the reply gives the
    judgements, and a field that it lacks takes its default. Without a usable
    reply only ``error`` (the reply's, or that there is none) and the computed
    facts say so: the judgements are the defaults."""
    j = facts.join(parsed.select("company_id", "parsed", "error"), "company_id", "left")

    def said(path: str, default: str, free_text: bool = False) -> Column:
        c = F.col(f"parsed.{path}")
        return F.coalesce(escape_dollars(c) if free_text else c, F.lit(default))

    def listed(path: str) -> Column:
        return F.coalesce(F.col(f"parsed.{path}"), F.array().cast("array<string>"))

    def fact(part: str, *names: str) -> list:
        return [F.col(f"{part}.{n}").alias(n) for n in names]

    return j.select(
        "company_id", said("executive_summary", "", True).alias("executive_summary"), "company_profile",
        F.struct(*fact("financial_health", "revenue", "employees", "productivity", "revenue_vs_industry", "productivity_vs_industry"),
                 said("financial_health.health_grade", NA_TEXT).alias("health_grade"),
                 said("financial_health.key_strength", "", True).alias("key_strength"),
                 said("financial_health.key_concern", "", True).alias("key_concern")).alias("financial_health"),
        F.struct(said("risk_assessment.overall_risk", UNKNOWN_TEXT).alias("overall_risk"), *fact("risk_assessment", "risk_score", "flags"),
                 said("risk_assessment.explanation", "", True).alias("explanation"),
                 listed("risk_assessment.red_flags").alias("red_flags"),
                 listed("risk_assessment.mitigating_factors").alias("mitigating_factors")).alias("risk_assessment"),
        "hierarchy_analysis",
        F.struct(said("recommendation.verdict", DEFAULT_VERDICT).alias("verdict"), said("recommendation.action", "", True).alias("action"),
                 said("recommendation.timeline", NA_TEXT).alias("timeline"),
                 said("recommendation.confidence", MERGED_CONFIDENCE).alias("confidence")).alias("recommendation"),
        F.when(F.col("parsed").isNull(), F.coalesce("error", F.lit("no reply"))).alias("error"),
    )
