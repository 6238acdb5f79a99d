"""Lead score, lead tier and rule-based risk flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmscope.config import NO_RISK_TEXT, RISK_TEXTS, TIER_CUTS, TIER_LABELS

# Lead score v2 weights and thresholds (fixed values).
REVENUE_STEPS = ((1e8, 35.0), (1e7, 25.0), (1e6, 15.0), (1e5, 5.0))
DOMESTIC_ULTIMATE_POINTS = 15.0
ENTITY_MULTIPLIER = 3.0
RPE_CUT, RPE_POINTS = 5e5, 10.0
IT_HIGH_CUT, IT_HIGH_POINTS, IT_ANY_POINTS = 1000.0, 10.0, 5.0
MARKET_VALUE_POINTS = 15.0
AGE_GOLDEN = (3.0, 10.0)
AGE_GOLDEN_POINTS, AGE_MATURE_POINTS = 10.0, 5.0
INCOMPLETE_PENALTY = 0.8


def lead_score_v2(
    revenue: Column, domestic_ultimate: Column, entity_score: Column, rev_per_emp: Column,
    it_per_emp: Column, market_value: Column, age: Column, completeness: Column,
    completeness_cut: float = 0.5, weights: dict | None = None,
) -> Column:
    """Sum of CASE terms, incomplete rows x0.8, clamped to [0, 100].
    A null input behaves as a false comparison (adds nothing). ``weights``
    optionally multiplies the components revenue, power, efficiency, tech,
    market_value, stability (sensitivity analysis)."""
    wt = {"revenue": 1.0, "power": 1.0, "efficiency": 1.0, "tech": 1.0, "market_value": 1.0, "stability": 1.0, **(weights or {})}
    rev_pts = F.lit(0.0)
    for cut, pts in reversed(REVENUE_STEPS):
        rev_pts = F.when(revenue >= cut, F.lit(pts)).otherwise(rev_pts)
    power = F.when(domestic_ultimate == 1, F.lit(DOMESTIC_ULTIMATE_POINTS)).otherwise(entity_score * ENTITY_MULTIPLIER)
    eff = F.when(rev_per_emp >= RPE_CUT, F.lit(RPE_POINTS)).otherwise(F.lit(0.0))
    tech = (
        F.when(it_per_emp > IT_HIGH_CUT, F.lit(IT_HIGH_POINTS))
        .when(it_per_emp > 0, F.lit(IT_ANY_POINTS))
        .otherwise(F.lit(0.0))
    )
    mv = F.when(market_value > 0, F.lit(MARKET_VALUE_POINTS)).otherwise(F.lit(0.0))
    stab = (
        F.when((age >= AGE_GOLDEN[0]) & (age <= AGE_GOLDEN[1]), F.lit(AGE_GOLDEN_POINTS))
        .when(age > AGE_GOLDEN[1], F.lit(AGE_MATURE_POINTS))
        .otherwise(F.lit(0.0))
    )
    if weights:
        rev_pts, power, eff = rev_pts * wt["revenue"], power * wt["power"], eff * wt["efficiency"]
        tech, mv, stab = tech * wt["tech"], mv * wt["market_value"], stab * wt["stability"]
    score = rev_pts + F.coalesce(power, F.lit(0.0)) + eff + tech + mv + stab
    score = F.when(completeness < completeness_cut, score * INCOMPLETE_PENALTY).otherwise(score)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))


def lead_tier(score: Column, rule: str = "pipeline") -> Column:
    """Three named bin rules. ``pipeline`` is right-closed (0,30] (30,50]
    (50,75] (75,100] with 0 outside every bin; the others are left-closed."""
    cold, warm, hot, prio = TIER_LABELS
    cuts = TIER_CUTS[rule]
    if rule == "pipeline":
        b0, b1, b2, b3, b4 = cuts
        return (
            F.when((score > b0) & (score <= b1), cold)
            .when((score > b1) & (score <= b2), warm)
            .when((score > b2) & (score <= b3), hot)
            .when((score > b3) & (score <= b4), prio)
        )
    w, h, p = cuts
    return F.when(score >= p, prio).when(score >= h, hot).when(score >= w, warm).when(score.isNotNull(), cold)


def risk_shell(revenue: Column, employees_missing: Column, cut: float = 100_000.0) -> Column:
    return F.coalesce((revenue > cut) & employees_missing, F.lit(False))


def risk_data_quality(completeness: Column, cut: float = 0.5) -> Column:
    return F.coalesce(completeness < cut, F.lit(False))


def risk_orphan_sub(entity_type: Column, has_parent: Column) -> Column:
    return F.coalesce((entity_type == "Subsidiary") & (has_parent == 0), F.lit(False))


def anomaly_label(is_anomaly: Column) -> Column:
    return F.when(is_anomaly, F.lit("Anomaly")).otherwise(F.lit("Normal"))


def risk_flags(*flags: Column) -> Column:
    total = F.lit(0)
    for f in flags:
        total = total + F.coalesce(f, F.lit(False)).cast("int")
    return total


def risk_flag_list(df_cols: dict) -> Column:
    """Array of human-readable flag texts; a fixed text when no flag is set."""
    items = F.array_compact(F.array(*[F.when(df_cols[name], F.lit(text)) for name, text in RISK_TEXTS]))
    return F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(NO_RISK_TEXT)))


def risk_grade(n_flags: Column) -> Column:
    return F.when(n_flags > 0, F.lit("Medium")).otherwise(F.lit("Low"))


def health_grade(rev_vs_benchmark: Column) -> Column:
    return F.when(rev_vs_benchmark > 0, F.lit("B")).otherwise(F.lit("C"))
