"""One frozen configuration shared by every operator.

Fixed values below must equal the reference's for identical results: reference
year, entity maps, score weights and cut points, k, contamination, seeds.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType

# --- fixed values (must match the reference) -------------------------------
REFERENCE_YEAR = 2026

# Entity ordinal used as imputation context (unmapped or null -> 1).
ENTITY_MAP_IMPUTE = MappingProxyType(
    {"Headquarters": 4, "Parent": 3, "Single Location": 3, "Subsidiary": 2, "Branch": 1}
)
# Entity score used as a feature and in the lead score (unmapped or null -> 1).
ENTITY_MAP_FEATURE = MappingProxyType({"Parent": 3, "Subsidiary": 2, "Branch": 1})
# Single-row evaluator variant: one map for imputation and features (unmapped -> 1).
ENTITY_MAP_EVALUATOR = MappingProxyType(
    {"Parent": 3, "Headquarters": 3, "Subsidiary": 2, "Branch": 1, "Single Location": 3}
)
ENTITY_DEFAULT = 1

# Text values read as true by the boolean cleaner (after lower-casing).
TRUE_TOKENS = ("yes", "true", "1")

# Lead-tier bin rules: name -> list of (label, low, high, closed side).
# pipeline: right-closed (0,30] (30,50] (50,75] (75,100]
# evaluator: left-closed >=75 / >=50 / >=30 / else
# dashboard: >=70 / >=50 / >=30 / else
TIER_LABELS = ("Cold", "Warm", "Hot", "Priority")
TIER_CUTS = MappingProxyType(
    {"pipeline": (0.0, 30.0, 50.0, 75.0, 100.0), "evaluator": (30.0, 50.0, 75.0), "dashboard": (30.0, 50.0, 70.0)}
)

# Cluster features, in the reference's order.
CLUSTER_FEATURES = (
    "log_revenue", "log_employees", "entity_score", "has_parent",
    "revenue_per_employee", "company_age", "is_domestic_ultimate_clean",
)
# Features of the validation scripts (no has_parent; rev/emp with employees 0 -> 1).
VALIDATION_FEATURES = (
    "log_revenue", "log_employees", "entity_score",
    "revenue_per_employee_v", "company_age", "is_domestic_ultimate_clean",
)

# Risk-flag texts of the due-diligence facts.
RISK_TEXTS = (
    ("risk_shell", "Shell Company Risk (high revenue, zero employees)"),
    ("risk_data_quality", "Data Quality Issue (<50% completeness)"),
    ("risk_orphan_sub", "Orphan Subsidiary (no parent linkage)"),
    ("is_anomaly", "Statistical Anomaly (Isolation Forest)"),
)
NO_RISK_TEXT = "No risk flags detected"


@dataclass(frozen=True)
class Config:
    reference_year: int = REFERENCE_YEAR
    entity_map_impute: dict = field(default_factory=lambda: dict(ENTITY_MAP_IMPUTE))
    entity_map_feature: dict = field(default_factory=lambda: dict(ENTITY_MAP_FEATURE))
    entity_default: int = ENTITY_DEFAULT
    knn_k: int = 5
    k: int = 5
    kmeans_starts: int = 10
    seed: int = 42
    contamination: float = 0.05
    iforest_trees: int = 100
    iforest_sample: int = 256
    shell_revenue: float = 100_000.0
    completeness_cut: float = 0.5
    age_clip: tuple = (0.0, 200.0)
    vs_industry_clip: tuple = (-100.0, 500.0)
    evaluator_default_age: float = 15.0
    # minimum number of key buckets in the kNN ranking sort (grows with the data)
    rank_partitions: int = 8
    # broadcast a dimension only when its row count is at most this
    broadcast_rows: int = 200_000


DEFAULT = Config()
