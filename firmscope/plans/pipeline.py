"""The batch pipeline as stages of one lazy plan, with fits as the only
driver round trips (scaler, medians, k-means, forest, percentile).

``prepare``  clean -> impute -> features -> benchmark -> lead score -> rule risks
``run``      prepare -> segment (k-means) -> isolation forest -> risk flags
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmscope.config import DEFAULT, Config
from firmscope.functions import clean as C
from firmscope.functions import features as FE
from firmscope.functions import scoring as S
from firmscope.operators.benchmark import attach_benchmark, industry_benchmark
from firmscope.operators.donor_index import DonorIndex
from firmscope.operators.impute import fill_median, knn_fit
from firmscope.operators.stats import median_row
from firmscope.session import Scratch, cut_lineage, own_method


@dataclass
class Models:
    """Everything fitted by the pipeline; small, persisted by ``sources.models``."""
    impute_scaler: dict = field(default_factory=dict)
    medians: dict = field(default_factory=dict)
    industry: DataFrame | None = None
    donors: DonorIndex | Callable[[], DonorIndex] | None = None
    cluster_scaler: dict = field(default_factory=dict)
    cluster_medians: dict = field(default_factory=dict)
    centres: list | None = None
    cluster_names: DataFrame | None = None
    forest: DataFrame | None = None
    anomaly_threshold: float | None = None

    def donor_index(self) -> DonorIndex:
        """The stored donors; written the first time they are asked for."""
        if callable(self.donors):
            self.donors = self.donors()
        return self.donors


def clean_stage(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    rev = C.clean_numeric("revenue_usd")
    emp = C.clean_numeric("employees_total")
    df = own_method(df).withColumns({"revenue_raw": rev, "employees_raw": emp})
    return df.withColumns(
        {
            "is_revenue_missing": C.is_missing(F.col("revenue_raw")),
            "is_employees_missing": C.is_missing(F.col("employees_raw")),
            "log_rev_in": C.zero_to_null_log1p(F.col("revenue_raw")),
            "log_emp_in": C.zero_to_null_log1p(F.col("employees_raw")),
            "entity_ord": C.entity_ordinal("entity_type", cfg.entity_map_impute, cfg.entity_default),
            "employees_site_clean": C.fill_zero(C.clean_numeric("employees_single_site")),
            "corporate_family_size": C.fill_zero(C.clean_numeric("corporate_family_members")),
            "is_domestic_ultimate_clean": C.clean_boolean("is_domestic_ultimate"),
            "year_found_clean": C.parse_year("year_found"),
            "market_value_clean": C.fill_zero(C.clean_numeric("market_value_usd")),
            "it_spend_clean": C.fill_zero(C.clean_numeric("it_spend")),
            "entity_score": C.entity_ordinal("entity_type", cfg.entity_map_feature, cfg.entity_default),
            "has_parent": FE.has_parent(F.col("parent_company")),
            "sic2": FE.sic2(F.col("sic_code")),
        }
    )


def impute_stage(df: DataFrame, cfg: Config = DEFAULT, scaler: dict | None = None) -> tuple[DataFrame, dict, Callable[[], DonorIndex]]:
    groups = set(cfg.entity_map_impute.values()) | {cfg.entity_default}
    out, scaler, donors = knn_fit(
        df, "company_id", "log_rev_in", "log_emp_in", "entity_ord", groups, cfg.knn_k, cfg.rank_partitions, scaler
    )
    # observed values pass through untouched; only imputed ones come from expm1
    out = out.withColumns(
        {
            "revenue_clean": F.when(F.col("log_rev_in").isNotNull(), F.col("revenue_raw")).otherwise(F.expm1("imp_log_rev_in")),
            "employees_clean": F.when(F.col("log_emp_in").isNotNull(), F.col("employees_raw")).otherwise(F.expm1("imp_log_emp_in")),
        }
    ).drop("imp_log_rev_in", "imp_log_emp_in")
    return out, scaler, donors


def feature_stage(df: DataFrame, cfg: Config = DEFAULT, medians: dict | None = None) -> tuple[DataFrame, dict]:
    df = df.withColumns(
        {
            "company_age": FE.company_age(F.col("year_found_clean"), cfg.reference_year, *cfg.age_clip),
            "it_spend_per_emp": FE.it_spend_per_employee(F.col("it_spend_clean"), F.col("employees_clean")),
            "revenue_per_employee": FE.revenue_per_employee(F.col("revenue_clean"), F.col("employees_clean")),
            "log_revenue": F.log1p("revenue_clean"),
            "log_employees": F.log1p("employees_clean"),
            "data_completeness": FE.data_completeness(
                F.col("is_revenue_missing"), F.col("is_employees_missing"),
                F.col("sic_code"), F.col("entity_type"), F.col("region"), F.col("country"), F.col("year_found"),
            ),
        }
    )
    if medians is None:
        medians = median_row(df, ["company_age", "revenue_per_employee"])
    return fill_median(df, medians), medians


def score_stage(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    df = own_method(df).withColumn(
        "lead_score",
        S.lead_score_v2(
            F.col("revenue_clean"), F.col("is_domestic_ultimate_clean"), F.col("entity_score"),
            F.col("revenue_per_employee"), F.col("it_spend_per_emp"), F.col("market_value_clean"),
            F.col("company_age"), F.col("data_completeness"), cfg.completeness_cut,
        ),
    )
    return df.withColumn("lead_tier", S.lead_tier(F.col("lead_score"), "pipeline"))


def rule_risk_stage(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return df.withColumns(
        {
            "risk_shell": S.risk_shell(F.col("revenue_clean"), F.col("is_employees_missing"), cfg.shell_revenue),
            "risk_data_quality": S.risk_data_quality(F.col("data_completeness"), cfg.completeness_cut),
            "risk_orphan_sub": S.risk_orphan_sub(F.col("entity_type"), F.col("has_parent")),
        }
    )


def prepare(
    raw: DataFrame | None, cfg: Config = DEFAULT, models: Models | None = None, cleaned: DataFrame | None = None,
) -> tuple[DataFrame, Models]:
    """Deterministic core. With ``models`` given, stored fits are reused
    (batch scoring); otherwise they are fitted here. ``cleaned`` may pass an
    already materialised ``clean_stage`` output instead of ``raw``."""
    fitted = models or Models()
    # the cleaned table is read by the scaler fit, the search and the join: materialised
    df = cleaned if cleaned is not None else cut_lineage(clean_stage(raw, cfg), "clean")
    df, fitted.impute_scaler, fitted.donors = impute_stage(df, cfg, fitted.impute_scaler or None)
    df = cut_lineage(df, "imputed")  # read by the median fits and everything after
    if fitted.industry is None:
        # global medians and per-industry medians are independent fits: run them together
        with ThreadPoolExecutor(max_workers=1) as pool:
            industry = pool.submit(lambda: cut_lineage(industry_benchmark(df), "industry"))
            df, fitted.medians = feature_stage(df, cfg, fitted.medians or None)
            fitted.industry = industry.result()
    else:
        df, fitted.medians = feature_stage(df, cfg, fitted.medians or None)
        fitted.industry = cut_lineage(fitted.industry, "industry")
    df = attach_benchmark(df, fitted.industry, cfg.broadcast_rows, cfg.vs_industry_clip)
    df = rule_risk_stage(score_stage(df, cfg), cfg)
    return df, fitted


def finish(df: DataFrame, cfg: Config = DEFAULT, models: Models | None = None, refit: bool = True) -> tuple[DataFrame, Models]:
    """Segment (k-means, tier names) and flag anomalies (isolation forest) on
    the prepared table, then sum the four risk flags. With ``refit=False``
    the stored models in ``models`` are applied instead."""
    from firmscope.config import CLUSTER_FEATURES
    from firmscope.operators import iforest as IF
    from firmscope.operators import segment as SG

    m = models or Models()
    feats = list(CLUSTER_FEATURES)
    zcols = [f"z_{c}" for c in feats]
    if refit:
        z, m.cluster_scaler, m.cluster_medians = SG.cluster_matrix(df, feats)
        with Scratch(df.sparkSession) as scratch, ThreadPoolExecutor(max_workers=1) as pool:
            # the fits read their columns again and again
            narrow = scratch.write(z.select("company_id", *zcols, "revenue_clean", "entity_score"), "cluster-features")
            # the forest and the k-means are independent fits on the same
            # matrix: grow the forest while the k-means jobs run
            forest = pool.submit(
                lambda: IF.iforest_fit(narrow, "company_id", zcols, cfg.iforest_trees, cfg.iforest_sample, cfg.seed).toPandas()
            )
            m.centres = SG.kmeans_fit(narrow, "company_id", zcols, cfg.k, cfg.kmeans_starts, cfg.seed).centres.tolist()
            profile = SG.cluster_tier_profile(SG.kmeans_assign(narrow, zcols, m.centres).select("cluster", "revenue_clean", "entity_score"))
            m.cluster_names = cut_lineage(SG.name_clusters(profile), "cluster-names")
            m.forest = forest.result()
            scores = IF.iforest_score(narrow.select(*zcols), m.forest, zcols)
            m.anomaly_threshold = IF.anomaly_threshold(scratch.write(scores.select("iforest_s"), "forest-scores"), cfg.contamination)
    else:
        z, _, _ = SG.cluster_matrix(df, feats, m.cluster_scaler, m.cluster_medians)
    named = SG.attach_cluster_name(SG.kmeans_assign(z, zcols, m.centres), m.cluster_names)
    scored = IF.iforest_score(named, m.forest, zcols).drop(*zcols)
    return flag_stage(scored, m.anomaly_threshold), m


def flag_stage(scored: DataFrame, threshold: float) -> DataFrame:
    """Decision value, label and the sum of the four risk flags."""
    from firmscope.operators import iforest as IF

    return IF.anomaly_columns(scored, threshold).withColumn(
        "risk_flags",
        S.risk_flags(F.col("risk_shell"), F.col("risk_data_quality"), F.col("risk_orphan_sub"), F.col("is_anomaly")),
    )


def run(raw: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, Models]:
    """The whole batch pipeline on a raw company table."""
    df, m = prepare(raw, cfg)
    df = cut_lineage(df, "prepared")
    return finish(df, cfg, m)


def score_companies(
    raw_new: DataFrame, models: Models, cfg: Config = DEFAULT, variant: str = "pipeline",
) -> DataFrame:
    """Score a table of new companies with stored models (E1): cleaning,
    kNN imputation against the stored donors, features, stored industry
    medians, stored scaler, k-means centres, forest and threshold. Its work
    follows the new rows, not the fitted table (donors are looked up in an
    index), so it also runs on a stream's batches.

    ``variant='pipeline'`` (default) applies the pipeline's rules, so batch
    scores equal the pipeline's for the same rows. ``variant='evaluator'``
    applies the reference's single-company evaluator rules instead: strict
    number parser, its entity map for both imputation and features, age 15
    when the year is missing or 0, revenue/employee and IT/employee 0 when
    headcount is not positive, any non-empty value as domestic ultimate,
    missing cluster features as 0, left-closed tier cuts (75/50/30)."""
    from firmscope.operators.impute import knn_apply

    groups = set(cfg.entity_map_impute.values()) | {cfg.entity_default}
    if variant == "evaluator":
        return _score_evaluator(raw_new, models, cfg, groups)
    df = cut_lineage(clean_stage(raw_new, cfg), "new-clean")  # the donor search reads it many times
    needs = df.filter(F.col("log_rev_in").isNull() | F.col("log_emp_in").isNull()).select(F.lit(1)).limit(1).count() > 0
    if needs:
        imp = knn_apply(df, models.donor_index(), "log_rev_in", "log_emp_in", "entity_ord", groups, models.impute_scaler, cfg.knn_k)
    else:  # nothing to impute (e.g. a complete micro-batch): no neighbour search
        imp = df.withColumns({"imp_log_rev_in": F.col("log_rev_in"), "imp_log_emp_in": F.col("log_emp_in")})
    imp = imp.withColumns(
        {
            "revenue_clean": F.when(F.col("log_rev_in").isNotNull(), F.col("revenue_raw")).otherwise(F.expm1("imp_log_rev_in")),
            "employees_clean": F.when(F.col("log_emp_in").isNotNull(), F.col("employees_raw")).otherwise(F.expm1("imp_log_emp_in")),
        }
    ).drop("imp_log_rev_in", "imp_log_emp_in")
    feat, _ = feature_stage(imp, cfg, models.medians)
    feat = attach_benchmark(feat, models.industry, cfg.broadcast_rows, cfg.vs_industry_clip)
    feat = rule_risk_stage(score_stage(feat, cfg), cfg)
    out, _ = finish(feat, cfg, models, refit=False)
    return out


def _score_evaluator(raw_new: DataFrame, models: Models, cfg: Config, groups) -> DataFrame:
    from firmscope.config import CLUSTER_FEATURES, ENTITY_MAP_EVALUATOR
    from firmscope.operators.impute import knn_apply

    present = lambda c: F.coalesce(F.length(F.col(c)) > 0, F.lit(False))  # noqa: E731  (non-empty value)
    rev, emp = C.clean_number_strict("revenue_usd"), C.clean_number_strict("employees_total")
    df = raw_new.withColumns({"revenue_raw": rev, "employees_raw": emp})
    df = df.withColumns(
        {
            "log_rev_in": F.when(F.col("revenue_raw") > 0, F.log1p("revenue_raw")),
            "log_emp_in": F.when(F.col("employees_raw") > 0, F.log1p("employees_raw")),
            "entity_ord": C.entity_ordinal("entity_type", ENTITY_MAP_EVALUATOR, cfg.entity_default),
            "is_domestic_ultimate_clean": present("is_domestic_ultimate").cast("int"),
            "year_found_clean": C.clean_number_strict("year_found"),
            "market_value_clean": C.clean_number_strict("market_value_usd"),
            "it_spend_clean": F.coalesce(C.clean_number_strict("it_spend"), F.lit(0.0)),
            "has_parent": present("parent_company").cast("int"),
            "sic2": FE.sic2(F.col("sic_code")),
        }
    ).withColumn("entity_score", F.col("entity_ord"))
    df = cut_lineage(df, "new-eval")
    imp = knn_apply(df, models.donor_index(), "log_rev_in", "log_emp_in", "entity_ord", groups, models.impute_scaler, cfg.knn_k)
    emp_c = F.col("employees_clean")
    feat = imp.withColumns(
        {
            "log_revenue": F.coalesce(F.col("log_rev_in"), F.col("imp_log_rev_in")),
            "log_employees": F.coalesce(F.col("log_emp_in"), F.col("imp_log_emp_in")),
            "revenue_clean": F.when(F.col("log_rev_in").isNotNull(), F.col("revenue_raw")).otherwise(F.expm1("imp_log_rev_in")),
            "employees_clean": F.when(F.col("log_emp_in").isNotNull(), F.col("employees_raw")).otherwise(F.expm1("imp_log_emp_in")),
        }
    ).withColumns(
        {
            "company_age": F.when(F.col("year_found_clean").isNull() | (F.col("year_found_clean") == 0), F.lit(cfg.evaluator_default_age))
            .otherwise(F.least(F.greatest(F.lit(float(cfg.reference_year)) - F.col("year_found_clean"), F.lit(0.0)), F.lit(200.0))),
            "revenue_per_employee": F.when(emp_c > 0, F.col("revenue_clean") / emp_c).otherwise(F.lit(0.0)),
            "it_spend_per_emp": F.when(emp_c > 0, F.col("it_spend_clean") / emp_c).otherwise(F.lit(0.0)),
            "data_completeness": (
                F.coalesce(F.col("revenue_raw") > 0, F.lit(False)).cast("int")
                + F.coalesce(F.col("employees_raw") > 0, F.lit(False)).cast("int")
                + present("sic_code").cast("int") + present("entity_type").cast("int") + present("region").cast("int")
                + present("country").cast("int") + present("year_found").cast("int")
            ) / F.lit(7.0),
            "is_revenue_missing": F.coalesce(~(F.col("revenue_raw") > 0), F.lit(True)),
            "is_employees_missing": F.coalesce(~(F.col("employees_raw") > 0), F.lit(True)),
        }
    ).drop("imp_log_rev_in", "imp_log_emp_in")
    feat = feat.fillna(0.0, subset=list(CLUSTER_FEATURES))  # missing cluster features -> 0
    feat = feat.withColumn(
        "lead_score",
        S.lead_score_v2(
            F.col("revenue_clean"), F.col("is_domestic_ultimate_clean"), F.col("entity_score"), F.col("revenue_per_employee"),
            F.col("it_spend_per_emp"), F.col("market_value_clean"), F.col("company_age"), F.col("data_completeness"), cfg.completeness_cut,
        ),
    ).withColumn("lead_tier", S.lead_tier(F.col("lead_score"), "evaluator"))
    feat = rule_risk_stage(feat, cfg)
    out, _ = finish(feat, cfg, models, refit=False)
    return out
