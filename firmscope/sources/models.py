"""Persist and load fitted pipeline models.

Everything goes through Spark writers, so the folder may live on any shared
filesystem the cluster uses: scalar fits as one JSON text row, tables as
parquet.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from firmscope.operators.donor_index import TABLES, DonorIndex


def save_models(models, path: str) -> None:
    from firmscope.plans.pipeline import Models  # noqa: F401  (type reference)

    spark = SparkSession.getActiveSession()
    params = {
        "impute_scaler": models.impute_scaler, "medians": models.medians,
        "cluster_scaler": models.cluster_scaler, "cluster_medians": models.cluster_medians,
        "anomaly_threshold": models.anomaly_threshold, "centres": models.centres,
    }
    index = models.donor_index()
    if index is not None:
        params["donor_depth"] = index.depth
        for name in TABLES:
            writer = getattr(index, name).write.mode("overwrite")
            (writer.partitionBy("part") if name == "blocks" else writer).parquet(f"{path}/donor_{name}")
    spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")
    for name in ("industry", "cluster_names"):
        table = getattr(models, name)
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    if models.forest is not None:
        spark.createDataFrame(models.forest).write.mode("overwrite").parquet(f"{path}/forest")


def load_models(spark: SparkSession, path: str):
    """Load every artefact; a missing one raises with the artefact's name."""
    from firmscope.plans.pipeline import Models

    try:
        params = json.loads(spark.read.text(f"{path}/params").first()["value"])
        m = Models(
            impute_scaler={k: tuple(v) for k, v in params["impute_scaler"].items()},
            medians=params["medians"],
            cluster_scaler={k: tuple(v) for k, v in params["cluster_scaler"].items()},
            cluster_medians=params["cluster_medians"],
            anomaly_threshold=params["anomaly_threshold"], centres=params["centres"],
        )
        m.industry = spark.read.parquet(f"{path}/industry")
        if "donor_depth" in params:
            m.donors = DonorIndex(*[spark.read.parquet(f"{path}/donor_{name}") for name in TABLES], params["donor_depth"])
        m.cluster_names = spark.read.parquet(f"{path}/cluster_names")
        m.forest = spark.read.parquet(f"{path}/forest").toPandas()  # trees x (2 psi - 1) rows at most
    except Exception as exc:  # report which artefact failed
        raise RuntimeError(f"could not load models from {path}: {exc}") from exc
    return m
