"""Score new companies as they arrive (E1 on Structured Streaming).

Scoring is stateless given the stored models (the donor search reads the
stored donor table), so each micro-batch is scored with ``score_companies``
inside ``foreachBatch`` and written to a folder of its own, named by its epoch
and replaced as a whole: an epoch that runs again after a failure leaves its
rows once, as the checkpoint location gives it the same input again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from firmscope.config import DEFAULT, Config

OUTPUT_COLUMNS = (
    "company_id", "cluster_name", "lead_score", "lead_tier", "anomaly_label", "revenue_clean", "employees_clean", "company_age",
)


def write_epoch(scored: DataFrame, sink_dir: str, epoch_id: int) -> None:
    """The rows of one epoch, in place of what an earlier try of it left."""
    scored.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/epoch={epoch_id}")


def score_stream(
    spark: SparkSession, source_dir: str, schema: T.StructType, models, sink_dir: str, checkpoint: str,
    cfg: Config = DEFAULT, trigger_once: bool = True,
):
    """Start a query: parquet files of raw companies in ``source_dir`` ->
    scored rows in ``sink_dir``, a folder for each epoch. Returns the StreamingQuery."""
    from firmscope.plans.pipeline import score_companies

    stream = spark.readStream.schema(schema).parquet(source_dir)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        write_epoch(score_companies(batch, models, cfg).select(*OUTPUT_COLUMNS), sink_dir, epoch_id)

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime="10 seconds")
    return writer.start()
