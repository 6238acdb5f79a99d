"""The corpus pipeline: documents through quality classifier, near-duplicate
removal, benchmark decontamination, secret scan and tokenizer.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and reads it again as the next stage's ``docs``. All but the
last return the columns of ``documents``.

Rows: a null text counts as empty in every stage. An empty table passes
through. Extra columns are dropped by the first stage. Repeated rows: one of
them stays after the near-duplicate stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmscope.llm import decontaminate, neardup, pieces, quality, secretscan
from firmscope.llm.queries import ACCEPT, held_out, table
from firmscope.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at least ``ACCEPT``. The fit uses the labelled rows that are not held out."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return quality.accepted(docs.select(*COLUMNS), model, ACCEPT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group; a row repeated whole stays once."""
    # by id and text: where an id has several texts, each is kept or not by itself
    hashed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    kept = neardup.near_duplicates(hashed, carry=("text_hash",)).where("kept").select("doc_id", "text_hash").distinct()
    same = hashed.join(kept, ["doc_id", "text_hash"], "left_semi").unionByName(hashed.where("doc_id is null"))
    return same.select(*COLUMNS).dropDuplicates()


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    judged = decontaminate.contamination(docs.select(key.alias("key"), "text"), table(spark, sf_dir, "benchmark"), id_col="key")
    gone = judged.where("contaminated").select("key").distinct()
    return docs.withColumn("key", key).alias("d").join(gone.alias("g"), F.col("d.key").eqNullSafe(F.col("g.key")), "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; ``n_chars`` changes by as much as the text."""
    ratios = secretscan.train(secretscan.labelled_sample(docs))
    longer = docs.withColumn("n_chars", F.col("n_chars") - F.coalesce(F.length("text"), F.lit(0)))
    clean = secretscan.redacted(longer, ratios)
    return clean.withColumn("n_chars", F.col("n_chars") + F.coalesce(F.length("text"), F.lit(0))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    encoded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.id_digests(encoded)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", tokenize),
]

#: Fitted models and hash minima have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
