"""The registered queries: each applies its operator to the whole of its
table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmscope.llm import decontaminate, filteraudit, langid, lexical, licences, neardup, pieces, pii, preference, quality, secretscan, substrings, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Documents whose remainder this is teach nothing.
FOLDS, HELD_OUT = 4, 2
ACCEPT = 0.7


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secretscan.report(secretscan.scan(docs, secretscan.train(secretscan.labelled_sample(docs))))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


@query
def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference.format_pairs(*preference.swapped_answers(table(spark, sf_dir, "conversations")))
    spans = [F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c) for c in ("chosen_spans", "rejected_spans")]
    return out.select("pair_id", "n_common", "prompt", "chosen", spans[0], "rejected", spans[1])


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    return langid.identify(docs, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(pii.scan(docs, pii.fit(pii.labelled_proposals(docs))))


@query
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


@query
def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pieces.id_digests(pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")))


@query
def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


@query
def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.report(licences.scan(docs, licences.build_index(docs)))


@query
def op13_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(filteraudit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
