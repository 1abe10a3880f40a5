"""The queries of these operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe, html, jaccard, licenses, mixing, quality, quotes, search, toxicity, winnowing
from lodestrata.llm.common import read, remainder


def op1_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read(spark, folder, "documents"))


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(read(spark, folder, "documents"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    m = mixing.mix(read(spark, folder, "documents"), keep_text=False)
    return m.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), "source")


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = quality.train(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = toxicity.train(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(read(spark, folder, "pages"), ["page_id", "url"])


def op7_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.compare(read(spark, folder, "documents"))


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.conversations(read(spark, folder, "conversations"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(read(spark, folder, "documents"), ["doc_id"])


def op10_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    asked = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    return search.search(docs, asked)


def queries() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_license_scans, op2_ngram_jaccard, op3_mixing, op4_quality_classifier, op5_toxicity, op6_html_extraction, op7_winnowing, op8_chat_formatting, op9_bpe, op10_topk_search)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scans": licenses.sql()}
