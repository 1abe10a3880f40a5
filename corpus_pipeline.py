"""Documents to encoded training text: toxic and poor texts go, one of each group of near copies stays, sources are mixed to
their weights, and what is left is encoded.

Each stage takes (spark, docs, folder), works on all rows that the stage before kept, and returns the columns of documents;
the last returns the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe, jaccard, mixing, quality, toxicity
from lodestrata.llm.common import fresh, read, remainder, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose toxicity score is below 0.5."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    name = fresh(docs.columns, "score")
    return toxicity.score(docs, model, docs.columns, name=name).where(F.col(name) < 0.5).drop(name)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose quality score is at least 0.5."""
    model = quality.train(docs, read(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    name = fresh(docs.columns, "score")
    return quality.score(docs, model, docs.columns, name=name).where(F.col(name) >= 0.5).drop(name)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text, that with the least doc_id, of each group of near copies."""
    return jaccard.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes sources at their weights: a text for each lap, cut at words where a lap is partial."""
    return mixing.apply(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the number of tokens and their ids as little-endian 32-bit integers."""
    return bpe.encode(docs, ["doc_id", "source"])


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("ngram_jaccard", jaccard_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: Models, components and byte-pair merges are beyond SQL; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
