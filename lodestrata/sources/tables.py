"""Parquet sources: the supplied tables, and the logs that are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read by Spark from whatever store the folder is in."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def kv_log(spark: SparkSession, folder: str) -> DataFrame:
    """events as versions of a keyed table: errors are deletions."""
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").cast("string").alias("k"), (F.col("event_id") + 1).alias("epoch"), (F.col("event_type") == "error").alias("tomb"), F.col("event_type").alias("v1"), F.get_json_object("props", "$.k").alias("v2"))


def edge_log(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select((F.col("event_id") % 2).cast("int").alias("label"), F.col("user_id").alias("src"), F.get_json_object("props", "$.k").try_cast("int").alias("dst"), F.col("value").alias("prop"), (F.col("event_id") + 1).alias("epoch"), (F.col("event_type") == "error").alias("tomb"))
