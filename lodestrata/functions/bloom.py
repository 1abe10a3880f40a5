"""Existence filters: sizes by the usual formulas, a Spark-built filter for parity tests, and the Parquet options that do the work."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sizing(n: int, fpp: float = 0.01) -> tuple[int, int]:
    """(bits, number of hashes) for n keys: bits rounded up to whole bytes, 1 to 32 hashes."""
    bits = max(8, (int(-math.log(fpp) * n / math.log(2) ** 2) + 7) // 8 * 8)
    return bits, min(32, max(1, int(0.693147 * (bits // max(1, n)))))


def _places(key, bits: int, hashes: int):
    h, step = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    return F.array(*[F.pmod(h + F.lit(i) * F.pmod(step, F.lit(1 << 31)), F.lit(bits)) for i in range(hashes)])


def build(keys: DataFrame, column: str, n: int, fpp: float = 0.01) -> DataFrame:
    """The set bits as 64-bit words (word, mask), by a bitwise OR that is partial before its shuffle."""
    bits, hashes = sizing(n, fpp)
    places = keys.select(F.explode(_places(F.col(column), bits, hashes)).alias("p"))
    return places.select((F.col("p") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("m")).groupBy("word").agg(F.expr("bit_or(m)").alias("mask"))


def probe(df: DataFrame, column: str, words: DataFrame, n: int, fpp: float = 0.01) -> DataFrame:
    """Adds `maybe`: false only if the key was certainly not inserted."""
    bits, hashes = sizing(n, fpp)
    keys = df.select(column).distinct()
    asked = keys.select(column, F.explode(_places(F.col(column), bits, hashes)).alias("p")).select(column, (F.col("p") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("m"))
    hits = asked.join(words, "word", "left").groupBy(column).agg(F.min(F.when(F.col("mask").bitwiseAND(F.col("m")) != 0, 1).otherwise(0)).alias("_all"))
    return df.join(hits, column, "left").withColumn("maybe", F.coalesce(F.col("_all") == 1, F.lit(False))).drop("_all")


def parquet_options(columns, ndv: int | None = None) -> dict[str, str]:
    """Writer options that store a Bloom filter for each of the columns in every row group."""
    out = {}
    for c in columns:
        out[f"parquet.bloom.filter.enabled#{c}"] = "true"
        if ndv:
            out[f"parquet.bloom.filter.expected.ndv#{c}"] = str(ndv)
    return out
