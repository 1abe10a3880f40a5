"""Global positions without a single-task sort.

A table is dealt into ranges of its sort key by fixed bounds, each range is numbered by itself, and the sizes of the
ranges before it are added. The bounds come from a sample and only steer the balance: any bounds give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds(df: DataFrame, key: str, parts: int, per_part: int = 20) -> list:
    """At most parts - 1 split points of the key, from about per_part * parts hashed values."""
    total = df.count()
    if parts < 2 or total < 2 * parts * per_part:
        return []
    keep = max(1, total // (parts * per_part))
    sample = sorted(r[0] for r in df.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(keep)) == 0)).select(key).distinct().limit(4 * parts * per_part).collect())
    return [sample[len(sample) * i // parts] for i in range(1, parts)] if len(sample) >= parts else []


def range_of(key: Column, cuts: list) -> Column:
    """The number of cuts at or below the key, by a search tree of comparisons (nulls: range 0)."""
    cuts = sorted(set(cuts))

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= F.lit(cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def number_rows(df: DataFrame, key: str, ties=(), name: str = "pos", parts: int | None = None) -> DataFrame:
    """Adds the 0-based position of each row by (key, *ties) in ascending order, nulls first, as BIGINT."""
    return _running(df, key, ties, parts, lambda w: F.row_number().over(w).cast("long") - 1, F.count(F.lit(1)), name)


def running_sum(df: DataFrame, key: str, value: str, ties=(), name: str = "total", parts: int | None = None) -> DataFrame:
    """Adds the inclusive running sum of a column by (key, *ties)."""
    return _running(df, key, ties, parts, lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(value), name)


def _running(df, key, ties, parts, within, total, name):
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_range", range_of(F.col(key), bounds(df, key, min(parts, 512))))
    sizes = dealt.groupBy("_range").agg(total.alias("_n"))
    # a row for each range, 512 at most
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_range").orderBy(key, *ties)
    return dealt.withColumn("_in", within(w)).join(F.broadcast(before), "_range").withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_range", "_in", "_before")
