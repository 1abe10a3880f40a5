"""Timings of operators: a driver-side recorder, and the aggregation to count, sum and p99."""

from __future__ import annotations

import contextlib
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def p99_index(n: int) -> int:
    """The 0-based place of the 99th percentile among n sorted samples."""
    return int(0.99 * n // 1)


def latency(samples: DataFrame, op: str, value: str) -> DataFrame:
    """(op, n, total, p99) of whole-number samples; p99 is the sample at 0-based place floor(0.99 n) in order.

    Samples are first counted by (op, value), partial before the shuffle, so a hot operator costs a row for each distinct
    value; the place is then found in the running counts.
    """
    counts = samples.groupBy(F.col(op).alias("op"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("op")
    placed = counts.withColumns({"n": F.sum("_c").over(w), "total": F.sum(F.col("_v") * F.col("_c")).over(w), "_to": F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))})
    at = F.floor(F.lit(0.99) * F.col("n"))
    return placed.where((F.col("_to") > at) & (F.col("_to") - F.col("_c") <= at)).select("op", F.col("n").cast("long"), F.col("total").cast("long"), F.col("_v").cast("long").alias("p99"))


class Recorder:
    """Collects wall times by operator name; one row per call, made a DataFrame on demand."""

    def __init__(self):
        self.rows: list[tuple[str, int]] = []

    @contextlib.contextmanager
    def timed(self, op: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((op, int((time.perf_counter() - began) * 1e6)))

    def summary(self, spark) -> DataFrame:
        """(op, n, total, p99) in microseconds; no rows without calls."""
        return latency(spark.createDataFrame(self.rows, "op string, us bigint"), "op", "us")
