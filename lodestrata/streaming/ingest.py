"""Structured Streaming into a keyed table: an extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, store, checkpoint: str, max_seconds: float | None = None) -> StreamingQuery:
    """Appends each micro-batch of log rows (k, epoch, seq, tomb, values...) to a SegmentStore as a level-0 flush.

    A batch that is replayed after a failure writes the same (k, epoch, seq) again, which no snapshot can tell apart.
    """

    def append(batch: DataFrame, _id: int) -> None:
        if not batch.isEmpty():
            store.append(batch)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if max_seconds is None else writer.trigger(processingTime=f"{max_seconds} seconds")).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Events by key and tumbling window; state of windows older than the watermark is dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
