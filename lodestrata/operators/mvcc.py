"""Snapshots over version logs, and the epochs that order the versions.

Everything else rests on :func:`snapshot`: restrict a log to the epochs a reader may see, keep the newest version of each
key, and only then drop deletions. Predicates on values belong after it, since a newer version that doesn't match must
still hide an older one that does; predicates on keys may stand on either side, as Catalyst moves them below the
aggregation and into the Parquet scan.
"""

from __future__ import annotations

import bisect
import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.schema import EPOCH, SEQ, TOMB


class ReadOnlyError(RuntimeError):
    """A write was tried in a read-only transaction."""


def latest(log: DataFrame, keys, payload=None, order=(EPOCH,), keep_order: bool = False) -> DataFrame:
    """The newest version of each key, deletions included.

    payload: columns to carry (default: all others). Only these are read: a column inside the aggregated struct can't be
    pruned later. The aggregation is partial before its one shuffle, so a hot key shrinks to a row per task.
    """
    keys = list(keys)
    payload = [c for c in log.columns if c not in keys] if payload is None else list(payload)
    carried = list(dict.fromkeys([*payload, *(order if keep_order else ())]))
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return log.groupBy(*keys).agg(F.max_by(F.struct(*carried), rank).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in carried])


def snapshot(log: DataFrame, keys, epoch: int | None = None, payload=None, order=(EPOCH,), tomb: str = TOMB, drop_tomb: bool = True) -> DataFrame:
    """The live rows as of an epoch (None: all of the log)."""
    keys = list(keys)
    seen = log if epoch is None else log.where(F.col(EPOCH) <= epoch)
    payload = [c for c in log.columns if c not in (*keys, tomb)] if payload is None else list(payload)
    rows = latest(seen, keys, [*payload, tomb], order)
    return rows.where(~F.col(tomb)).drop(tomb) if drop_tomb else rows


def history(log: DataFrame, keys, order: str = EPOCH) -> DataFrame:
    """Every version with the epochs before and after it for the same key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    return log.withColumns({"prev_epoch": F.lag(order).over(w), "next_epoch": F.lead(order).over(w)})


def active_floor(intervals: DataFrame, begin: str, end: str, width: int) -> DataFrame:
    """For each interval, the smallest begin of those active at its own begin, less one (the low watermark).

    Intervals may be at most `width` long. Each is entered in the blocks of `width` that it touches (two at most), so that
    the search is an equi-join on the block with a residual test.
    """
    block = lambda c: F.floor(c / F.lit(width)).cast("long")
    probes = intervals.select(F.col(begin).alias("_at"), block(F.col(begin)).alias("_block"))
    open_ = intervals.select(F.col(begin).alias("_b"), F.col(end).alias("_e")).select("_b", "_e", F.explode(F.sequence(block(F.col("_b")), block(F.col("_e")))).alias("_block"))
    hit = probes.join(open_, "_block").where((F.col("_b") <= F.col("_at")) & (F.col("_e") >= F.col("_at")))
    return hit.groupBy("_at").agg((F.min("_b") - 1).alias("read_epoch")).withColumnRenamed("_at", "write_epoch")


class EpochClock:
    """Hands out write epochs and read watermarks; thread-safe, on the driver.

    A read-write transaction reads at min(in flight) - 1, so never its own writes nor anything newer than the oldest
    writer still at work. A read-only one reads at the last epoch below which everything is finished.
    """

    def __init__(self, start: int = 1):
        self._lock, self._next, self._active = threading.Lock(), start, []

    def begin(self) -> tuple[int, int]:
        """(write epoch, read epoch) of a new writer."""
        with self._lock:
            epoch, self._next = self._next, self._next + 1
            bisect.insort(self._active, epoch)
            return epoch, self._active[0] - 1

    def end(self, epoch: int) -> None:
        with self._lock:
            self._active.remove(epoch)

    def read_epoch(self) -> int:
        with self._lock:
            return (self._active[0] if self._active else self._next) - 1


class Transaction:
    """Epochs of one unit of work. Writes are buffered rows that the owner appends to its log when the block ends."""

    def __init__(self, owner, clock: EpochClock, read_only: bool = False, strict: bool = True):
        self.owner, self.clock, self.read_only, self.strict = owner, clock, read_only, strict
        self.write_epoch, self.read_epoch = (None, clock.read_epoch()) if read_only else clock.begin()
        self.valid, self.seq, self.buffer = True, 0, []

    def next_seq(self) -> int | None:
        """The next place in this epoch; None if the write is to be ignored (read-only and not strict)."""
        if self.read_only or not self.valid:
            if self.strict:
                raise ReadOnlyError("a read-only or ended transaction can't write")
            return None
        self.seq += 1
        return self.seq

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        self.close(discard=kind is not None)

    def close(self, discard: bool = False) -> None:
        if not self.valid:
            return
        self.valid = False
        try:
            if self.buffer and not discard:
                self.owner._append(self.buffer)
        finally:
            if not self.read_only:
                self.clock.end(self.write_epoch)


def one_sided(column: Column, op: str, bound) -> Column:
    """A half-open comparison by name: lt, le, gt or ge."""
    return {"lt": column < bound, "le": column <= bound, "gt": column > bound, "ge": column >= bound}[op]
