"""A keyed table: versioned upserts and deletes, point, multi-key, range and ordered reads as of any epoch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators.mvcc import EpochClock, Transaction, history, one_sided, snapshot
from lodestrata.schema import EPOCH, KEY, SEQ, TOMB, kv_log


class KvTransaction(Transaction):
    def put(self, key: str, *values) -> None:
        """Upsert; a later put of the same key in the same transaction wins."""
        if (seq := self.next_seq()) is not None:
            self.owner._check(key, values)
            self.buffer.append((key, self.write_epoch, seq, False, *values))

    def delete(self, key: str) -> None:
        if (seq := self.next_seq()) is not None:
            self.buffer.append((key, self.write_epoch, seq, True, *[None] * self.owner.arity))

    def get(self, key: str) -> DataFrame:
        return self.owner.get(key, self.read_epoch)

    def scan(self) -> DataFrame:
        return self.owner.scan(self.read_epoch)


class KvTable:
    """The log is a DataFrame of (k, epoch, seq, tomb, values...); or, with a store, Parquet segments that are flushed and
    merged. All reads are lazy DataFrames, so key predicates and column choices reach the files.
    """

    def __init__(self, log: DataFrame, clock: EpochClock | None = None, store=None, key_bytes: int | None = None):
        self.fixed, self._clock, self.store, self.key_bytes = log, clock, store, key_bytes
        self.columns = [c for c in log.columns if c not in (KEY, EPOCH, SEQ, TOMB)]
        self.order = (EPOCH, SEQ) if SEQ in log.columns else (EPOCH,)
        self.schema, self.pending = log.schema, []
        self.compacting = False  # merges are synchronous

    @classmethod
    def create(cls, spark, columns, store=None, key_bytes: int | None = None) -> KvTable:
        schema = kv_log(columns)
        return cls(spark.createDataFrame([], schema), store=store, key_bytes=key_bytes)

    @property
    def clock(self) -> EpochClock:
        """Made when it is first asked for: a table over a log or store that has rows goes on behind their newest epoch, which the
        manifest knows of a store."""
        if self._clock is None:
            newest = self.fixed.agg(F.max(EPOCH)).first()[0] or 0
            self._clock = EpochClock(max(newest, self.store.max_epoch() if self.store else 0) + 1)
        return self._clock

    @property
    def arity(self) -> int:
        return len(self.columns)

    def _check(self, key, values) -> None:
        if len(values) != self.arity:
            raise ValueError(f"{len(values)} values for {self.arity} columns")
        if self.key_bytes and len(key.encode()) > self.key_bytes:
            raise ValueError(f"key longer than {self.key_bytes} bytes")

    def _append(self, rows: list[tuple]) -> None:
        self.pending += rows

    @property
    def log(self) -> DataFrame:
        return self._log()

    def _log(self, low: str | None = None, high: str | None = None) -> DataFrame:
        """All versions; of a store's files only those that may hold keys from low to high."""
        parts = [self.store.read(self.schema, low=low, high=high) if self.store and self.store.files() else None, self.fixed]
        if self.pending:
            parts.append(self.fixed.sparkSession.createDataFrame(self.pending, self.schema))
        parts = [p for p in parts if p is not None]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # writing
    def begin(self, read_only: bool = False, strict: bool = True) -> KvTransaction:
        return KvTransaction(self, self.clock, read_only, strict)

    def put_many(self, rows: DataFrame) -> int:
        """Upserts (k, values...) as one transaction; repeated keys keep one of their rows, the largest."""
        return self._bulk(rows.select(KEY, *self.columns), False)

    def delete_many(self, keys: DataFrame) -> int:
        return self._bulk(keys.select(KEY, *[F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.columns]), True)

    def _bulk(self, rows: DataFrame, tomb: bool) -> int:
        epoch, _ = self.clock.begin()
        try:
            one = rows.groupBy(KEY).agg(F.max(F.struct(*self.columns)).alias("_v")).select(KEY, *[F.col(f"_v.{c}").alias(c) for c in self.columns])
            batch = one.select(KEY, F.lit(epoch).cast("long").alias(EPOCH), F.lit(0).cast("long").alias(SEQ), F.lit(tomb).alias(TOMB), *self.columns)
            if self.store:
                self.store.append(batch)
            else:
                self.fixed = self.fixed.unionByName(batch)
        finally:
            self.clock.end(epoch)
        return epoch

    def flush(self) -> None:
        """Writes the pending rows as a level-0 segment."""
        if self.store and self.pending:
            self.store.append(self.fixed.sparkSession.createDataFrame(self.pending, self.schema))
            self.pending = []

    def close(self) -> None:
        """Flushes what is pending."""
        self.flush()

    def __enter__(self) -> KvTable:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # reading
    def scan(self, epoch: int | None = None, columns=None, low: str | None = None, high: str | None = None) -> DataFrame:
        """The live rows, all or as of an epoch, with the columns asked for; low and high: keys that files are chosen by."""
        return snapshot(self._log(low, high), [KEY], epoch, self.columns if columns is None else columns, self.order)

    def get(self, key: str, epoch: int | None = None) -> DataFrame:
        return self.scan(epoch, low=key, high=key).where(F.col(KEY) == key)

    def multi_get(self, keys: DataFrame, epoch: int | None = None) -> DataFrame:
        """A row for each asked key (column k) with `found` and the values; misses have nulls."""
        asked = keys.select(KEY)
        # only the asked keys are deduplicated
        hits = snapshot(self.log.join(asked.distinct(), KEY, "left_semi"), [KEY], epoch, self.columns, self.order)
        return asked.join(hits.withColumn("found", F.lit(True)), KEY, "left").select(KEY, F.coalesce("found", F.lit(False)).alias("found"), *self.columns)

    def contains(self, keys: DataFrame, epoch: int | None = None) -> DataFrame:
        """The live rows whose key is among those of `keys` (column k)."""
        return snapshot(self.log.join(keys.select(KEY), KEY, "left_semi"), [KEY], epoch, self.columns, self.order)

    def value_range(self, column: str, low, high, epoch: int | None = None) -> DataFrame:
        """Live rows with low <= column <= high; strings compare by bytes."""
        return self.scan(epoch).where(F.col(column).between(low, high))

    def value_bound(self, column: str, op: str, bound, epoch: int | None = None) -> DataFrame:
        """Live rows on one side of a bound (op: lt, le, gt, ge)."""
        return self.scan(epoch).where(one_sided(F.col(column), op, bound))

    def key_range(self, low: str, high: str, epoch: int | None = None) -> DataFrame:
        return self.scan(epoch, low=low, high=high).where(F.col(KEY).between(low, high))

    def scan_k(self, start: str, k: int, epoch: int | None = None) -> DataFrame:
        """The first k live rows with key >= start, in key order (k rows of each task reach one)."""
        return self.scan(epoch, low=start).where(F.col(KEY) >= start).orderBy(KEY).limit(k)

    def iterate(self, start: str = "", epoch: int | None = None) -> Iterator[T.Row]:
        """Rows in key order, fetched a partition at a time."""
        return self.scan(epoch, low=start).where(F.col(KEY) >= start).orderBy(KEY).toLocalIterator()

    def pages(self, start: str, size: int, epoch: int | None = None) -> Iterator[list[T.Row]]:
        """Keyset pages: each begins after the last key of the one before."""
        rows = self.scan_k(start, size, epoch).collect()
        while rows:
            yield rows
            rows = self.scan(epoch).where(F.col(KEY) > rows[-1][KEY]).orderBy(KEY).limit(size).collect()

    def deleted(self, epoch: int | None = None) -> DataFrame:
        """(k, del_epoch) of keys whose newest version is a deletion."""
        return snapshot(self.log, [KEY], epoch, [EPOCH], self.order, drop_tomb=False).where(TOMB).select(KEY, F.col(EPOCH).alias("del_epoch"))

    def history(self) -> DataFrame:
        return history(self.log, [KEY]).select(KEY, EPOCH, "prev_epoch", "next_epoch", TOMB)

    def key_bounds(self) -> DataFrame:
        return self.log.agg(F.min(KEY).alias("k_min"), F.max(KEY).alias("k_max"))
