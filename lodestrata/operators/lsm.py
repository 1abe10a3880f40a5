"""Log-structured maintenance as dataflow: runs, merges, layouts, merge policy and access counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.mvcc import latest
from lodestrata.operators.ordinals import number_rows

BLOCK_BYTES, KEY_BYTES, CODE_BYTES, MEMTABLE_ROWS = 4096, 16, 4, 4096
LEVELING, TIERING = 1, 2


def rows_per_block(value_columns: int, block: int = BLOCK_BYTES) -> int:
    return block // (KEY_BYTES + CODE_BYTES * value_columns)


def run_of(epoch: Column, size: int) -> Column:
    return F.floor((epoch - 1) / F.lit(size)).cast("long")


def flush_runs(log: DataFrame, size: int = MEMTABLE_ROWS) -> DataFrame:
    """What each run of `size` puts holds: puts, keys, key bounds, newest epoch."""
    per_key = log.groupBy(run_of(F.col("epoch"), size).alias("run"), "k").agg(F.count(F.lit(1)).alias("_n"), F.max("epoch").alias("_e"))
    return per_key.groupBy("run").agg(F.sum("_n").alias("puts"), F.count(F.lit(1)).alias("keys"), F.min("k").alias("key_min"), F.max("k").alias("key_max"), F.max("_e").alias("max_epoch"))


def merge_runs(log: DataFrame, keys, run: Column, name: str, payload, drop_tomb: bool) -> DataFrame:
    """Merges sorted runs: within a run the newest version of a key, across runs the newest run. Runs grow with epochs, so
    one aggregation on the epoch does both."""
    merged = latest(log.withColumn(name, run), keys, [*payload, name, "tomb"])
    return merged.where(~F.col("tomb")) if drop_tomb else merged


def layout(keys: DataFrame, key: str, size: int, block: str, count: str) -> DataFrame:
    """(block, key_min, key_max, count) of a table cut every `size` rows in key order."""
    placed = number_rows(keys.select(F.col(key).alias("k")), "k")
    return placed.groupBy(F.floor(F.col("pos") / F.lit(size)).cast("long").alias(block)).agg(F.min("k").alias("key_min"), F.max("k").alias("key_max"), F.count(F.lit(1)).alias(count))


def merge_type(w, d, recent_read, recent_write) -> Column:
    """Leveling if sqrt(deletes / writes) plus the share of recent writes is over 1, else tiering.

    Without writes the first term is null, hence tiering.
    """
    return F.when(F.sqrt(F.try_divide(d.cast("double"), w)) + recent_write.cast("double") / (recent_read + recent_write) > 1, LEVELING).otherwise(TIERING)


def merge_decisions(accesses: DataFrame, bucket: Column, order: str, is_read: Column, is_delete: Column, window: int = 160) -> DataFrame:
    """Counts of each bucket and the merge it should get; `window`: its last accesses, which count as recent.

    The last accesses of a bucket are found by a rank filter, which Spark also applies before the shuffle, so a hot bucket
    sends at most `window` rows a task; the totals are partial sums.
    """
    a = accesses.select(bucket.alias("bucket"), F.col(order).alias("_o"), is_read.alias("_r"), is_delete.alias("_x"))
    totals = a.groupBy("bucket").agg(F.count_if(~F.col("_r") & ~F.col("_x")).alias("w"), F.count_if("_x").alias("d"))
    ranked = a.withColumn("_n", F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("_o").desc()))).where(F.col("_n") <= window)
    recent = ranked.groupBy("bucket").agg(F.count_if("_r").alias("rr"), F.count_if(~F.col("_r")).alias("rw"))
    return totals.join(recent, "bucket").select("bucket", "w", "d", "rr", "rw", merge_type(F.col("w"), F.col("d"), F.col("rr"), F.col("rw")).alias("merge_type"))


def level_file_limit(level: int, base: int = 4, ratio: int = 10) -> int:
    """A relational level from 1 on is merged down once it has more files than this."""
    return base * ratio ** (level - 1)


def bucket_byte_limit(level: int, memtable: int = 1 << 20, fan_in: int = 32) -> int:
    """A source bucket of a graph level is merged down from this many bytes on."""
    return memtable * fan_in ** (level + 1)


def pick(files: list[dict], level: int, last: int) -> list[dict]:
    """Files to merge from a level: its oldest (level 0) or, over its limit, the one with the smallest key, together with
    those of the next level whose key ranges overlap. Nothing from the last level."""
    own = sorted((f for f in files if f["level"] == level), key=lambda f: (f["max_epoch"], f["k_min"]) if level == 0 else (f["k_min"],))
    if level >= last or not own or level and len(own) <= level_file_limit(level):
        return []
    first = own[0]
    return [first, *(f for f in files if f["level"] == level + 1 and f["k_min"] <= first["k_max"] and f["k_max"] >= first["k_min"])]


def pick_bytes(files: list[dict], level: int, last: int, memtable: int = 1 << 20, fan_in: int = 32) -> list[dict]:
    """The same for a level of edges: over its byte limit, or at level 0, its files that overlap the one with the smallest
    source, together with those of the next level that they overlap."""
    own = sorted((f for f in files if f["level"] == level), key=lambda f: f["k_min"])
    if level >= last or not own or level and sum(f["bytes"] for f in own) <= bucket_byte_limit(level, memtable, fan_in):
        return []
    chosen, high = [], own[0]["k_max"]
    for f in own:
        if f["k_min"] <= high:
            chosen.append(f)
            high = max(high, f["k_max"])
    return chosen + [f for f in files if f["level"] == level + 1 and f["k_min"] <= high and f["k_max"] >= own[0]["k_min"]]
