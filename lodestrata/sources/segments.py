"""A versioned set of Parquet segments: flush, merge, snapshots by manifest, vacuum.

Each version is one JSON manifest; a new one is written under a temporary name and renamed, through Hadoop's file system,
so the folder may be in any store Spark can write to. Segments are immutable and range-partitioned by key, in files of about
FILE_BYTES, with their level, size, row count, newest epoch and the bounds of one key column in the manifest, by which whole
files are skipped.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.bloom import parquet_options
from lodestrata.operators import lsm


FILE_BYTES, FILE_ROWS = 256 << 20, 10_000_000  # about the size of a file, and the rows it has at most
MOST_TASKS, UNKNOWN = 20_000, 1 << 60  # tasks of a write, whatever a join's size is taken for; what the planner says if it can't tell


class SegmentStore:
    """key: the columns that a row is told by; bound: the one whose least and largest value each file is known by; pick: what
    chooses the files of a merge."""

    def __init__(self, spark: SparkSession, root: str, key=("k",), files_per_segment: int = 4, last_level: int = 4, bound: str | None = None, pick=lsm.pick):
        self.bound, self.pick = bound or key[0], pick
        self.spark, self.root, self.key, self.n_files, self.last = spark, root.rstrip("/"), list(key), files_per_segment, last_level
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        versions = self.versions()
        self.version = versions[-1] if versions else 0

    # manifests
    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "_")

    def files(self, version: int | None = None) -> list[dict]:
        version = self.version if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.root}/manifest/{version:012d}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def max_epoch(self) -> int:
        return max((f["max_epoch"] or 0 for f in self.files()), default=0)

    def get_json(self, name: str):
        """What put_json stored, or None."""
        path = self._path(f"{self.root}/{name}.json")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def put_json(self, name: str, value) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}.json"), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _publish(self, files: list[dict]) -> None:
        new = self.version + 1
        temp, final = self._path(f"{self.root}/manifest/_{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/{new:012d}.json")
        out = self._fs.create(temp)
        out.write(bytearray(json.dumps(files).encode()))
        out.close()
        if not self._fs.rename(temp, final):
            raise RuntimeError(f"version {new} was published by another writer")
        self.version = new

    # writing
    def _write(self, rows: DataFrame, level: int) -> list[dict]:
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # as the planner estimates it
        n = max(self.n_files, min(-(-size // FILE_BYTES), MOST_TASKS) if size < UNKNOWN else 0)
        ordered = rows.repartitionByRange(n, *self.key).sortWithinPartitions(*self.key)
        ordered.write.options(**parquet_options(self.key[:1])).option("maxRecordsPerFile", FILE_ROWS).parquet(path)
        k, sizes = self.bound, {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(path))}
        stats = self.spark.read.schema(rows.schema).parquet(path).groupBy(F.input_file_name().alias("path")).agg(F.min(k).alias("k_min"), F.max(k).alias("k_max"), F.count(F.lit(1)).alias("n_rows"), F.max("epoch").alias("max_epoch"))
        return [{**r.asDict(), "level": level, "bytes": sizes.get(r["path"].rpartition("/")[2], 0)} for r in stats.collect()]  # a row for each file

    def append(self, rows: DataFrame) -> None:
        """A flush: the rows become files of level 0."""
        self._publish(self.files() + self._write(rows, 0))

    # reading
    def read(self, schema, version: int | None = None, low=None, high=None) -> DataFrame:
        """All versions of rows; files whose key bounds miss [low, high] are not opened."""
        paths = [f["path"] for f in self.files(version) if (low is None or f["k_max"] >= low) and (high is None or f["k_min"] <= high)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # maintenance
    def merge(self, schema, level: int = 0, oldest_pinned: int | None = None, force: bool = False) -> bool:
        """Merges files of a level with what they overlap in the next. Every snapshot from `oldest_pinned` on is kept.

        False if there was nothing to merge.
        """
        files = self.files()
        chosen = [f for f in files if f["level"] in (level, level + 1)] if force else self.pick(files, level, self.last)
        if not chosen or level >= self.last:
            return False
        rest = [f for f in files if f not in chosen]
        deepest = not any(f["level"] > level + 1 for f in files) and not any(f["level"] <= level and f not in chosen for f in files)
        rows = self.spark.read.schema(schema).parquet(*[f["path"] for f in chosen])
        self._publish(rest + self._write(prune(rows, self.key, oldest_pinned, deepest), level + 1))
        return True

    def compact_all(self, schema, oldest_pinned: int | None = None) -> None:
        """Merges everything into one level."""
        if files := self.files():
            rows = self.spark.read.schema(schema).parquet(*[f["path"] for f in files])
            self._publish(self._write(prune(rows, self.key, oldest_pinned, True), self.last))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last `keep` versions and the files that only they use; returns how many files went."""
        versions = self.versions()
        old, new = versions[:-keep], versions[-keep:]
        live = {f["path"] for v in new for f in self.files(v)}
        dead = {f["path"] for v in old for f in self.files(v)} - live
        for p in dead:
            self._fs.delete(self._path(p), False)
        for v in old:
            self._fs.delete(self._path(f"{self.root}/manifest/{v:012d}.json"), False)
        return len(dead)


def prune(rows: DataFrame, key, oldest_pinned: int | None, deepest: bool) -> DataFrame:
    """The versions that a reader at `oldest_pinned` or later can still see: all newer ones and the newest not newer than
    it. Deletions are dropped only at the deepest level, where nothing older is left for them to hide."""
    w = Window.partitionBy(*key).orderBy(F.col("epoch").desc(), *([F.col("seq").desc()] if "seq" in rows.columns else []))
    old = F.lit(True) if oldest_pinned is None else F.col("epoch") <= oldest_pinned
    ranked = rows.withColumn("_rank", F.sum(F.when(old, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ranked.where(~old | (F.col("_rank") == 1))
    if deepest and "tomb" in rows.columns:
        kept = kept.where(~(F.col("tomb") & old))
    return kept.drop("_rank")
