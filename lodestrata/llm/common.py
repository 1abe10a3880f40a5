"""What the operators share: reading, tables written to cut lineage, and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: ASCII white space, as a class for Java and Python patterns: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
BATCH = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and
    Spark runs on one machine, as in tests, a temporary folder; on a cluster that would be lost to the executors: an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder: lineage ends there, a lost executor costs no more
    than its own tasks, and joins know the size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; the session sends BATCH rows at a time to Python from now on, if it was left to send 10,000: buffers that
    double as they fill would hold some hundred megabytes of long texts in each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key, "10000") == "10000":
        df.sparkSession.conf.set(key, str(BATCH))
    return df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def spaced(c: Column, separators: str) -> Column:
    """A text's words with one space between them. Separators are replaced, not words extracted: extraction copies the
    whole text for every match, which takes the square of a long text's length."""
    return F.trim(F.regexp_replace(c, f"{separators}+", " "))


def spaced_words(c: Column) -> Column:
    """How many words a text of `spaced` has; null for a null."""
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1).cast("long")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n).cast("long"))


def remainder_of(doc_id, n: int) -> int:
    """The same on the driver."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def training_rows(docs: DataFrame, labels: DataFrame, label: str, kept: Column, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most `limit` labelled documents: the first in the order of a hash of doc_id, which every run and
    every partitioning repeats; of rows with one doc_id that whose text has the least hash. The chosen ids are `limit` at
    most, so they may be broadcast."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & kept)
    chosen = own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(limit)
    ids = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores in front until no column has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_score(df: DataFrame, keep: int, name: str) -> StructType:
    """The schema of the first columns and a score."""
    return StructType([*df.schema.fields[:keep], StructField(name, DoubleType())])
