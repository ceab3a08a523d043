"""What the corpus operators share: shared storage, row identities and joins behind a size check."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row keys that may be broadcast: 500,000 take about 50 MB.
BROADCAST_ROWS = 500_000
#: Bytes and rows of an Arrow batch between Spark and a worker, so that neither holds more than a few texts at a time.
ARROW_BYTES, ARROW_ROWS = "4m", "2000"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or on a local master an own one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs one file."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't have, for helpers beside a caller's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small: a worker's memory then follows a batch, not a task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def trim() -> None:
    """Give back the memory that a worker has freed: it stays for later tasks, beside other workers and the JVM."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(ctypes.CDLL(libc), "malloc_trim"):
        ctypes.CDLL(libc).malloc_trim(0)


def _one_scan(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is one row of a file: a scan with nothing but projections and filters above it."""
    nodes = docs._jdf.queryExecution().analyzed().toString().splitlines()
    return all(re.match(r"[\s:+\-]*(Project|Filter|SubqueryAlias|Relation)\b", line) for line in nodes)


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name`` that tells its rows apart and stays the same whenever they are read again.

    Rows of a Parquet scan are named by their file and place in it. Other rows are numbered and written once.
    """
    if _one_scan(docs):
        try:
            meta = docs.metadataColumn("_metadata")
            path = meta["file_path"]
            return docs.withColumn(name, F.struct(F.xxhash64(path).alias("file"), F.xxhash64(F.reverse(path)).alias("check"), meta["row_index"].alias("at")))
        except AnalysisException:  # a scan of a format that doesn't number its rows
            pass
    zero = F.lit(0).cast("long")
    return materialise(docs.withColumn(name, F.struct(zero.alias("file"), zero.alias("check"), F.monotonically_increasing_id().alias("at"))), "keyed")


def drop_rows(docs: DataFrame, key: str, gone: DataFrame, gone_rows: int) -> DataFrame:
    """Rows of ``docs`` whose ``key`` isn't in the one-column ``gone``, without that column; a broadcast up to BROADCAST_ROWS, a shuffled anti join beyond."""
    (other,) = fresh(docs, "gone")
    gone = gone.toDF(other)
    gone = F.broadcast(gone) if gone_rows <= BROADCAST_ROWS else gone.hint("merge")
    return docs.join(gone, docs[key] == gone[other], "left_anti").drop(key)


def without_white(text: Column) -> Column:
    """The text (null: empty) without the characters [\\x20\\x09-\\x0D]."""
    out = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def bucketed(df: DataFrame, label: str, buckets: int, *keys: str) -> DataFrame:
    """Write ``df`` in the shared folder by buckets of its keys: joins of two such tables by these keys move no rows.

    The folder outlives the session's catalog entry, which ``forget`` takes back.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    found = spark.table(name)
    found._bucketed = name
    return found


def forget(table: DataFrame) -> None:
    """Take a bucketed table out of the session's catalog and its files out of the shared folder: nothing reads it any more."""
    spark, name = table.sparkSession, table._bucketed
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
