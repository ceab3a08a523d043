"""Writers that can run twice: upserts by key over partitions, appends without repeats, run records and ledgers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strictbefore.operators.reconcile import keep_first, merge


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder for a written table under the shared one, spark.checkpoint.dir; on a local master an own one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written in the shared folder and read back, so that what uses them twice doesn't compute them twice."""
    path = scratch(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def upsert(new: DataFrame, path: str, keys: list[str], new_wins: bool = True, version: str = "v") -> str:
    """Merge ``new`` into the newest version under ``path`` and write the next; readers of the old one aren't disturbed.

    Returns the new version's path. Rows of ``new`` must have distinct keys.
    """
    spark = new.sparkSession
    latest = current(spark, path, version)
    number = int(latest.rsplit(version, 1)[1]) + 1 if latest else 0
    rows = merge(spark.read.parquet(latest), new, keys, new_wins).drop("conflicts") if latest else new
    target = f"{path}/{version}{number}"
    rows.write.mode("overwrite").parquet(target)
    return target


def current(spark: SparkSession, path: str, version: str = "v") -> str | None:
    """The newest complete version under ``path``."""
    number, found = 0, None
    while exists(spark, f"{path}/{version}{number}/_SUCCESS"):
        found, number = f"{path}/{version}{number}", number + 1
    return found


def append_new(new: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys aren't stored yet: the first write of a key wins."""
    spark = new.sparkSession
    rows = keep_first(new, keys, *[F.asc(c) for c in new.columns])  # of two in one delivery the same one every time
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    rows.write.mode("append").parquet(path)


def overwrite_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that ``rows`` has rows of; all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def keep_last(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def retire(rows: DataFrame, retired: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to archive and rows to keep."""
    return rows.join(retired.select(*keys).distinct(), keys, "left_semi"), rows.join(retired.select(*keys).distinct(), keys, "left_anti")


def write_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def result_conflicts(results: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Results that contradict what is stored: to be refused, not written over."""
    old = stored.select(F.col(key).alias("_k"), *[F.col(f).alias(f"stored_{f}") for f in fields])
    differ = F.lit(False)
    for f in fields:
        differ = differ | (F.col(f) != F.col(f"stored_{f}"))
    return results.join(old, F.col(key) == F.col("_k")).filter(differ).drop("_k")


def record_results(results: DataFrame, stored: DataFrame, predictions: DataFrame, key: str, fields: list[str], actual: Column) -> DataFrame:
    """What recording a delivery of results does to each: recorded, unchanged, conflict or no_prediction, and whether the pick was right.

    ``stored`` holds the results recorded before, ``predictions`` (key, pick) what was said. A result that contradicts a stored one is refused;
    running a delivery again changes nothing.
    """
    old = stored.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    said = predictions.select(F.col(key).alias("_p"), F.col("pick").alias("_pick"))
    got = results.join(old, F.col(key) == F.col("_k"), "left").join(said, F.col(key) == F.col("_p"), "left")
    differ = F.lit(False)
    for f in fields:
        differ = differ | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    state = F.when(F.col("_k").isNotNull(), F.when(differ, "conflict").otherwise("unchanged")).when(F.col("_p").isNull(), "no_prediction").otherwise("recorded")
    return got.withColumn("state", state).withColumn("correct", F.when(F.col("state").isin("recorded", "unchanged"), F.col("_pick") == actual)).drop("_k", "_p", "_pick", *[f"_{f}" for f in fields])


def accepted_identities(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New mappings (provider, provider_team_id, canonical_id) with their state: added, known, or refused where the id stands for another team already or for two in the delivery."""
    keys = ["provider", "provider_team_id"]
    per = new.groupBy(*keys).agg(F.min("canonical_id").alias("canonical_id"), F.max("canonical_id").alias("_other"))
    old = stored.select(*keys, F.col("canonical_id").alias("_stored"))
    got = per.join(old, keys, "left")
    state = F.when(F.col("canonical_id") != F.col("_other"), "refused").when(F.col("_stored").isNull(), "added").when(F.col("_stored") == F.col("canonical_id"), "known").otherwise("refused")
    return got.select(*keys, F.coalesce("_stored", F.when(state == "added", F.col("canonical_id"))).alias("canonical_id"), state.alias("state"))


def save_run(metrics: DataFrame, path: str) -> None:
    """A run's metrics (run_id and more), in place of what was saved of the same runs."""
    overwrite_partitions(metrics, path, "run_id")


def dashboard(summary: DataFrame, title: str, most: int = 100) -> str:
    """A short summary table as Markdown; at most ``most`` rows, as it is a report."""
    rows = summary.limit(most).collect()
    head = f"# {title}\n\n| " + " | ".join(summary.columns) + " |\n|" + "---|" * len(summary.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"
