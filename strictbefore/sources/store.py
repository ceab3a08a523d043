"""Scans of the stored tables: fixtures, games, a team's last matches, enrichment by source, snapshots, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strictbefore.operators.documents import from_sources, not_duplicate
from strictbefore.operators.reconcile import keep_first

# Sources of statistics in the order in which they are believed.
PRIORITY = ("reconciled", "api_football", "football_data_org", "football_data_csv", "soccerdata")


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table in key ranges, read side by side."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def fixtures(stored: DataFrame, league_id: int, season: int, sources: list[str] | None = None, with_duplicates: bool = False) -> DataFrame:
    """A league-season's fixtures in time order; the filters reach the scan, so partitions by league and season are pruned."""
    rows = stored.filter((F.col("league_id") == league_id) & (F.col("season") == season))
    if not with_duplicates:
        rows = rows.filter(not_duplicate(F.col("raw_json")))
    if sources is not None:
        rows = rows.filter(from_sources(F.col("source"), F.col("raw_json"), sources))
    return rows.orderBy("kickoff_at", "fixture_id")


def games(stored: DataFrame, league_id: int, season: int, source: str | None = None) -> DataFrame:
    rows = stored.filter((F.col("league_id") == league_id) & (F.col("season") == season))
    return (rows.filter(F.col("source") == source) if source else rows).orderBy("game_at", "game_id")


def last_of_team(stored: DataFrame, team: str, cutoff, limit: int, league_id: int | None = None) -> DataFrame:
    """A team's last matches strictly before a cutoff, oldest first."""
    rows = stored.filter(((F.col("canonical_home_id") == team) | (F.col("canonical_away_id") == team)) & (F.col("kickoff_at") < F.lit(cutoff)))
    if league_id is not None:
        rows = rows.filter(F.col("league_id") == league_id)
    return rows.orderBy(F.desc("kickoff_at"), F.desc("fixture_id")).limit(limit).orderBy("kickoff_at", "fixture_id")


def enrichment(stored: DataFrame, wanted: DataFrame, source: str | None = None) -> DataFrame:
    """Statistics of the wanted fixture ids, from the most believed source that has them."""
    rows = stored.join(wanted.select("fixture_id").distinct(), "fixture_id", "left_semi")
    if source:
        return rows.filter(F.col("source") == source)
    place = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("source"))
    return keep_first(rows.withColumn("_place", F.when(place > 0, place).otherwise(len(PRIORITY) + 1)), ["fixture_id"], F.asc("_place"), F.asc("source")).drop("_place")


def snapshots(stored: DataFrame, limit: int, sport: str | None = None, fixture_id: int | None = None) -> DataFrame:
    """The latest prediction snapshots."""
    rows = stored.filter(F.col("sport") == sport) if sport else stored
    rows = rows.filter(F.col("fixture_id") == fixture_id) if fixture_id is not None else rows
    return rows.orderBy(F.desc("prediction_at"), F.desc("id")).limit(limit)


def manifest(stored: DataFrame, expected: DataFrame, *cohort: str) -> DataFrame:
    """Per cohort: stored and expected fixtures, and whether the dataset is complete."""
    counts = stored.groupBy(*cohort).agg(F.count_distinct("fixture_id").alias("stored"), F.max("kickoff_at").alias("latest"))
    got = expected.join(counts, list(cohort), "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    return got.withColumn("status", F.when(F.col("expected").isNull(), "UNVERIFIABLE").when(F.col("stored") >= F.col("expected"), "COMPLETE").otherwise("INCOMPLETE"))
