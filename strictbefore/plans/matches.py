"""Match tables over the driver's tables: a fixed rule reads orders as fixtures and their line items as goals.

| column | rule |
|---|---|
| fixture_id, kickoff_at, season | order key, order date, its year |
| home_id | customer key modulo 100; its league is home_id div 20 |
| away_id | another of the league's 20 teams, by order key |
| home_goals, away_goals | line items of odd and even number; null without line items |
| status_short | F: FT, O: AET, P: NS |
| reg_home, reg_away | FT: goals; AET: both the lesser of the two |
| odds, odds_at | 1.01 + (order key % 400) / 100; order key % 48 hours before kickoff |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same view for DuckDB; queries put ``WITH`` before it.
MATCHES_SQL = """
g AS (
  SELECT l_orderkey, count(*) FILTER (l_linenumber % 2 = 1) AS hg, count(*) FILTER (l_linenumber % 2 = 0) AS ag FROM lineitem GROUP BY l_orderkey),
matches AS (
  SELECT o_orderkey AS fixture_id, o_orderdate AS kickoff_at, epoch_us(o_orderdate) AS ts, year(o_orderdate)::INT AS season,
    (o_custkey % 100) // 20 AS league_id, o_custkey % 100 AS home_id,
    ((o_custkey % 100) // 20) * 20 + ((o_custkey % 100) % 20 + 1 + o_orderkey % 19) % 20 AS away_id,
    hg AS home_goals, ag AS away_goals, CASE o_orderstatus WHEN 'F' THEN 'FT' WHEN 'O' THEN 'AET' ELSE 'NS' END AS status_short,
    CASE o_orderstatus WHEN 'F' THEN hg WHEN 'O' THEN least(hg, ag) END AS reg_home,
    CASE o_orderstatus WHEN 'F' THEN ag WHEN 'O' THEN least(hg, ag) END AS reg_away,
    1.01e0 + (o_orderkey % 400) / 100e0 AS odds, o_orderdate - INTERVAL (o_orderkey % 48) HOUR AS odds_at
  FROM orders LEFT JOIN g ON l_orderkey = o_orderkey),
played AS (
  SELECT * FROM matches WHERE status_short IN ('FT', 'AET', 'PEN') AND home_goals IS NOT NULL AND away_goals IS NOT NULL),
team_rows AS (
  SELECT fixture_id, ts, season, league_id, home_id AS team_id, away_id AS opponent_id, true AS at_home, home_goals AS gf, away_goals AS ga FROM played
  UNION ALL
  SELECT fixture_id, ts, season, league_id, away_id, home_id, false, away_goals, home_goals FROM played)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per fixture. Line items are counted before the join, so it moves one row per order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.when(F.col("l_linenumber") % 2 == 1, 1)).alias("hg"), F.count(F.when(F.col("l_linenumber") % 2 == 0, 1)).alias("ag")
    )
    home = F.col("o_custkey") % 100
    league = F.expr("(o_custkey % 100) div 20")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("kickoff_at"))
    status = F.when(F.col("o_orderstatus") == "F", "FT").when(F.col("o_orderstatus") == "O", "AET").otherwise("NS")
    regulation = lambda own: F.when(F.col("o_orderstatus") == "F", F.col(own)).when(F.col("o_orderstatus") == "O", F.least("hg", "ag"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("fixture_id"),
        "kickoff_at",
        F.unix_micros("kickoff_at").alias("ts"),
        F.year("kickoff_at").alias("season"),
        league.alias("league_id"),
        home.alias("home_id"),
        (league * 20 + (home % 20 + 1 + F.col("o_orderkey") % 19) % 20).alias("away_id"),
        F.col("hg").alias("home_goals"),
        F.col("ag").alias("away_goals"),
        status.alias("status_short"),
        regulation("hg").alias("reg_home"),
        regulation("ag").alias("reg_away"),
        (F.lit(1.01) + (F.col("o_orderkey") % 400) / 100).alias("odds"),
        F.timestamp_micros(F.unix_micros("kickoff_at") - (F.col("o_orderkey") % 48) * 3_600_000_000).alias("odds_at"),
    )


def played(found: DataFrame) -> DataFrame:
    """Finished fixtures with both goals."""
    return found.filter(F.col("status_short").isin("FT", "AET", "PEN") & (F.col("home_goals") >= 0) & (F.col("away_goals") >= 0))


def team_rows(found: DataFrame) -> DataFrame:
    """Each played fixture from both teams' view, without reading it twice."""
    side = lambda team, other, home, gf, ga: F.struct(F.col(team).alias("team_id"), F.col(other).alias("opponent_id"), F.lit(home).alias("at_home"), F.col(gf).alias("gf"), F.col(ga).alias("ga"))
    sides = F.array(side("home_id", "away_id", True, "home_goals", "away_goals"), side("away_id", "home_id", False, "away_goals", "home_goals"))
    return played(found).select("fixture_id", "ts", "season", "league_id", F.explode(sides).alias("s")).select("fixture_id", "ts", "season", "league_id", "s.*")
