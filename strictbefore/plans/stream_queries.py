"""The streaming operators over the stored events and matches: a batch run gives what a stream gives once its windows are closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strictbefore.operators import calibration, identity, isotonic, reconcile, similarity
from strictbefore.plans.catalog import query
from strictbefore.plans.matches import MATCHES_SQL, matches, played, table
from strictbefore.plans.model_queries import logged, outcome_samples
from strictbefore.streaming import live


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("daily_event_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def daily_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.windowed_counts(events(spark, sf_dir)).withColumn("total", F.round("total", 2))


@query(
    "sliding_event_windows",
    """SELECT s AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, unnest([date_trunc('hour', ts) - INTERVAL 1 HOUR * ((hour(ts) % 6) + 6 * k) FOR k IN [0, 1]]) AS s FROM events) GROUP BY ALL""",
)
def sliding_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.windowed_counts(events(spark, sf_dir), width="12 hours", slide="6 hours").withColumn("total", F.round("total", 2))


@query(
    "user_sessions",
    """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 8 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.sessions(events(spark, sf_dir), gap="8 hours")


@query("platt_fits")
def platt_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic per outcome over all samples."""
    return calibration.platt_fits(outcome_samples(spark, sf_dir))


@query("walk_forward_calibration")
def walk_forward_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every season's probabilities through fits on the league's earlier seasons."""
    rows = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(p).alias("p"), (F.col("actual") == o).alias("y")) for o, p in (("home_win", "p_home"), ("draw", "p_draw"), ("away_win", "p_away"))])
    samples = logged(spark, sf_dir).filter("actual is not null").select("fixture_id", "league_id", "season", F.explode(rows).alias("r")).select("fixture_id", "league_id", "season", "r.*")
    return calibration.walk_forward(samples, "season", "league_id")


@query("isotonic_fits")
def isotonic_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.isotonic_fits(outcome_samples(spark, sf_dir))


@query("isotonic_steps")
def isotonic_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic fits of each outcome on the samples as they are, from pools made side by side."""
    return isotonic.fits(outcome_samples(spark, sf_dir))


@query(
    "resolved_teams",
    """WITH r AS (SELECT s_suppkey, 'team ' || (s_suppkey % 40) AS norm, CASE s_suppkey % 5 WHEN 0 THEN 'provider_id' WHEN 1 THEN 'name' WHEN 2 THEN 'name' WHEN 3 THEN 'alias' END AS step, s_suppkey % 5 AS kind FROM supplier)
    SELECT s_suppkey, CASE WHEN kind = 0 AND s_suppkey % 40 >= 30 THEN NULL WHEN kind < 3 THEN 'football_team_' || (s_suppkey % 40) WHEN kind = 3 THEN 'football_team_' || (s_suppkey % 40) END AS canonical_id,
      CASE WHEN kind = 0 AND s_suppkey % 40 >= 30 THEN NULL WHEN kind = 4 THEN NULL ELSE step END AS step FROM r""",
)
def resolved_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in five spellings against identities made by rule; ids whose stored name disagrees fail closed."""
    n, kind = F.col("s_suppkey") % 40, F.col("s_suppkey") % 5
    name = F.when(kind.isin(0, 1), F.concat(F.lit("Team "), n)).when(kind == 2, F.concat(F.lit("TEAM_"), n, F.lit(" FC"))).when(kind == 3, F.concat(F.lit("Alias "), n)).otherwise(F.concat(F.lit("Nobody "), F.col("s_suppkey")))
    raw = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"), F.lit("p").alias("provider"), F.when(kind == 0, n).cast("string").alias("provider_team_id"), (n % 3).alias("league_id"))
    ids = spark.range(40).select(
        F.lit("p").alias("provider"), F.col("id").cast("string").alias("provider_team_id"), F.when(F.col("id") >= 30, F.concat(F.lit("other "), "id")).otherwise(F.concat(F.lit("team "), "id")).alias("normalized_name"),
        (F.col("id") % 3).alias("league_id"), F.concat(F.lit("football_team_"), "id").alias("canonical_id"),
    )
    named = spark.range(30, 40).select(F.lit("q").alias("provider"), F.concat(F.lit("q"), "id").alias("provider_team_id"), F.concat(F.lit("team "), "id").alias("normalized_name"), (F.col("id") % 3).alias("league_id"), F.concat(F.lit("football_team_"), "id").alias("canonical_id"))
    aliases = spark.range(40).select(F.concat(F.lit("alias "), "id").alias("alias"), F.concat(F.lit("football_team_"), "id").alias("canonical_id"))
    return identity.resolve(raw, ids.unionByName(named), aliases).select("s_suppkey", "canonical_id", "step")


def named_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers by nation with names to match.

    The tables' names differ in their number only, so towns are spelt from a digest of the whole key, fifteen customers to
    a supplier's town, with marks, accents and stems by key.
    """
    town = lambda k: F.translate(F.substring(F.md5(k.cast("long").cast("string").cast("binary")), 1, 8), "0123456789abcdef", "bdfgklmnprstvzao")
    ck, sk = F.col("c_custkey"), F.col("s_suppkey")
    home = town(F.floor(ck / 15))
    mine = F.when(ck % 4 == 0, F.concat(F.initcap(home), F.lit(" FC"))).when(ck % 4 == 1, F.upper(home)).when(ck % 4 == 2, F.concat(F.lit("AS "), home)).otherwise(F.concat(F.substring(home, 1, 5), F.lit("ine")))
    theirs = F.when(sk % 3 == 0, F.initcap(town(sk))).when(sk % 3 == 1, F.concat(town(sk), F.lit(" SC"))).otherwise(F.concat(F.lit("FK "), F.translate(town(sk), "ao", "áö")))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", mine.alias("c_name"))
    return customers, table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"), theirs.alias("s_name"))


@query("matched_names")
def matched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the one supplier of their nation whose name agrees best: the score with no SQL form, on distinct names that an equality brings together.

    Suppliers have no segment, so it can't be part of the key.
    """
    customers, suppliers = named_sides(spark, sf_dir)
    return reconcile.best_names(customers, suppliers, "c_nationkey", "c_name", "s_name")


@query("similar_names")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a nation's customer and supplier names of ratio 0.7 or more."""
    customers, suppliers = named_sides(spark, sf_dir)
    return similarity.similar(customers, suppliers, "c_name", "s_name", 0.7, ["c_nationkey"])


@query("finished_by_season", f"WITH {MATCHES_SQL} SELECT season, count(*) AS finished, max(kickoff_at) AS latest FROM played GROUP BY season")
def finished_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return played(matches(spark, sf_dir)).groupBy("season").agg(F.count("*").alias("finished"), F.max("kickoff_at").alias("latest"))
