"""Point-in-time feature queries over the match view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strictbefore.operators import elo, features, metrics
from strictbefore.plans.catalog import query
from strictbefore.plans.matches import MATCHES_SQL, matches, played, team_rows

COHORT = ("league_id", "season")


@query(
    "pit_team_averages",
    f"""WITH {MATCHES_SQL}
    SELECT fixture_id, team_id, count(*) OVER w AS prior_matches, round(avg(gf) OVER w, 6) AS avg_for, round(avg(ga) OVER w, 6) AS avg_against
    FROM team_rows WINDOW w AS (PARTITION BY league_id, season, team_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def pit_team_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every match: both teams' averages over all strictly earlier matches of the season."""
    got = features.team_averages(team_rows(matches(spark, sf_dir)), *COHORT)
    return got.select("fixture_id", "team_id", "prior_matches", F.round("avg_for", 6).alias("avg_for"), F.round("avg_against", 6).alias("avg_against"))


@query(
    "pit_league_average",
    f"""WITH {MATCHES_SQL}
    SELECT fixture_id, league_id, season, count(*) OVER w AS prior_matches, round(sum(home_goals + away_goals) OVER w / (2.0 * count(*) OVER w), 6) AS league_avg
    FROM played WINDOW w AS (PARTITION BY league_id, season ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def pit_league_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features.league_average(played(matches(spark, sf_dir)), *COHORT)
    return got.withColumn("league_avg", F.round("league_avg", 6))


LAST_SQL = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts, fixture_id) AS rn,
         count(*) OVER (PARTITION BY {keys} ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM {rows})
"""


@query(
    "recent_form",
    f"""WITH {MATCHES_SQL}, {LAST_SQL.format(keys="league_id, season, team_id", rows="team_rows")}
    SELECT a.fixture_id, a.league_id, a.season, a.team_id, count(b.rn) AS matches, count(*) FILTER (b.gf > b.ga) AS wins, count(*) FILTER (b.gf = b.ga) AS draws,
      count(*) FILTER (b.gf < b.ga) AS losses, coalesce(sum(b.gf), 0)::BIGINT AS goals_for, coalesce(sum(b.ga), 0)::BIGINT AS goals_against,
      coalesce(string_agg(CASE WHEN b.gf > b.ga THEN 'W' WHEN b.gf = b.ga THEN 'D' ELSE 'L' END, '' ORDER BY b.rn) FILTER (b.rn IS NOT NULL), '') AS sequence,
      3 * count(*) FILTER (b.gf > b.ga) + count(*) FILTER (b.gf = b.ga) AS points,
      round((3 * count(*) FILTER (b.gf > b.ga) + count(*) FILTER (b.gf = b.ga)) / nullif(count(b.rn), 0), 6) AS points_per_match
    FROM ranked a LEFT JOIN ranked b ON a.league_id = b.league_id AND a.season = b.season AND a.team_id = b.team_id AND b.rn BETWEEN a.k - 7 AND a.k
    GROUP BY a.fixture_id, a.league_id, a.season, a.team_id""",
)
def recent_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features.recent_form(team_rows(matches(spark, sf_dir)), *COHORT)
    return got.withColumn("points_per_match", F.round("points_per_match", 6))


@query(
    "head_to_head",
    f"""WITH {MATCHES_SQL}, pairs AS (SELECT *, least(home_id, away_id) AS low, greatest(home_id, away_id) AS high FROM played), {LAST_SQL.format(keys="low, high", rows="pairs")},
    m AS (
      SELECT a.fixture_id, b.rn, b.home_goals AS hg, b.away_goals AS ag, CASE WHEN a.home_id = b.home_id THEN b.home_goals ELSE b.away_goals END AS own,
             CASE WHEN a.home_id = b.home_id THEN b.away_goals ELSE b.home_goals END AS other
      FROM ranked a LEFT JOIN ranked b ON a.low = b.low AND a.high = b.high AND b.rn BETWEEN a.k - 5 AND a.k)
    SELECT fixture_id, count(rn) AS meetings, count(*) FILTER (own > other) AS home_wins, count(*) FILTER (own = other) AS draws, count(*) FILTER (own < other) AS away_wins,
      round(avg(own), 6) AS avg_for, round(avg(other), 6) AS avg_against,
      round(count(*) FILTER (hg > 0 AND ag > 0) / nullif(count(rn), 0), 6) AS btts_rate, round(count(*) FILTER (hg + ag > 1.5) / nullif(count(rn), 0), 6) AS over_1_5,
      round(count(*) FILTER (hg + ag > 2.5) / nullif(count(rn), 0), 6) AS over_2_5, round(count(*) FILTER (hg + ag > 3.5) / nullif(count(rn), 0), 6) AS over_3_5
    FROM m GROUP BY fixture_id""",
)
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features.head_to_head(played(matches(spark, sf_dir)))
    return got.select("fixture_id", "meetings", "home_wins", "draws", "away_wins", *[F.round(c, 6).alias(c) for c in ("avg_for", "avg_against", "btts_rate", "over_1_5", "over_2_5", "over_3_5")])


@query(
    "minimum_history",
    f"""WITH {MATCHES_SQL}, n AS (
      SELECT fixture_id, team_id, count(*) OVER (PARTITION BY league_id, season, team_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM team_rows)
    SELECT p.fixture_id, h.n AS home_prior_matches, a.n AS away_prior_matches, h.n >= 5 AND a.n >= 5 AS eligible
    FROM played p JOIN n h ON h.fixture_id = p.fixture_id AND h.team_id = home_id JOIN n a ON a.fixture_id = p.fixture_id AND a.team_id = away_id""",
)
def minimum_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(spark, sf_dir)
    per = features.team_averages(team_rows(found), *COHORT)
    got = features.both_sides(played(found), per, ["prior_matches"])
    return got.select("fixture_id", "home_prior_matches", "away_prior_matches", features.has_history(F.col("home_prior_matches"), F.col("away_prior_matches"), 5).alias("eligible"))


@query(
    "elo_ratings",
    f"""WITH RECURSIVE {MATCHES_SQL}, o AS (
      SELECT *, row_number() OVER (PARTITION BY league_id, season ORDER BY ts, fixture_id) AS rn,
             count(*) OVER (PARTITION BY league_id, season ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM played),
    r AS (
      SELECT league_id, season, 0::BIGINT AS rn, MAP([(-1)::BIGINT], [0e0]) AS state FROM (SELECT DISTINCT league_id, season FROM o)
      UNION ALL
      SELECT league_id, season, rn, map_concat(state, MAP([home_id, away_id], [h + d, a - d])) FROM (
        SELECT *, 20e0 * (1 + 0.15e0 * least(abs(home_goals - away_goals), 4)) * (CASE WHEN home_goals > away_goals THEN 1e0 WHEN home_goals = away_goals THEN 0.5e0 ELSE 0e0 END - 1 / (1 + pow(10e0, (a - (h + 60)) / 400))) AS d
        FROM (
          SELECT r.league_id, r.season, o.rn, state, home_id::BIGINT AS home_id, away_id::BIGINT AS away_id, home_goals, away_goals,
                 coalesce(state[home_id::BIGINT], 1500e0) AS h, coalesce(state[away_id::BIGINT], 1500e0) AS a
          FROM r JOIN o ON o.league_id = r.league_id AND o.season = r.season AND o.rn = r.rn + 1)))
    SELECT fixture_id, o.league_id, o.season, home_id, away_id, round(coalesce(state[home_id::BIGINT], 1500e0), 4) AS home_rating, round(coalesce(state[away_id::BIGINT], 1500e0), 4) AS away_rating
    FROM o JOIN r ON r.league_id = o.league_id AND r.season = o.season AND r.rn = o.seen""",
)
def elo_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = elo.ratings(played(matches(spark, sf_dir)), *COHORT)
    return got.withColumn("home_rating", F.round("home_rating", 4)).withColumn("away_rating", F.round("away_rating", 4))


OUTCOMES = ["home_win", "draw", "away_win"]


@query(
    "prior_outcome_frequencies",
    f"""WITH {MATCHES_SQL}, r AS (
      SELECT fixture_id, league_id, season, ts, CASE WHEN home_goals > away_goals THEN 'home_win' WHEN home_goals < away_goals THEN 'away_win' ELSE 'draw' END AS said FROM played)
    SELECT fixture_id, round(coalesce(count(*) FILTER (said = 'home_win') OVER w / nullif(count(*) OVER w, 0), 1/3e0), 6) AS prior_home_win,
      round(coalesce(count(*) FILTER (said = 'draw') OVER w / nullif(count(*) OVER w, 0), 1/3e0), 6) AS prior_draw,
      round(coalesce(count(*) FILTER (said = 'away_win') OVER w / nullif(count(*) OVER w, 0), 1/3e0), 6) AS prior_away_win
    FROM r WINDOW w AS (PARTITION BY league_id, season ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def prior_outcome_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = played(matches(spark, sf_dir)).withColumn("said", F.expr("CASE WHEN home_goals > away_goals THEN 'home_win' WHEN home_goals < away_goals THEN 'away_win' ELSE 'draw' END"))
    got = metrics.prior_frequencies(rows, "said", OUTCOMES, *COHORT)
    return got.select("fixture_id", *[F.round(f"prior_{o}", 6).alias(f"prior_{o}") for o in OUTCOMES])
