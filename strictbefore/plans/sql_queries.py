"""Queries written as SQL text over the session's registered functions: closed forms, the score grid as a table, the ordered fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strictbefore.functions import sql
from strictbefore.plans.catalog import ORACLE_SQL, query
from strictbefore.plans.matches import MATCHES_SQL, matches, played
from strictbefore.plans.model_queries import rated


@query("sql_scorelines", ORACLE_SQL["top_scorelines"])
def sql_scorelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most probable scores of every match: the grid as a lateral table, which is a generator and no join."""
    sql.register(spark)
    return spark.sql(
        """SELECT fixture_id, CAST(rank AS BIGINT) AS rank, home || '-' || away AS score, round(p, 6) AS p
        FROM (SELECT m.fixture_id, g.*, row_number() OVER (PARTITION BY m.fixture_id ORDER BY p DESC, home, away) AS rank FROM {rated} m, LATERAL score_grid(m.home_xg, m.away_xg) g)
        WHERE rank <= 5""",
        rated=rated(spark, sf_dir).select("fixture_id", "home_xg", "away_xg"),
    )


@query("sql_ratings", ORACLE_SQL["elo_ratings"].replace("fixture_id, o.league_id, o.season, home_id, away_id, round", "fixture_id, o.league_id, o.season, round"))
def sql_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elo ratings by a table function over partitions in order: a row at a time, with the teams' ratings as its only state."""
    sql.register(spark)
    return spark.sql(
        """SELECT fixture_id, league_id, season, round(home_rating, 4) AS home_rating, round(away_rating, 4) AS away_rating
        FROM ratings(TABLE(SELECT fixture_id, ts, CAST(league_id AS BIGINT) AS league_id, season, home_id, away_id, home_goals, away_goals FROM {finished}) PARTITION BY (league_id, season) ORDER BY (ts, fixture_id))""",
        finished=played(matches(spark, sf_dir)),
    )


@query(
    "sql_closed_forms",
    f"""WITH {MATCHES_SQL}, r AS (
      SELECT *, 1400e0 + 3 * home_id AS h, 1400e0 + 3 * away_id AS a, 0.05e0 + (fixture_id % 90) / 100e0 AS p, (epoch_us(kickoff_at) - epoch_us(odds_at)) / 3600000000 AS hours FROM played),
    e AS (SELECT *, least(greatest(0.28e0 * greatest(0e0, 1 - abs(h + 60 - a) / 400), 0.05e0), 0.28e0) AS d, 1 / (1 + pow(10e0, (a - h - 60) / 400)) AS w FROM r)
    SELECT fixture_id, round(pow(1.4e0, home_goals) * exp(-1.4e0) / factorial(home_goals::INT), 8) AS goals_p, round((1 - d) * w, 8) AS home_win, round(d, 8) AS draw, round(1 - d - (1 - d) * w, 8) AS away_win,
      round(1 / (1 + exp(-(1.2e0 * ln(p / (1 - p)) - 0.1e0))), 8) AS calibrated, CASE WHEN odds <= 1 THEN 'INVALID_ODDS' WHEN hours <= 0 THEN 'FUTURE' WHEN hours > 24 THEN 'STALE' ELSE 'AVAILABLE' END AS odds_state,
      round(1 / odds, 8) AS implied, round(p * odds - 1, 8) AS value, greatest(90 - fixture_id % 96, 1)::INT AS minutes, CASE WHEN home_goals > away_goals THEN 'home_win' WHEN home_goals < away_goals THEN 'away_win' ELSE 'draw' END AS said,
      round(1.2e0 * 0.9e0 * 1.5e0 * CASE WHEN fixture_id % 2 = 0 THEN 1.12e0 ELSE 0.88e0 END, 8) AS goals
    FROM e""",
)
def sql_closed_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    return spark.sql(
        """SELECT fixture_id, round(poisson_pmf(CAST(home_goals AS INT), 1.4D), 8) AS goals_p, round(elo_home_win(h, a), 8) AS home_win, round(elo_draw(h, a), 8) AS draw, round(elo_away_win(h, a), 8) AS away_win,
          round(platt_apply(p, 1.2D, -0.1D), 8) AS calibrated, odds_state(odds, odds_at, kickoff_at) AS odds_state, round(implied_probability(odds), 8) AS implied, round(expected_value(p, odds), 8) AS value,
          minutes_left(CAST(fixture_id % 96 AS INT), '2H') AS minutes, match_outcome(CAST(home_goals AS INT), CAST(away_goals AS INT)) AS said, round(expected_goals(1.2D, 0.9D, 1.5D, fixture_id % 2 = 0), 8) AS goals
        FROM (SELECT *, 1400D + 3 * home_id AS h, 1400D + 3 * away_id AS a, 0.05D + (fixture_id % 90) / 100D AS p FROM {finished})""",
        finished=played(matches(spark, sf_dir)),
    )
