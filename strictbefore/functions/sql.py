"""The engine's closed forms and folds as functions that SQL text can call.

``register(spark)`` makes them temporary functions of the session. The scalar ones and ``score_grid`` are SQL expressions, inlined and optimised
with the query that calls them. ``ratings`` is a table function in Python, for what no expression says: an ordered fold over the rows of a
partition, read one at a time, with one number a team in memory. ``power_terms`` is an Arrow function: the C library's powers, which the SQL has too.

    SELECT m.fixture_id, g.home, g.away, g.p FROM matches m, LATERAL score_grid(m.home_xg, m.away_xg) g
    SELECT * FROM ratings(TABLE(finished) PARTITION BY league_id, season ORDER BY ts, fixture_id)

A null argument gives a null, or a table without rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udf, udtf

from strictbefore.functions.decision import MAX_ODDS_HOURS
from strictbefore.functions.model import AWAY_FACTOR, HOME_FACTOR, HOME_RATING, MARGIN_SD, MAX_GOALS, RHO, START_RATING, power_terms

SCALARS = {
    "poisson_pmf(k INT, mean DOUBLE)": ("DOUBLE", "CASE WHEN k < 0 OR mean < 0 THEN 0D WHEN k = 0 THEN exp(-mean) ELSE exp(k * ln(mean) - mean - aggregate(sequence(1, k), 0D, (s, i) -> s + ln(i))) END"),
    "expected_goals(attack DOUBLE, defence DOUBLE, league_avg DOUBLE, at_home BOOLEAN)": ("DOUBLE", f"attack * defence * league_avg * IF(at_home, {HOME_FACTOR}D, {AWAY_FACTOR}D)"),
    "low_score_factor(x INT, y INT, home_xg DOUBLE, away_xg DOUBLE)": (
        "DOUBLE",
        f"CASE WHEN x = 0 AND y = 0 THEN 1 - home_xg * away_xg * ({RHO}D) WHEN x = 0 AND y = 1 THEN 1 + home_xg * ({RHO}D) WHEN x = 1 AND y = 0 THEN 1 + away_xg * ({RHO}D) WHEN x = 1 AND y = 1 THEN 1 - ({RHO}D) ELSE 1D END",
    ),
    "elo_expected(own DOUBLE, other DOUBLE)": ("DOUBLE", "1 / (1 + pow(10D, (other - own) / 400))"),
    "elo_draw(home DOUBLE, away DOUBLE)": ("DOUBLE", f"least(greatest(0.28D * greatest(0D, 1 - abs(home + {HOME_RATING}D - away) / 400), 0.05D), 0.28D)"),
    "elo_home_win(home DOUBLE, away DOUBLE)": ("DOUBLE", f"(1 - elo_draw(home, away)) * elo_expected(home + {HOME_RATING}D, away)"),
    "elo_away_win(home DOUBLE, away DOUBLE)": ("DOUBLE", "1 - elo_draw(home, away) - elo_home_win(home, away)"),
    "platt_apply(p DOUBLE, a DOUBLE, b DOUBLE)": ("DOUBLE", "1 / (1 + exp(-(a * ln(least(greatest(p, 1e-6D), 1 - 1e-6D) / (1 - least(greatest(p, 1e-6D), 1 - 1e-6D))) + b)))"),
    "odds_state(odds DOUBLE, odds_at TIMESTAMP, cutoff TIMESTAMP)": (
        "STRING",
        f"""CASE WHEN odds IS NULL THEN 'MISSING' WHEN isnan(odds) OR odds = double('infinity') OR odds <= 1 THEN 'INVALID_ODDS' WHEN odds_at IS NULL OR cutoff IS NULL THEN 'MISSING' WHEN odds_at >= cutoff THEN 'FUTURE'
        WHEN unix_micros(cutoff) - unix_micros(odds_at) > {MAX_ODDS_HOURS} * 3600000000L THEN 'STALE' ELSE 'AVAILABLE' END""",
    ),
    "implied_probability(odds DOUBLE)": ("DOUBLE", "CASE WHEN odds > 1 AND odds < double('infinity') THEN 1 / odds END"),
    "expected_value(p DOUBLE, odds DOUBLE)": ("DOUBLE", "CASE WHEN p BETWEEN 0 AND 1 AND odds > 1 AND odds < double('infinity') THEN p * odds - 1 END"),
    "minutes_left(elapsed INT, status STRING)": ("INT", "CASE WHEN status = 'HT' THEN 45 WHEN elapsed IS NULL THEN 90 ELSE greatest(90 - elapsed, 1) END"),
    "match_outcome(home INT, away INT)": ("STRING", "CASE WHEN home > away THEN 'home_win' WHEN home < away THEN 'away_win' WHEN home = away THEN 'draw' END"),
    "margin_win(margin DOUBLE)": ("DOUBLE", None),
}

#: The score grid's cells as an array, summing to one: the C library's powers bound once, cells made once, their sum bound once, then divided; in the order that ``model.scorelines`` has.
CELLS = f"""
    transform(array(transform(array(struct(power_terms(home_xg) AS h, power_terms(away_xg) AS a)), t -> flatten(transform(sequence(0, {MAX_GOALS}), x -> transform(sequence(0, {MAX_GOALS}), y -> named_struct('home', x, 'away', y, 'p',
        t.h[x] * t.h[{MAX_GOALS + 1}] / factorial(x) * t.a[y] * t.a[{MAX_GOALS + 1}] / factorial(y)
        * CASE WHEN x = 0 AND y = 0 THEN 1 - ({RHO}D) * home_xg * away_xg WHEN x = 0 AND y = 1 THEN 1 + home_xg * ({RHO}D) WHEN x = 1 AND y = 0 THEN 1 + away_xg * ({RHO}D) WHEN x = 1 AND y = 1 THEN 1 - ({RHO}D) ELSE 1D END)))))[0]),
      cells -> transform(array(aggregate(cells, 0D, (s, c) -> s + c.p)), whole -> transform(cells, c -> named_struct('home', c.home, 'away', c.away, 'p', c.p / whole)))[0])[0]"""
CELLS = f"IF(home_xg IS NULL OR away_xg IS NULL, NULL, {CELLS})"
SCALARS["score_cells(home_xg DOUBLE, away_xg DOUBLE)"] = ("ARRAY<STRUCT<home: INT, away: INT, p: DOUBLE>>", CELLS)


class RatingsOf:
    """Both teams' Elo ratings before each match of a partition that is in order; matches of one instant don't see each other."""

    def __init__(self) -> None:
        self.state: dict[int, float] = {}
        self.before: dict[int, float] = {}
        self.instant = None

    def eval(self, row: Row) -> Iterator[tuple]:
        from strictbefore.operators.elo import update

        if row["ts"] != self.instant:
            self.instant, self.before = row["ts"], {}
        home, away = row["home_id"], row["away_id"]
        now = self.state.get(home, START_RATING), self.state.get(away, START_RATING)
        for team, rating in zip((home, away), now, strict=True):
            self.before.setdefault(team, rating)
        self.state[home], self.state[away] = update(*now, row["home_goals"], row["away_goals"])
        yield row["fixture_id"], row["league_id"], row["season"], self.before[home], self.before[away]


def erf_sql(x: str) -> str:
    """The error function's series of positive terms; beyond six it is one to a double's last place."""
    term = f"named_struct('term', a.term * (2 * ({x}) * ({x}) / (2 * n + 1)), 'sum', a.sum + a.term * (2 * ({x}) * ({x}) / (2 * n + 1)))"
    return f"CASE WHEN abs({x}) > 6 THEN sign({x}) ELSE 2 / sqrt(pi()) * exp(-({x}) * ({x})) * aggregate(sequence(1, 120), named_struct('term', {x}, 'sum', {x}), (a, n) -> {term}, a -> a.sum) END"


def powers_of(means: pa.Array) -> pa.Array:
    """``power_terms`` as an array a row."""
    terms = power_terms(means)
    return pa.ListArray.from_arrays(pa.array(range(0, terms.size + 1, terms.shape[1]), pa.int32()), pa.array(terms.ravel()))


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; again does no harm. Their names."""
    names = ["power_terms"]
    spark.udf.register("power_terms", arrow_udf(powers_of, "array<double>"))
    for head, (kind, body) in SCALARS.items():
        if body is None:
            body = f"0.5D * (1 + {erf_sql(f'(margin / {MARGIN_SD}D / sqrt(2D))')})"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
        names.append(head.split("(")[0])
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION score_grid(home_xg DOUBLE, away_xg DOUBLE) RETURNS TABLE (home INT, away INT, p DOUBLE) RETURN SELECT inline({CELLS.replace('home_xg', 'score_grid.home_xg').replace('away_xg', 'score_grid.away_xg')})")
    spark.udtf.register("ratings", udtf(RatingsOf, returnType="fixture_id long, league_id long, season int, home_rating double, away_rating double"))
    return [*names, "score_grid", "ratings"]
