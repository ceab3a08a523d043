"""Elo ratings as an ordered fold per cohort.

A rating depends on all earlier ones of its cohort, so no window expresses it: each cohort (a league, or a league's
season) is folded in one group in time order. Matches at one instant don't see each other: they are rated by the state
before the instant and applied one after the other, by fixture id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strictbefore.functions.model import HOME_RATING, K_FACTOR, START_RATING

SCHEMA = "fixture_id long, league_id long, season int, home_id long, away_id long, home_rating double, away_rating double"


def update(home: float, away: float, home_goals: int, away_goals: int) -> tuple[float, float]:
    """Ratings after a match: the margin weighs up to four goals."""
    expected = 1 / (1 + 10 ** ((away - (home + HOME_RATING)) / 400))
    result = 1.0 if home_goals > away_goals else 0.5 if home_goals == away_goals else 0.0
    change = K_FACTOR * (1 + 0.15 * min(abs(home_goals - away_goals), 4)) * (result - expected)
    return home + change, away - change


def fold(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["ts", "fixture_id"])
    teams, places = np.unique(np.concatenate([rows.home_id, rows.away_id]), return_inverse=True)
    home, away = places[: len(rows)].tolist(), places[len(rows) :].tolist()
    goals, starts = list(zip(rows.home_goals.tolist(), rows.away_goals.tolist(), strict=True)), rows.ts.to_numpy()
    state = [START_RATING] * len(teams)
    before: list[tuple[float, float]] = []
    at = 0
    while at < len(home):
        end = int(np.searchsorted(starts, starts[at], "right"))  # one past the instant
        before += [(state[home[i]], state[away[i]]) for i in range(at, end)]
        for i in range(at, end):
            state[home[i]], state[away[i]] = update(state[home[i]], state[away[i]], *goals[i])
        at = end
    out = rows[["fixture_id", "league_id", "season", "home_id", "away_id"]].copy()
    out[["home_rating", "away_rating"]] = pd.DataFrame(before, index=out.index, dtype="float64") if before else None
    return out


def ratings(found: DataFrame, *cohort: str) -> DataFrame:
    """Per played match: both teams' ratings as they stood strictly before it."""
    slim = found.select("fixture_id", "ts", "league_id", "season", "home_id", "away_id", "home_goals", "away_goals")
    return slim.groupBy(*cohort).applyInPandas(fold, SCHEMA)
