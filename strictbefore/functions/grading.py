"""What came true: every market settled against a score, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strictbefore.functions.policy import outcome

# Lines of the markets.
TOTAL_LINES, TEAM_LINES = (1.5, 2.5, 3.5, 4.5, 5.5), (0.5, 1.5, 2.5)
CORNER_LINES, CARD_LINES = (7.5, 8.5, 9.5, 10.5), (2.5, 3.5, 4.5, 5.5)


def name_of(prefix: str, line: float) -> str:
    return f"{prefix}_{line}".replace(".", "_")


def result_markets(home: Column, away: Column) -> dict[str, Column]:
    """1X2 and double chance, on goals after 90 minutes."""
    said = outcome(home, away)
    return {"result": said, "home_or_draw": said.isin("home_win", "draw"), "away_or_draw": said.isin("away_win", "draw"), "home_or_away": said.isin("home_win", "away_win")}


def goal_markets(home: Column, away: Column) -> dict[str, Column]:
    """Totals, both to score, team goals and the score, on match goals without a shoot-out."""
    out = {name_of("over", line): home + away > line for line in TOTAL_LINES}
    out |= {"btts": (home > 0) & (away > 0)}
    out |= {name_of(side, line): own > line for side, own in (("home_over", home), ("away_over", away)) for line in TEAM_LINES}
    return out | {"score": F.concat_ws("-", home.cast("string"), away.cast("string"))}


def total_against_line(total: Column, line: Column) -> Column:
    return F.when(total > line, "over").when(total < line, "under").when(total == line, "push")


def statistic(stats: Column, side: Column, labels: tuple[str, ...]) -> Column:
    """The first figure under one of the labels among array<struct<team_id, type, value>>; null if it is missing or negative."""
    mine = F.filter(stats, lambda s: (s["team_id"] == side) & F.lower(F.trim(s["type"])).isin(*labels))
    value = F.get(mine, F.lit(0))["value"]
    return F.when(value >= 0, value)


def statistical_markets(stats: Column, home: Column, away: Column) -> dict[str, Column]:
    """Corners and cards over their lines; null where a side's figure is missing."""
    corners = statistic(stats, home, ("corner kicks", "corners")) + statistic(stats, away, ("corner kicks", "corners"))
    yellow = statistic(stats, home, ("yellow cards",)) + statistic(stats, away, ("yellow cards",))
    red = statistic(stats, home, ("red cards",)) + statistic(stats, away, ("red cards",))
    return {name_of("corners_over", x): corners > x for x in CORNER_LINES} | {name_of("cards_over", x): yellow + red > x for x in CARD_LINES}


def actual_double_chance(home: Column, away: Column) -> Column:
    """The double chance that came true, the home side's first."""
    return F.when(home >= away, "home_or_draw").when(away > home, "away_or_draw")


def pick_alias(text: Column) -> Column:
    """A stored pick under its canonical name; other labels in snake case."""
    plain = F.lower(F.trim(text))
    known = F.when(plain.isin("home_win", "home win", "home", "h"), "home_win").when(plain.isin("draw", "tie", "x"), "draw").when(plain.isin("away_win", "away win", "away", "a"), "away_win")
    return F.coalesce(known, F.translate(plain, "- ", "__"))
