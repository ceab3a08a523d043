"""Which matches count and what their scores mean, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status codes by meaning.
FINISHED = {"football": ("FT", "AET", "PEN"), "basketball": ("FT", "AOT")}
LIVE = {"football": ("1H", "2H", "HT", "ET", "BT", "P", "SUSP", "INT"), "basketball": ("Q1", "Q2", "Q3", "Q4", "OT", "HT", "BT")}
CALLED_OFF = {"football": ("PST", "CANC", "ABD", "AWD", "WO"), "basketball": ("PST", "CANC", "ABD")}


def is_finished(status: Column, sport: str = "football") -> Column:
    return F.coalesce(status.isin(*FINISHED[sport]), F.lit(False))


def is_live(status: Column, sport: str = "football") -> Column:
    return F.coalesce(status.isin(*LIVE[sport]), F.lit(False))


def is_called_off(status: Column, sport: str = "football") -> Column:
    return F.coalesce(status.isin(*CALLED_OFF[sport]), F.lit(False))


def strict_int(text: Column) -> Column:
    """An integer written as such, a sign and outer blanks allowed; null for anything else."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long"))


def goals(home: Column, away: Column) -> Column:
    """struct<home, away>, or null unless both are non-negative."""
    return F.when((home >= 0) & (away >= 0), F.struct(home.alias("home"), away.alias("away")))


def regulation(status: Column, home: Column, away: Column, full_home: Column, full_away: Column) -> Column:
    """Goals after 90 minutes: the full-time score; the goals stand in for it unless extra time was played."""
    return F.coalesce(goals(full_home, full_away), F.when(~F.coalesce(status.isin("AET", "PEN"), F.lit(False)), goals(home, away)))


def score_breakdown(status: Column, home: Column, away: Column, full_home: Column, full_away: Column) -> Column:
    """struct<match, regulation, later>, each struct<home, away> or null: all goals, those of 90 minutes, and what extra time added."""
    whole, regular = goals(home, away), regulation(status, home, away, full_home, full_away)
    later = F.when(whole.isNotNull() & regular.isNotNull(), F.struct((whole["home"] - regular["home"]).alias("home"), (whole["away"] - regular["away"]).alias("away")))
    return F.struct(whole.alias("match"), regular.alias("regulation"), later.alias("later"))


def outcome(home: Column, away: Column) -> Column:
    """home_win, draw or away_win; null where a score is missing."""
    return F.when(home > away, "home_win").when(home < away, "away_win").when(home == away, "draw")


def unknown(value: Column) -> Column:
    """Whether a text says nothing."""
    return value.isNull() | F.lower(F.trim(value)).isin("", "unknown", "unclassified", "null", "none")


def predates_xg(season: Column, day: Column) -> Column:
    """Whether a match was played before expected goals were recorded: by season, by date where that is unknown."""
    return F.when(season.isNotNull(), season < 2020).otherwise(day < F.lit("2020-09-01").cast("date"))


def reject_reason(row: dict[str, Column], league: Column, season: Column, cutoff: Column, require_completed: bool = True) -> Column:
    """Why a fixture isn't taken in, the first reason that holds; null for one that is."""
    completed = is_finished(row["status_short"])
    invalid = lambda g: F.coalesce(g < 0, F.lit(False))
    nameless = lambda side: (F.coalesce(F.trim(row[f"{side}_team"]), F.lit("")) == "") if f"{side}_team" in row else F.lit(False)
    no_id = lambda name: row[name].isNull() | (row[name] <= 0)
    checks = [
        (no_id("fixture_id"), "missing_invalid_or_non_positive_fixture_id"),
        (row["kickoff_at"].isNull(), "missing_kickoff_timestamp"),
        (~(row["kickoff_at"] < cutoff), "kickoff_not_before_cutoff"),
        (no_id("home_id"), "missing_invalid_or_non_positive_home_team_id"),
        (no_id("away_id"), "missing_invalid_or_non_positive_away_team_id"),
        (row["home_id"] == row["away_id"], "identical_home_and_away_team_ids"),
        (nameless("home"), "missing_or_empty_home_team_name"),
        (nameless("away"), "missing_or_empty_away_team_name"),
        (row["league_id"] != league, "conflicting_league_id"),
        (row["season"] != season, "conflicting_season"),
        (~completed if require_completed else F.lit(False), "fixture_not_completed"),
        (invalid(row["home_goals"]), "invalid_or_negative_home_goals"),
        (invalid(row["away_goals"]), "invalid_or_negative_away_goals"),
        (completed & (row["home_goals"].isNull() | row["away_goals"].isNull()), "completed_fixture_missing_goals"),
    ]
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(reason)) for bad, reason in checks])


def excluded_stage(stages: list[Column], home: Column, away: Column, marker: str, tokens: tuple[str, ...] = ()) -> Column:
    """Whether a match belongs to a stage outside the regular season: a stage text holds the marker or is held by it, or a side's name holds a token."""
    found = F.lit(False)
    for stage in stages:
        low = F.lower(F.trim(stage))
        found = found | F.coalesce((low != "") & (low.contains(marker) | F.lit(marker).contains(low)), F.lit(False))
    for token in tokens:
        for name in (home, away):
            found = found | F.coalesce(F.lower(F.trim(name)).contains(token), F.lit(False))
    return found


def keeps_league(name: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a league's name holds one of the keywords, in any case."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.greatest(*[low.contains(k.lower()) for k in (*keywords, keywords[0])])


def names_match(home: Column, away: Column, first: str, second: str) -> Column:
    """A search for two teams by parts of their names, in either order."""
    like = lambda c, part: F.lower(c).contains(part.lower())
    return (like(home, first) & like(away, second)) | (like(home, second) & like(away, first))


def gradeable(home: Column, away: Column) -> Column:
    """Whether a match can be settled: both goals are there and valid."""
    return F.coalesce(goals(home, away).isNotNull(), F.lit(False))
