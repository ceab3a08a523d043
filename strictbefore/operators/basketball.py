"""Basketball games: points, ingestion rules, phases, manifests and the persisted dataset's verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strictbefore.functions.policy import goals, is_finished, strict_int
from strictbefore.functions.time import parse_utc

# Phases in the order of a season, those that count, and a league's teams and games.
PHASES = ("preseason", "regular_season", "play_in", "postseason", "all_star")
COUNTED = ("regular_season", "play_in", "postseason")


def points(home: Column, away: Column) -> Column:
    """struct<home, away>, or null unless both are non-negative."""
    return goals(home, away)


def reject_reason(row: dict[str, Column], league: Column, season: Column, cutoff: Column) -> Column:
    """Why a game isn't taken in, the first reason that holds; null for one that is. A game has a winner."""
    done = is_finished(row["status_short"], "basketball")
    no_id = lambda c: row[c].isNull() | (row[c] <= 0)
    bad = lambda c: F.coalesce(row[c] < 0, F.lit(False))
    checks = [
        (no_id("game_id"), "missing_invalid_or_non_positive_game_id"),
        (row["game_at"].isNull(), "missing_game_timestamp"),
        (~(row["game_at"] < cutoff), "game_not_before_cutoff"),
        (no_id("home_id"), "missing_invalid_or_non_positive_home_team_id"),
        (no_id("away_id"), "missing_invalid_or_non_positive_away_team_id"),
        (row["home_id"] == row["away_id"], "identical_home_and_away_team_ids"),
        (row["league_id"] != league, "conflicting_league_id"),
        (row["season"] != season, "conflicting_season"),
        (~counts(row["phase"]), "phase_not_counted"),
        (~done, "game_not_completed"),
        (bad("home_points"), "invalid_or_negative_home_points"),
        (bad("away_points"), "invalid_or_negative_away_points"),
        (row["home_points"].isNull() | row["away_points"].isNull(), "completed_game_missing_points"),
        (row["home_points"] == row["away_points"], "completed_game_tied"),
    ]
    return F.coalesce(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(reason)) for hit, reason in checks])


def counts(phase: Column) -> Column:
    """Whether games of a phase count towards features: exhibition and all-star games don't."""
    return F.coalesce(phase.isin(*COUNTED), F.lit(False))


def phase_counts(games: DataFrame, *cohort: str) -> DataFrame:
    """Games of each phase, a column per phase, and those without a known one."""
    each = [F.count(F.when(F.col("phase") == p, 1)).alias(p) for p in PHASES]
    return games.groupBy(*cohort).agg(*each, F.count(F.when(~F.coalesce(F.col("phase").isin(*PHASES), F.lit(False)), 1)).alias("unknown_phase"))


def manifest(games: DataFrame, expected_teams: int, *cohort: str) -> DataFrame:
    """Per cohort what is stored of a season: ids, repeats, teams, completed games, and a verdict; the first failure is named."""
    done = is_finished(F.col("status_short"), "basketball") & F.col("home_points").isNotNull() & F.col("away_points").isNotNull()
    per = games.groupBy(*cohort).agg(
        F.count("*").alias("stored"), F.count_distinct("game_id").alias("ids"), F.count(F.when(done, 1)).alias("completed"), F.count(F.when(done & (F.col("home_points") == F.col("away_points")), 1)).alias("tied"),
        F.count(F.when(counts(F.col("phase")), 1)).alias("counted"),
    )
    teams = games.select(*cohort, F.explode(F.array("home_id", "away_id")).alias("team")).groupBy(*cohort).agg(F.count_distinct("team").alias("teams"))
    verdict = (
        F.when(F.col("stored") > F.col("ids"), "duplicate_ids").when(F.col("tied") > 0, "tied_games").when(F.col("teams") != expected_teams, "team_universe_mismatch")
        .when(F.col("completed") < F.col("stored"), "incomplete").otherwise("verified")
    )
    return per.join(teams, list(cohort)).withColumn("verdict", verdict)


# What counts as played, by the short and the long status.
PLAYED_SHORT, PLAYED_LONG = ("FT", "AOT", "FINAL", "FINAL/OT"), ("GAME FINISHED", "FINISHED", "FINAL", "AFTER OVER TIME")


def payload_verdict(payload: Column, league: Column | None = None, season: Column | None = None, cutoff: Column | None = None, require_completed: bool = False) -> Column:
    """struct<ok, reason, game_id> of a provider's game as JSON text, by the ingestion rules in their order; ``valid`` where none objects.

    Types count: a date must be a text, teams and their sides objects, names texts. A league, season or cutoff that isn't given isn't checked, nor what the payload
    doesn't say of league and season. Points may be a number or an object with a total.
    """
    v = F.try_parse_json(payload)
    part = lambda path: F.try_variant_get(v, f"$.{path}", "variant")
    kind = lambda path: F.coalesce(F.schema_of_variant(part(path)), F.lit("VOID"))
    is_object = lambda path: F.startswith(kind(path), F.lit("OBJECT"))
    said = lambda path: F.when(kind(path) != "VOID", F.when(is_object(path) | F.startswith(kind(path), F.lit("ARRAY")) | (kind(path) == "BOOLEAN"), "?").otherwise(F.try_variant_get(v, f"$.{path}", "string")))
    number = lambda path: strict_int(said(path))
    text = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(v, f"$.{path}", "string"))
    state = lambda path: F.upper(F.trim(F.when(is_object("status"), text(path))))
    true = lambda path: F.coalesce((kind(path) == "BOOLEAN") & F.try_variant_get(v, f"$.{path}", "boolean"), F.lit(False))
    short, long = state("status.short"), state("status.long")
    flagged = F.when(is_object("status.type"), true("status.type.completed")).otherwise(is_object("status") & true("status.completed"))
    completed = flagged | F.coalesce(short.isin(*PLAYED_SHORT), F.lit(False)) | F.coalesce(long.isin(*PLAYED_LONG), F.lit(False))
    status = F.coalesce(F.nullif(short, F.lit("")), long)

    def side(which: str) -> tuple[Column, Column]:
        raw = F.when(is_object("scores"), F.when(is_object(f"scores.{which}"), said(f"scores.{which}.total")).otherwise(said(f"scores.{which}")))
        value = strict_int(raw)
        return value, raw.isNotNull() & (value.isNull() | (value < 0))

    (home, bad_home), (away, bad_away) = side("home"), side("away")
    none, not_positive = F.lit(False), lambda path: number(path).isNull() | (number(path) <= 0)
    blank = lambda path: F.coalesce(F.trim(text(path)), F.lit("")) == ""
    given = lambda path: is_object("league") & (kind(path) != "VOID")
    differs = lambda path, wanted: none if wanted is None else given(path) & (number(path) != wanted)
    against = lambda name, path, wanted: F.concat(F.lit(f"{name} ("), number(path), F.lit(" != "), F.lit("") if wanted is None else wanted.cast("string"), F.lit(")"))
    rules = [
        (~F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), F.lit("OBJECT")), "game_item_not_dict"),
        (not_positive("id"), "missing_invalid_or_non_positive_game_id"),
        (F.coalesce(text("date"), F.lit("")) == "", "missing_game_date"),
        (none if cutoff is None else ~F.coalesce(parse_utc(text("date")) < cutoff, none), "game_date_not_before_cutoff"),
        (~is_object("teams"), "missing_or_invalid_teams_object"),
        (~is_object("teams.home") | ~is_object("teams.away"), "missing_home_or_away_team_object"),
        (not_positive("teams.home.id"), "missing_invalid_or_non_positive_home_team_id"),
        (not_positive("teams.away.id"), "missing_invalid_or_non_positive_away_team_id"),
        (number("teams.home.id") == number("teams.away.id"), "identical_home_and_away_team_ids"),
        (blank("teams.home.name"), "missing_or_empty_home_team_name"),
        (blank("teams.away.name"), "missing_or_empty_away_team_name"),
        (given("league.id") & number("league.id").isNull(), "invalid_payload_league_id"),
        (differs("league.id", league), against("conflicting_league_id", "league.id", league)),
        (given("league.season") & number("league.season").isNull(), "invalid_payload_season"),
        (differs("league.season", season), against("conflicting_season", "league.season", season)),
        (~completed if require_completed else none, F.concat(F.lit("game_not_completed (status="), F.coalesce(F.nullif(status, F.lit("")), F.lit("UNKNOWN")), F.lit(")"))),
        (bad_home, "invalid_or_negative_home_points"),
        (bad_away, "invalid_or_negative_away_points"),
        (completed & (home.isNull() | away.isNull()), F.concat(F.lit("completed_game_missing_points (status="), F.coalesce(status, F.lit("None")), F.lit(")"))),
    ]
    reason = F.coalesce(*[F.when(F.coalesce(hit, none), F.lit(said_) if isinstance(said_, str) else said_) for hit, said_ in rules], F.lit("valid"))
    return F.struct((reason == "valid").alias("ok"), reason.alias("reason"), F.when(reason == "valid", number("id")).alias("game_id"))
