"""The ingestion rules of basketball payloads, one broken at a time, in their order."""

import json

import pytest
from pyspark.sql import functions as F

from strictbefore.operators import basketball

GOOD = {"id": 7, "date": "2026-01-01T20:00:00+00:00", "teams": {"home": {"id": 1, "name": "A"}, "away": {"id": 2, "name": "B"}}, "league": {"id": 12, "season": 2025}, "status": {"short": "FT", "long": "Game Finished"}, "scores": {"home": {"total": 100}, "away": {"total": 99}}}


def but(**changes):
    out = json.loads(json.dumps(GOOD))
    for path, value in changes.items():
        *way, last = path.split("__")
        at = out
        for w in way:
            at = at[w]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return out


CASES = [
    (GOOD, "valid"), (None, "game_item_not_dict"), ([1], "game_item_not_dict"), ("text", "game_item_not_dict"), (but(id=0), "missing_invalid_or_non_positive_game_id"), (but(id=True), "missing_invalid_or_non_positive_game_id"), (but(id="x"), "missing_invalid_or_non_positive_game_id"), (but(id="9"), "valid"),
    (but(date=...), "missing_game_date"), (but(date=""), "missing_game_date"), (but(date=20260101), "missing_game_date"), (but(date="2026-06-01T00:00:00Z"), "game_date_not_before_cutoff"), (but(date="soon"), "game_date_not_before_cutoff"),
    (but(teams=[]), "missing_or_invalid_teams_object"), (but(teams__home=None), "missing_home_or_away_team_object"), (but(teams__away="B"), "missing_home_or_away_team_object"), (but(teams__home__id=-1), "missing_invalid_or_non_positive_home_team_id"),
    (but(teams__away__id=...), "missing_invalid_or_non_positive_away_team_id"), (but(teams__away__id=1), "identical_home_and_away_team_ids"), (but(teams__home__name=" "), "missing_or_empty_home_team_name"), (but(teams__home__name=5), "missing_or_empty_home_team_name"), (but(teams__away__name=...), "missing_or_empty_away_team_name"),
    (but(league__id="x"), "invalid_payload_league_id"), (but(league__id=13), "conflicting_league_id (13 != 12)"), (but(league__season="2025-26"), "invalid_payload_season"), (but(league__season=2024), "conflicting_season (2024 != 2025)"), (but(league=...), "valid"), (but(league__id=None), "valid"), (but(league="NBA"), "valid"),
    (but(status={"short": "NS"}), "game_not_completed (status=NS)"), (but(status={"short": "", "long": "Scheduled"}), "game_not_completed (status=SCHEDULED)"), (but(status=...), "game_not_completed (status=UNKNOWN)"), (but(status="FT"), "game_not_completed (status=UNKNOWN)"),
    (but(status={"short": " aot "}), "valid"), (but(status={"long": "final"}), "valid"), (but(status={"type": {"completed": True}}), "valid"), (but(status={"completed": True}), "valid"), (but(status={"type": {"completed": "yes"}, "completed": True}), "game_not_completed (status=UNKNOWN)"),
    (but(scores__home__total=-1), "invalid_or_negative_home_points"), (but(scores__away="x"), "invalid_or_negative_away_points"), (but(scores__home=88), "valid"), (but(scores__home=True), "invalid_or_negative_home_points"), (but(scores=...), "completed_game_missing_points (status=FT)"),
    (but(scores__away__total=None), "completed_game_missing_points (status=FT)"), (but(status={"type": {"completed": True}}, scores=None), "completed_game_missing_points (status=None)"),
    (but(id=0, date=""), "missing_invalid_or_non_positive_game_id"), (but(scores__home__total=-1, status={"short": "NS"}), "game_not_completed (status=NS)"),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = spark.createDataFrame([(i, None if p is None else json.dumps(p)) for i, (p, _) in enumerate(CASES)] + [(900, "{broken"), (901, "")], "i int, payload string")
    cutoff = F.lit("2026-05-01").cast("timestamp")
    return {r["i"]: r["v"] for r in rows.select("i", basketball.payload_verdict(F.col("payload"), F.lit(12), F.lit(2025), cutoff, True).alias("v")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_each_rule(verdicts, i):
    assert verdicts[i]["reason"] == CASES[i][1]
    assert verdicts[i]["ok"] == (CASES[i][1] == "valid") and (verdicts[i]["game_id"] is not None) == verdicts[i]["ok"]


def test_broken_texts_and_what_is_not_checked(spark, verdicts):
    assert verdicts[900]["reason"] == verdicts[901]["reason"] == "game_item_not_dict"
    loose = spark.createDataFrame([(json.dumps(but(status={"short": "NS"}, scores=None, league__id=99, date="soon")),)], "payload string").select(basketball.payload_verdict(F.col("payload")).alias("v")).first()["v"]
    assert loose["ok"]
