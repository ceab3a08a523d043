"""Summaries: header scores, periods, ragged player figures, what is not usable."""

import json

from strictbefore.sources import summaries


def summary(game, **changes):
    return {
        "header": {"id": str(game), "competitions": [{"competitors": [{"homeAway": "home", "score": "101", "linescores": [{"displayValue": "25"}, {"value": 26}, {"displayValue": "x"}, {"displayValue": "25"}, {"displayValue": "5"}]}, {"homeAway": "away", "score": {"value": 99.0}}]}]},
        "boxscore": {
            "teams": [
                {"homeAway": "home", "team": {"id": "1", "displayName": "A"}, "statistics": [{"name": "fieldGoalsMade-fieldGoalsAttempted", "displayValue": "40-80"}, {"name": "fieldGoalPct", "displayValue": "50.0%"}, {"name": "fouls", "value": 17}, {"name": "other", "displayValue": "3"}]},
                {"homeAway": "away", "team": {"id": "2"}, "statistics": [{"name": "assists", "displayValue": "--"}]},
            ],
            "players": [{"team": {"id": "1"}, "statistics": [{"keys": ["minutes", "fieldGoalsMade-fieldGoalsAttempted", "plusMinus", "points", "unknown"], "athletes": [
                {"athlete": {"id": "11", "displayName": "P"}, "starter": True, "didNotPlay": False, "stats": ["34", "7-15", "-4", "18", "9", "77"]}, {"athlete": {"id": "12"}, "stats": ["DNP", "7", "+3"]}, {"id": "13", "didNotPlay": True, "stats": []}, {"athlete": {"id": "x"}, "stats": ["1"]}, {"athlete": {}}]}]}],
        },
        **changes,
    }


def test_summaries(spark, tmp_path):
    docs = [summary(1), summary(2, boxscore={"teams": []}), summary(3, boxscore={}), summary(4, header={"id": "4"}), {"header": {"id": "5"}}, summary(6, boxscore={"teams": [{"homeAway": "middle", "statistics": [{"name": "assists", "displayValue": "3"}]}], "players": summary(6)["boxscore"]["players"]})]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, docs)))
    found = summaries.usable(spark, str(tmp_path)).cache()
    teams = {(r["game_id"], r["home_away"]): r for r in summaries.team_rows(found).collect()}
    # away says nothing but its final score; without a header it says nothing at all
    assert set(teams) == {(1, "home"), (1, "away"), (4, "home")}
    home = teams[1, "home"]
    assert (home["points"], home["field_goals_made"], home["field_goals_attempted"], home["field_goal_pct"], home["personal_fouls"], home["assists"], home["team_name"]) == (101, 40, 80, 50, 17, None, "A")
    assert home["field_mask"] == "field_goal_pct,field_goals_attempted,field_goals_made,personal_fouls,points"
    assert (teams[1, "away"]["points"], teams[1, "away"]["field_mask"], teams[4, "home"]["points"]) == (99, "points", None)
    periods = {(r["game_id"], r["home_away"], r["period"]): (r["points"], r["overtime"]) for r in summaries.period_rows(found).collect()}
    assert periods == {(1, "home", 1): (25, False), (1, "home", 2): (26, False), (1, "home", 4): (25, False), (1, "home", 5): (5, True)}
    players = {(r["game_id"], r["player_id"]): r for r in summaries.player_rows(found).collect()}
    assert set(players) == {(g, p) for g in (1, 4) for p in (11, 12, 13)}
    one, two, three = (players[1, p] for p in (11, 12, 13))
    assert (one["minutes"], one["field_goals_made"], one["field_goals_attempted"], one["plus_minus"], one["points"], one["starter"], one["player_name"], one["team_id"]) == (34, 7, 15, -4, 18, True, "P", 1)
    assert (two["minutes"], two["field_goals_made"], two["plus_minus"], two["points"]) == (None, None, 3, None)
    assert three["did_not_play"] and three["minutes"] is None
