import json

from pyspark.sql import functions as F

from strictbefore.operators import documents, identity
from strictbefore.sources import feeds


def put(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def event(i, uid="s:40~l:46~e:{}", year=2023, kind=2, **more):
    side = lambda name, n: {"homeAway": name, "score": str(n), "team": {"id": "1", "uid": "s:40~l:46~t:1", "displayName": name.title()}}
    return {"id": str(i), "uid": uid.format(i), "date": "2024-01-01T00:00Z", "season": {"year": year, "type": kind}, "status": {"type": {"completed": True}}, "competitions": [{"type": {"id": "1", "abbreviation": "STD"}, "competitors": [side("home", 100 + i), side("away", 90)]}]} | more


def test_classified_events(spark, tmp_path):
    star = event(5)
    star["competitions"][0]["type"] = {"id": "4", "abbreviation": "x"}
    foreign = event(6)
    foreign["competitions"][0]["competitors"][0]["team"]["uid"] = "s:40~l:59~t:1"
    events = [event(1), event(1), event(2, kind=3), event(3, uid="s:600~l:1~e:{}"), event(4, year=2020), star, foreign, event(7, uid="s:40~l:46~e:99"), event(8, uid=""), event(9, kind=77)]
    got = {r["event_id"]: (r["quarantine"], r["phase"]) for r in feeds.classified_events(spark, put(tmp_path / "e.json", {"events": events}), 2023).collect()}
    assert got == {"1": (None, "regular_season"), "2": (None, "postseason"), "3": ("other_competition", None), "4": ("outside_season", None), "5": (None, "all_star"), "6": ("team_of_other_competition", None), "7": ("uid_id_mismatch", None), "8": ("uid_missing", None), "9": (None, None)}


def test_day_listing_and_details(spark, tmp_path):
    match = {"id": "5", "statusId": 6, "status": {"utcTime": "2024-05-01T18:00:00Z"}, "home": {"name": "A", "score": 2}, "away": {"name": "B", "score": 1}}
    row = feeds.day_listing(spark, put(tmp_path / "d.json", {"leagues": [{"name": "Serie A", "matches": [match]}, {"name": "Copy", "matches": [match]}]})).collect()
    assert len(row) == 1 and row[0]["finished"] and row[0]["home_score"] == 2
    detail = {"matchId": "5", "content": {"stats": {"Periods": {"All": {"stats": [{"stats": [{"key": "BallPossesion", "stats": ["55", "45"]}, {"key": "expected_goals", "stats": ["1.4", None]}]}]}}}}}
    got = feeds.match_details(spark, put(tmp_path / "m.json", detail)).first()
    assert (got["home_possession"], got["away_possession"], got["home_xg"], got["away_xg"], got["home_corners"]) == (55.0, 45.0, 1.4, None, None)


def test_lists_and_odds(spark, tmp_path):
    listed = {"matches": [{"id": 1, "utcDate": "2024-08-01T12:00:00Z", "status": "FINISHED", "homeTeam": {"id": 3, "name": "Long", "shortName": "Short"}, "awayTeam": {"id": 4, "name": "Other"}, "score": {"fullTime": {"home": 1, "away": 0}}}, {"id": 2, "utcDate": "x", "status": "??", "homeTeam": {"id": 3}, "awayTeam": {"id": 4}, "score": {}}]}
    a, b = feeds.listed_matches(spark, put(tmp_path / "l.json", listed), 39, 2024).orderBy("fixture_id").collect()
    assert (a["status_short"], a["home_team"], a["away_team"], a["home_goals"]) == ("FT", "Short", "Other", 1) and (b["status_short"], b["kickoff_at"]) == ("NS", None)
    union = {"id": "9", "homeTeam": {"id": "1", "internationalName": "A"}, "awayTeam": {"id": "2", "internationalName": "B"}, "kickOffTime": {"dateTime": "2024-08-01T12:00:00Z"}, "status": "LIVE", "score": {"total": {"home": 0, "away": 0}}}
    assert feeds.union_matches(spark, put(tmp_path / "u.json", union), 2, 2024).first()["reject"] == "not_finished"
    odds = [{"home_team": "A", "away_team": "B", "bookmakers": [{"key": "k", "markets": [{"key": "h2h", "outcomes": [{"name": "A", "price": 2.0}, {"name": "Draw", "price": 1.0}, {"name": "B", "price": 4.0}]}, {"key": "totals", "outcomes": [{"name": "A", "price": 9.0}]}]}]}]
    assert sorted((r["outcome"], r["price"]) for r in feeds.odds_events(spark, put(tmp_path / "o.json", odds)).collect()) == [("away_win", 4.0), ("home_win", 2.0)]
    for i in (1, 2):
        put(tmp_path / f"p{i}.json", {"response": [{"id": i}]})
    assert sorted(r["id"] for r in feeds.pages(spark, str(tmp_path / "p*.json"), "id:long").collect()) == [1, 2]
    table = spark.createDataFrame([("A", "B ", "2024-08-01", "2–1"), ("A", "C", "bad", "")], "Home string, Away string, Date string, Score string")
    got = feeds.score_rows(table, {"home_team": "Home", "away_team": "Away", "date": "Date", "score": "Score"}, "table", 39, 2024).orderBy("away_team").collect()
    assert (got[0]["home_goals"], got[0]["away_goals"], got[0]["away_team"]) == (2, 1, "B") and got[1]["day"] is None and got[1]["home_goals"] is None


def test_additive_merge_and_provenance(spark):
    old, new = '{"a": 1, "b": {"c": null, "d": [1]}, "e": "unknown"}', '{"a": 2, "b": {"c": 3, "d": [2]}, "e": "x", "f": 0}'
    rows = spark.createDataFrame([(old, new), (None, "{}"), ("no json", '{"a": 1}')], "o string, n string").select(documents.merge_json(F.col("o"), F.col("n")).alias("m")).collect()
    assert json.loads(rows[0]["m"]["merged"]) == {"a": 1, "b": {"c": 3, "d": [1]}, "e": "x", "f": 0} and rows[0]["m"]["conflicts"] == ["a", "b.d"]
    assert json.loads(rows[2]["m"]["merged"]) == {"a": 1}
    names, ids = documents.provider_evidence(F.array(F.lit("z")), F.create_map(F.lit("z"), F.lit("1")), F.lit("a"), F.lit(7))
    row = spark.range(1).select(names.alias("n"), ids.alias("i")).first()
    assert row["n"] == ["a", "z"] and row["i"] == {"z": "1", "a": "7"}


def test_identities_are_minted_once(spark):
    raw = spark.createDataFrame([("p", "7", "Real FC", 1), ("p", "7", "Real", 1), ("p", None, "Nobody", 2), ("p", None, "", 2)], "provider string, provider_team_id string, name string, league_id long")
    got = sorted((r["provider_team_id"], r["canonical_id"]) for r in identity.mint(raw, "football").collect())
    assert got == [("7", "football_team_real"), ("name:2:nobody", "football_team_nobody")]
