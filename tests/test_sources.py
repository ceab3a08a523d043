import gzip
import json

from pyspark.sql import functions as F

from strictbefore.sources import readers, sinks


def test_csv_season(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿date , HomeTeam,AWAYTEAM,FTHG,FTAG,HS\n01/08/2024,A,B,2,1,9\n32/08/2024,A,C,1,1,\n02/08/24,B,A,-1,0,\n03/08/2024,C,C,0,0,\n2024-08-04,C,A,,0,\n")
    rows = readers.csv_season(spark, str(tmp_path / "s.csv"), 39, 2024).orderBy("home_team", "away_team").collect()
    assert [(r["home_team"], r["away_team"], r["reject"]) for r in rows] == [("A", "B", None), ("A", "C", "bad_date"), ("B", "A", "negative_score"), ("C", "A", "missing_score"), ("C", "C", "identical_teams")]
    assert rows[0]["home_shots"] == 9 and str(rows[2]["day"]) == "2024-08-02" and len({r["fixture_id"] for r in rows}) == 5


def test_scores(spark):
    texts = ["2-1", "2-1 (1-0)", "3-2 a.e.t. (2-2, 1-1)", "4-3 pen. 1-1 a.e.t. (1-1, 0-0)", "x", "2-"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", readers.score_parts(F.col("t")).alias("s")).collect()
    got = {r["t"]: r["s"] and tuple(r["s"]) for r in rows}
    assert got["2-1"] == (2, 1, "FT", None, None, 2, 1, None, None)
    assert got["2-1 (1-0)"] == (2, 1, "FT", 1, 0, 2, 1, None, None)
    assert got["3-2 a.e.t. (2-2, 1-1)"] == (3, 2, "AET", 1, 1, 2, 2, None, None)
    assert got["4-3 pen. 1-1 a.e.t. (1-1, 0-0)"] == (1, 1, "PEN", 0, 0, 1, 1, 4, 3)
    assert got["x"] is None and got["2-"] is None


def test_football_txt(spark, tmp_path):
    (tmp_path / "s.txt").write_text("= League 2024/25\n# Teams 4\n\n▪ Round 1\nFri Aug 16\n  20:00  Alpha FC v Beta United  2-1 (1-0)\n         Gamma 0-0 Delta\n▪ Round 2\nSat Jan/4 2025\n  15.30  Beta United v Alpha FC  1-1\n  a line that says nothing\n")
    rows = readers.football_txt(spark, str(tmp_path / "s.txt"), 2024).orderBy("line").collect()
    assert [(r["stage"], str(r["day"]), r["time"], r["home_team"], r["away_team"], r["home"], r["away"]) for r in rows] == [
        ("Round 1", "2024-08-16", "20:00", "Alpha FC", "Beta United", 2, 1), ("Round 1", "2024-08-16", "20:00", "Gamma", "Delta", 0, 0), ("Round 2", "2025-01-04", "15.30", "Beta United", "Alpha FC", 1, 1),
    ]


def test_json_payloads(spark, tmp_path):
    fixture = {"fixture": {"id": 7, "date": "2026-01-01T12:00:00Z", "status": {"short": "PEN"}}, "league": {"id": 39, "season": 2025}, "teams": {"home": {"id": 1, "name": "A"}, "away": {"id": 2, "name": "B"}}, "goals": {"home": 1, "away": 1},
               "score": {"fulltime": {"home": 1, "away": 1}, "penalty_shootout": {"home": 4, "away": 3}}, "statistics": [{"team": {"id": 1}, "statistics": [{"type": "Ball Possession", "value": "55%"}]}]}
    naive = fixture | {"fixture": {"id": "1.0", "date": "2026-01-01T12:00:00", "status": {"short": "FT"}}}
    (tmp_path / "f.json").write_text(json.dumps(fixture) + "\n" + json.dumps(naive) + "\n")
    a, b = readers.fixture_payloads(spark, str(tmp_path / "f.json")).orderBy(F.desc_nulls_last("fixture_id")).collect()
    assert (a["fixture_id"], a["pen_home"], a["statistics"][0]["value"], str(a["kickoff_at"])) == (7, 4, 55.0, "2026-01-01 12:00:00")
    assert b["fixture_id"] is None and b["kickoff_at"] is None
    result = [{"matchID": 3, "matchDateTimeUTC": "2026-01-01T12:00:00Z", "team1": {"teamId": 1, "teamName": "A"}, "team2": {"teamId": 2, "teamName": "B"}, "matchIsFinished": True,
               "matchResults": [{"resultTypeID": 1, "resultName": "Halbzeit", "resultOrderID": 1, "pointsTeam1": 0, "pointsTeam2": 0}, {"resultTypeID": 2, "resultName": "Endergebnis", "resultOrderID": 2, "pointsTeam1": 3, "pointsTeam2": 1}]}]
    (tmp_path / "l.json").write_text(json.dumps(result))
    row = readers.result_rows(spark, str(tmp_path / "l.json")).first()
    assert (row["home_goals"], row["away_goals"], row["status_short"]) == (3, 1, "FT")


def test_last_line_of_a_key_counts(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text('{"id": 1, "v": "a"}\n{"id": 2, "v": "b"}\n\n{"id": 1, "v": "c"}\n')
    got = {r["key"]: json.loads(r["raw"])["v"] for r in readers.last_lines(spark, str(tmp_path / "o.jsonl"), "id").collect()}
    assert got == {"1": "c", "2": "b"}


def test_upsert_append_and_retention(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, x string, y int")
    two = spark.createDataFrame([(2, None, 5), (3, "c", 3)], "k int, x string, y int")
    sinks.upsert(one, path, ["k"])
    got = sinks.upsert(two, path, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(got).collect()) == [(1, "a", 1), (2, "b", 5), (3, "c", 3)]
    sinks.append_new(one, f"{path}-log", ["k"])
    sinks.append_new(two, f"{path}-log", ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(f"{path}-log").collect()) == [1, 2, 3]
    chat = spark.createDataFrame([(c, i) for c in "ab" for i in range(5)], "chat string, at int")
    assert sorted(tuple(r) for r in sinks.keep_last(chat, "chat", "at", 2).collect()) == [("a", 3), ("a", 4), ("b", 3), ("b", 4)]
    gone, kept = sinks.retire(one, two, ["k"])
    assert [r["k"] for r in gone.collect()] == [2] and [r["k"] for r in kept.collect()] == [1]
    sinks.write_ledger(one, f"{path}-ledger")
    lines = [line for f in (tmp_path / "t-ledger").glob("*.gz") for line in gzip.open(f, "rt")]
    assert len(lines) == 2
    bad = sinks.result_conflicts(spark.createDataFrame([(1, "z", 1)], "k int, x string, y int"), one, "k", ["x"])
    assert [r["stored_x"] for r in bad.collect()] == ["a"]
    assert "| 1 | a | 1 |" in sinks.dashboard(one.orderBy("k"), "T")
    sinks.overwrite_partitions(one, f"{path}-part", "k")
    sinks.overwrite_partitions(one.filter("k = 1").withColumn("x", F.lit("n")), f"{path}-part", "k")
    assert sorted((r["k"], r["x"]) for r in spark.read.parquet(f"{path}-part").collect()) == [(1, "n"), (2, "b")]
