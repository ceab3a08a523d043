from pyspark.sql import functions as F

from strictbefore.functions import grading, text
from strictbefore.operators import reconcile
from strictbefore.sources import store


def test_scans(spark):
    raw = '{"provider_provenance":{"provider":"x","providers":["a"]}}'
    rows = [(i, 1, 2024, f"2024-01-{10 - i:02d} 12:00:00", "mixed" if i % 2 else "b", raw if i < 8 else '{"reconciliation_metadata":{"legacy_duplicate_candidate":true}}', "t1" if i % 3 else "t2", "t3") for i in range(1, 9)]
    stored = spark.createDataFrame(rows, "fixture_id long, league_id int, season int, k string, source string, raw_json string, canonical_home_id string, canonical_away_id string").withColumn("kickoff_at", F.col("k").cast("timestamp"))
    assert [r["fixture_id"] for r in store.fixtures(stored, 1, 2024).collect()] == [7, 6, 5, 4, 3, 2, 1]
    assert [r["fixture_id"] for r in store.fixtures(stored, 1, 2024, ["a"]).collect()] == [7, 5, 3, 1]
    assert store.fixtures(stored, 1, 2024, []).count() == 0 and store.fixtures(stored, 1, 2024, with_duplicates=True).count() == 8
    assert [r["fixture_id"] for r in store.last_of_team(stored, "t2", "2024-01-07 12:00:00", 5).collect()] == [6]
    assert [r["fixture_id"] for r in store.last_of_team(stored, "t1", "2024-02-01 00:00:00", 2).collect()] == [2, 1]
    extra = spark.createDataFrame([(1, "soccerdata", 1), (1, "api_football", 2), (2, "zzz", 3), (3, "reconciled", 4)], "fixture_id long, source string, shots int")
    wanted = spark.createDataFrame([(1,), (2,), (2,)], "fixture_id long")
    assert sorted((r["fixture_id"], r["shots"]) for r in store.enrichment(extra, wanted).collect()) == [(1, 2), (2, 3)]
    expected = spark.createDataFrame([(1, 2024, 8), (1, 2025, 3), (2, 2024, None)], "league_id int, season int, expected int")
    assert {(r["league_id"], r["season"]): r["status"] for r in store.manifest(stored, expected, "league_id", "season").collect()} == {(1, 2024): "COMPLETE", (1, 2025): "INCOMPLETE", (2, 2024): "UNVERIFIABLE"}


def test_twins_and_labels(spark):
    rows = [(1, "2024-01-01 00:00:00", "Arsenal", "Chelsea"), (2, "2024-01-01 15:00:00", "Arsenal FC", "Chelsea FC"), (3, "2024-01-01 17:00:00", "Leeds", "Hull"), (4, "2024-01-02 00:00:00", "Leeds", "Hull")]
    found = spark.createDataFrame(rows, "fixture_id long, k string, home_team string, away_team string").select("fixture_id", F.lit(1).alias("league_id"), F.lit(2024).alias("season"), F.col("k").cast("timestamp").alias("kickoff_at"), "home_team", "away_team")
    assert [(r["fixture_id"], r["twin_id"], str(r["kickoff_at"])) for r in reconcile.midnight_twins(found, 0.8).collect()] == [(1, 2, "2024-01-01 15:00:00")]
    row = spark.range(1).select(grading.pick_alias(F.lit(" H ")).alias("a"), grading.pick_alias(F.lit("Over-2 5")).alias("b"), grading.actual_double_chance(F.lit(1), F.lit(1)).alias("c"), text.normal_text(F.lit("  A \n b ")).alias("d")).first()
    assert row[:] == ("home_win", "over_2_5", "home_or_draw", "a b")
