import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from strictbefore.operators.elo import fold
from strictbefore.streaming import live


def run(spark, frame, build, tmp_path, name):
    """A stream over one file per batch."""
    schema = frame.schema
    source = str(tmp_path / name)
    for i, part in enumerate(frame.toPandas().pipe(lambda p: [p.iloc[k : k + 40] for k in range(0, len(p), 40)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = build(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return spark.table(name)


def test_windows_close_and_repeats_go(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    rows = [(i, base + dt.timedelta(hours=i % 50), "a", 1.0) for i in range(100)] + [(1000, base + dt.timedelta(days=30), "z", 0.0)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    got = run(spark, events.orderBy("ts"), lambda s: live.windowed_counts(s, late="10 days"), tmp_path, "windows")
    want = {(base, 48), (base + dt.timedelta(days=1), 48), (base + dt.timedelta(days=2), 4)}
    assert {(r["start"], r["n"]) for r in got.collect() if r["event_type"] == "a"} == want
    twice = events.unionByName(events)
    once = run(spark, twice.orderBy("ts"), lambda s: live.without_repeats(s, ["event_id"], "40 days"), tmp_path, "once")
    assert once.count() == len(rows)


def test_live_ratings_equal_the_fold(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    rows = [(1 + i % 2, i, base + dt.timedelta(days=i // 3), i % 5, (i % 5 + 1 + i % 3) % 5, i % 4, (i // 2) % 3) for i in range(90)]
    rows += [(g, 900 + g, base + dt.timedelta(days=400 + 40 * n), 8, 9, 0, 0) for n in range(2) for g in (1, 2)]
    names = ["league_id", "fixture_id", "ts", "home_id", "away_id", "home_goals", "away_goals"]
    found = spark.createDataFrame(rows, "league_id long, fixture_id long, ts timestamp, home_id long, away_id long, home_goals long, away_goals long")
    got = run(spark, found.orderBy("ts"), lambda s: live.live_ratings(s, "5 days"), tmp_path, "rated")
    seen = {r["fixture_id"]: (round(r["home_rating"], 6), round(r["away_rating"], 6)) for r in got.collect() if r["fixture_id"] < 900}
    want = {}
    for _, own in pd.DataFrame(rows, columns=names).assign(season=1).groupby("league_id"):
        own = own[own.fixture_id < 900]
        for r in fold(own).itertuples():
            want[r.fixture_id] = (round(r.home_rating, 6), round(r.away_rating, 6))
    assert seen == want


def test_sessions_in_batch(spark):
    base = dt.datetime(2026, 1, 1)
    events = spark.createDataFrame([(1, base), (1, base + dt.timedelta(minutes=20)), (1, base + dt.timedelta(hours=3))], "user_id long, ts timestamp")
    assert sorted(r["n"] for r in live.sessions(events).select(F.col("n")).collect()) == [1, 2]
