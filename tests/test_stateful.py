"""Streams with state: entries expire by event time, late rows go, and a restart goes on where the checkpoint stands."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from strictbefore.operators.elo import fold
from strictbefore.streaming import live, stateful

BASE = dt.datetime(2026, 1, 1)
EVENTS = "key string, ts timestamp, id long, put boolean, payload string, ttl_ms long"


def at(minutes, micros=0):
    return BASE + dt.timedelta(minutes=minutes, microseconds=micros)


def feed(spark, folder, rows, schema, files=1):
    for i in range(files):
        spark.createDataFrame(rows[i::files] if files > 1 else rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def answers(rows):
    """What a plain dictionary answers, event by event."""
    entries, out = {}, {}
    for key, ts, i, put, payload, ttl in sorted(rows, key=lambda r: (r[1], r[2])):
        if put:
            entries[key] = (payload, ts, None if ttl is None else ts + dt.timedelta(milliseconds=ttl))
        else:
            held = entries.get(key)
            hit = held is not None and (held[2] is None or held[2] >= ts)
            out[i] = (hit, held[0] if hit else None, (ts - held[1]) // dt.timedelta(milliseconds=1) if hit else None)
    return out


ROWS = [
    ("a", at(0), 1, True, "one", 600_000), ("a", at(10), 2, False, None, None), ("a", at(10, 1), 3, False, None, None),  # found at its last instant, gone after it
    ("a", at(20), 4, True, "two", 600_000), ("a", at(25), 5, True, "three", 600_000), ("a", at(32), 6, False, None, None), ("a", at(36), 7, False, None, None),  # a put starts afresh
    ("b", at(1), 8, False, None, None), ("b", at(2), 9, True, None, None), ("b", at(500), 10, False, None, None), ("b", at(600), 11, True, "x", 0), ("b", at(600), 12, False, None, None), ("b", at(600, 1), 13, False, None, None),
    (None, at(3), 14, True, "n", 60_000), (None, at(3), 15, False, None, None),
]


def test_entries_expire_by_event_time_over_restarts(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    stream = lambda: stateful.cache_lookups(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder), "key", late="12 hours")
    # rows are dealt to batches out of order, with a restart after each
    for part in (ROWS[1::2], ROWS[::2], [("z", at(5000), 99, True, "", None)]):
        feed(spark, folder, part, EVENTS)
        got = stateful.drained(stream(), out, checkpoint)
    assert {r["id"]: (r["hit"], r["payload"], r["age_ms"]) for r in got.collect()} == answers(ROWS)
    # a row behind the watermark is dropped
    feed(spark, folder, [("a", at(7), 50, False, None, None), ("z", at(6000), 100, True, "", None)], EVENTS)
    again = stateful.drained(stream(), out, checkpoint)
    assert {r["id"] for r in again.collect()} == {i for _, _, i, put, _, _ in ROWS if not put}
    # what expired has left the state; what never does is still there
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "entry").load()
    assert {(r["key"]["key"], r["value"]["payload"]) for r in state.collect()} == {("z", "")}
    waiting = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "waiting").load()
    assert {r["key"]["key"] for r in waiting.collect()} == {"z"}


def test_ratings_over_a_restart_with_late_and_equal_instants(spark, tmp_path):
    names = ["league_id", "fixture_id", "ts", "home_id", "away_id", "home_goals", "away_goals"]
    schema = "league_id long, fixture_id long, ts timestamp, home_id long, away_id long, home_goals long, away_goals long"
    rows = [(1 + i % 2, i, BASE + dt.timedelta(days=i // 6), i % 5, (i % 5 + 1 + i % 3) % 5, i % 4, (i // 2) % 3) for i in range(120)]
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    run = lambda: stateful.drained(live.live_ratings(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), "3 days"), out, checkpoint)
    feed(spark, folder, rows[:61][::-1], schema)
    part = run().count()
    assert 0 < part < 61  # the last three days wait
    for a, b in ((61, 75), (75, 103), (103, 120)):
        feed(spark, folder, rows[a:b][::-1], schema)
    feed(spark, folder, [(g, 900 + g, BASE + dt.timedelta(days=400), 8, 9, 0, 0) for g in (1, 2)], schema)
    feed(spark, folder, [(1, 990, BASE, 0, 1, 9, 0)], schema)  # late: dropped, so no rating moves
    got = {r["fixture_id"]: (r["home_rating"], r["away_rating"]) for r in run().collect()}
    want = {}
    for _, own in pd.DataFrame(rows, columns=names).assign(season=1).groupby("league_id"):
        want |= {r.fixture_id: (r.home_rating, r.away_rating) for r in fold(own).itertuples()}
    assert set(got) == set(want)
    for k, pair in want.items():
        assert got[k] == pytest.approx(pair)


def test_live_markets_of_odd_scores(spark):
    """A lead beyond the grid, no goals to come, and fixtures without expected goals."""
    scores = spark.createDataFrame([(1, 30, "1H", 0, 0), (2, 89, "2H", 30, 0), (3, 200, "2H", 1, 1), (4, None, "HT", 0, 2), (9, 1, "1H", 0, 0)], "fixture_id long, elapsed int, status_short string, home_goals int, away_goals int")
    expected = spark.createDataFrame([(i, 1.5, 1.0, 2) for i in range(1, 4)] + [(1, 9.0, 9.0, 1), (4, 0.0, 0.0, 1)], "fixture_id long, home_xg double, away_xg double, version int")
    got = {r["fixture_id"]: r.asDict() for r in live.scored(scores, expected).collect()}
    assert set(got) == {1, 2, 3, 4}
    for r in got.values():
        assert r["home_win"] + r["draw"] + r["away_win"] == pytest.approx(1)
    assert got[2]["home_win"] == pytest.approx(1) and got[2]["over_3_5"] == pytest.approx(1)
    assert got[3]["minutes_left"] == 1 and got[3]["btts"] == 1 and got[3]["over_1_5"] == pytest.approx(1) and got[3]["draw"] > 0.95
    assert got[4]["minutes_left"] == 45 and got[4]["away_win"] == pytest.approx(1) and got[4]["over_2_5"] == pytest.approx(0) and got[4]["btts"] == 0
    assert got[1]["home_to_come"] == pytest.approx(1.0) and got[1]["btts"] == pytest.approx((1 - 2.718281828**-1.0) * (1 - 2.718281828 ** (-2 / 3)))


class Held:
    """A state variable of one key, as a dictionary."""

    def __init__(self):
        self.d = {}
        self.getValue, self.containsKey, self.updateValue = self.d.__getitem__, self.d.__contains__, self.d.__setitem__
        self.removeKey, self.iterator = self.d.__delitem__, lambda: iter(list(self.d.items()))
        self.get, self.exists, self.update, self.clear = lambda: self.d.get(0), lambda: 0 in self.d, lambda v: self.d.update({0: v}), self.d.clear


class Handle:
    def __init__(self):
        self.timers = set()
        self.registerTimer = self.timers.add

    def getMapState(self, *_):  # noqa: N802
        return Held()

    getValueState = getMapState


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_merged_in_whole_instants(monkeypatch, seed):
    """Small parts, an instant that fills several, nulls, instants of years 1600 and 3000; batches out of order, each with its watermark."""
    monkeypatch.setattr(stateful, "PART", 7)
    rng = np.random.default_rng(seed)
    seen = []

    class Seen(stateful.InOrder):
        EVENT = "at long, id long, name string"

        def apply(self, key, events):
            rows = [tuple(r.values()) for r in events.to_pylist()]
            assert not seen or seen[-1][0] < rows[0][0]  # an instant is never divided
            seen.extend(rows)
            return iter(())

    far = [stateful.micros(dt.datetime(y, 1, 1)) for y in (1600, 3000)]
    whole = [(int(a), int(i), n) for i, (a, n) in enumerate(zip(rng.integers(0, 400_000, 600), rng.choice(["x", None], 600), strict=True))]
    whole += [(200_500, 1000 + i, None) for i in range(40)] + [(a, 2000, "far") for a in far]
    whole = [whole[i] for i in rng.permutation(len(whole))]
    handle, timer, kept = Handle(), type("T", (), {"getCurrentWatermarkInMs": lambda self: mark})(), []
    run = Seen()
    run.init(handle)
    marks = [-10**10, 50, 50, 201, 300, 10**12, stateful.scaled(stateful.micros(dt.datetime(4000, 1, 1))) // 1000]
    for k, mark in enumerate(marks):
        batch = [e for e in whole[k * 100 : (k + 1) * 100] if stateful.scaled(e[0]) > 1000 * mark]  # Spark drops what is behind the watermark
        kept += batch
        if batch:
            frames = [pd.DataFrame([(a, False, i or 0, i is None, n) for a, i, n in part], columns=["at", "no_at", "id", "no_id", "name"]) for part in (batch[:60], batch[60:]) if part]
            assert list(run.handleInputRows(("k",), iter(frames), timer)) == []
        for due in sorted(t for t in handle.timers if t <= mark):
            assert list(run.handleExpiredTimer(("k",), timer, None)) == []
            handle.timers.discard(due)
        assert sorted(seen, key=str) == sorted((e for e in kept if stateful.scaled(e[0]) <= 1000 * mark), key=str)
    assert [e[:2] for e in seen] == sorted(e[:2] for e in kept) and not run.waiting.d and not run.runs.d and len(kept) > 300


def test_events_of_many_instants_wait_in_few_state_values(spark, tmp_path):
    """500 instants of a key were 500 state values and timers; they are one part of a run. An id of null and one over 2^53 come out as they went in, and so does the year 3000."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = [("a", at(m), 2**53 + 1 + 2 * m, False, None, None) for m in range(500)] + [("a", at(501), None, False, None, None), ("a", dt.datetime(3000, 1, 1), 7, False, None, None)]
    feed(spark, folder, rows, EVENTS)
    run = lambda: stateful.drained(stateful.cache_lookups(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder), "key", late="365000 days"), out, checkpoint)
    assert run().count() == 0
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    assert read("waiting").count() == 1
    short, checkpoint = str(tmp_path / "out2"), str(tmp_path / "checkpoint2")
    feed(spark, folder, [("z", dt.datetime(9000, 1, 1), 0, True, None, None)], EVENTS)
    got = stateful.drained(stateful.cache_lookups(spark.readStream.schema(EVENTS).parquet(folder), "key"), short, checkpoint)
    assert sorted(r["id"] or 0 for r in got.collect()) == sorted(r[2] or 0 for r in rows)


def test_ratings_of_many_matches_are_read_and_written_once_a_team():
    rows = [(i % 5, (i % 5 + 1 + i % 3) % 5, i % 4, (i // 2) % 3, i // 6, i) for i in range(600)]
    run, handle = stateful.Ratings("league_id"), Handle()
    run.init(handle)
    calls = []
    write = run.ratings.updateValue
    run.ratings.updateValue = lambda k, v: (calls.append(k), write(k, v))
    timer = type("T", (), {"getCurrentWatermarkInMs": lambda self: 10**9})()
    frame = pd.DataFrame([(1000 * at, i, h, a, hg, ag) for h, a, hg, ag, at, i in rows], columns=["at", "fixture_id", "home_id", "away_id", "home_goals", "away_goals"])
    list(run.handleInputRows(("1",), iter([frame[::-1]]), timer))
    got = pd.concat(run.handleExpiredTimer(("1",), timer, None))
    want = fold(frame.rename(columns={"at": "ts"}).assign(league_id=1, season=1))
    assert got[["fixture_id", "home_rating", "away_rating"]].astype("float64").to_numpy() == pytest.approx(want[["fixture_id", "home_rating", "away_rating"]].astype("float64").to_numpy())
    assert sorted(calls) == [(t,) for t in range(5)] and not run.now
