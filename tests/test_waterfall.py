"""Waterfalls against plain Python, verdicts on odd payloads."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strictbefore.operators import waterfall

MATCH = "fixture_id long, ts long, home_id long, away_id long, home_goals long, away_goals long"


def brute_meetings(asks, tiers, n):
    out, read = {}, {}
    for ask, ts, home, away in asks:
        seen, rows = {}, []
        for k, (name, found) in enumerate(tiers):
            for f, at, h, a, hg, ag in found:
                if None not in (f, at, h, a, hg, ag, home, away) and home != away and {h, a} == {home, away} and at < ts and f not in seen:
                    seen[f] = name
                    rows.append((at, f, name))
            read[ask] = k + 1
            if len(rows) >= n:
                break
        out[ask] = [(f, name) for _, f, name in sorted(rows, reverse=True)[:n]]
    return out, read


def test_meetings_from_as_few_providers_as_have_them(spark):
    rng = np.random.default_rng(8)
    pool = [(i, int(rng.integers(0, 400)), int(rng.integers(0, 4)), int(rng.integers(4, 7)), int(rng.integers(0, 3)), None if i % 17 == 0 else 1) for i in range(400)]
    pool = [(f, at, *((a, h) if f % 3 else (h, a)), hg, ag) for f, at, h, a, hg, ag in pool]
    tiers = [("store", pool[::4] + [pool[0]]), ("first", pool[::2]), ("second", [*pool[1::2], (None, 3, 0, 4, 1, 1)])]
    asks = [(i, int(rng.integers(0, 500)), int(rng.integers(0, 4)), int(rng.integers(4, 7))) for i in range(80)] + [(900, 50, 1, 1), (901, 50, None, 4), (902, 5000, 7, 8)]
    frames = [(name, spark.createDataFrame(rows, MATCH)) for name, rows in tiers]
    rows, log = waterfall.meetings(spark.createDataFrame(asks, "ask long, ts long, home_id long, away_id long"), frames, 5)
    want, read = brute_meetings(asks, tiers, 5)
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r["ask"], r["place"])):
        got.setdefault(r["ask"], []).append((r["fixture_id"], r["provider"]))
    assert got == {k: v for k, v in want.items() if v}
    assert {r["ask"]: r["tiers_read"] for r in waterfall.verdict(log, "ask").collect()} == read
    status = {r["ask"]: r["resolver_status"] for r in waterfall.verdict(log, "ask").collect()}
    assert status[900] == status[901] == status[902] == "NO_DATA" and set(status.values()) >= {"PRIMARY_SUCCESS", "FALLBACK_SUCCESS", "PARTIAL"}


def test_a_busy_pair_meets_by_number(spark):
    """Two thousand matches and asks of one pair: six rows an ask."""
    found = spark.range(2000).select(F.col("id").alias("fixture_id"), F.col("id").alias("ts"), F.lit(1).alias("home_id"), F.lit(2).alias("away_id"), F.lit(0).alias("home_goals"), F.lit(0).alias("away_goals"))
    asks = spark.range(2000).select(F.col("id").alias("ask"), F.col("id").alias("ts"), F.lit(2).alias("home_id"), F.lit(1).alias("away_id"))
    got = waterfall.latest_meetings(asks, found, 6)
    assert got.count() == sum(min(i, 6) for i in range(2000))
    assert got.filter("fixture_id >= ask or fixture_id < ask - 6").count() == 0


def test_a_later_tier_is_asked_for_open_keys_only(spark):
    asked = spark.createDataFrame([(i,) for i in range(6)], "k long")
    seen = []

    def tier(name, keys):
        def ask(open_):
            seen.append((name, sorted(r["k"] for r in open_.collect())))
            return open_.filter(F.col("k").isin(*keys)).withColumn("v", F.lit(name))

        return name, ask

    rows, log = waterfall.cascade(asked, [tier("a", [0, 1]), tier("b", [1, 2, 3]), tier("c", [5])], ["k"], lambda rows: rows.filter("k != 1"), ["v"])
    assert seen == [("a", [0, 1, 2, 3, 4, 5]), ("b", [1, 2, 3, 4, 5]), ("c", [1, 4, 5])]
    assert sorted((r["k"], r["provider"]) for r in rows.collect()) == [(0, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "b"), (5, "c")]
    assert log.count() == 6 + 5 + 3 and log.filter("enough").count() == 4


def test_days_are_put_together_field_by_field(spark):
    schema = "league_id long, day string, fixture_id long, status_short string, home_goals long, away_goals long, xg double"
    a = [(1, "d1", 10, "FT", 1, None, 0.5), (1, "d2", 11, "NS", None, None, 0.1), (1, "d3", 12, "FT", 2, 2, 1.0)]
    b = [(1, "d1", 10, "FT", 3, 0, None), (1, "d3", 12, "FT", 9, 9, 9.0), (2, "d1", 20, None, None, None, 0.3)]
    c = [(1, "d1", 10, "FT", 7, 7, 7.0), (2, "d1", 20, "FT", 1, 1, None), (2, "d1", 21, "FT", 0, 0, 0.2)]
    frames = [(n, spark.createDataFrame(r, schema)) for n, r in zip("abc", (a, b, c), strict=True)]
    asked = spark.createDataFrame([(1, "d1"), (1, "d2"), (1, "d3"), (2, "d1"), (3, "d9")], "league_id long, day string")
    rows, log = waterfall.days(asked, frames, ["xg"], ["home_goals", "away_goals"], ["fixture_id"])
    got = {r["fixture_id"]: r for r in rows.collect()}
    assert (got[10]["home_goals"], got[10]["home_goals_provider"], got[10]["away_goals"], got[10]["away_goals_provider"], got[10]["xg_provider"], got[10]["disputed"]) == (1, "a", 0, "b", "a", ["home_goals"])
    assert (got[12]["home_goals"], got[12]["providers"]) == (2, 1)  # whole in the first tier: no other was asked
    assert (got[20]["status_short"], got[20]["xg"], got[20]["home_goals"]) == ("FT", 0.3, 1) and 21 in got
    said = {(r["league_id"], r["day"]): (r["tiers_read"], r["resolver_status"]) for r in waterfall.verdict(log, "league_id", "day").collect()}
    assert said == {(1, "d1"): (2, "FALLBACK_SUCCESS"), (1, "d2"): (1, "PRIMARY_SUCCESS"), (1, "d3"): (1, "PRIMARY_SUCCESS"), (2, "d1"): (3, "FALLBACK_SUCCESS"), (3, "d9"): (3, "NO_DATA")}


GOOD = {"fixture": {"id": 1}, "teams": {"home": {}}}


@pytest.mark.parametrize(
    "payload, status, items",
    [
        (None, "PROVIDER_ERROR", 0), ("", "PROVIDER_ERROR", 0), ("{broken", "PROVIDER_ERROR", 0), (json.dumps(GOOD), "PROVIDER_ERROR", 0), ("7", "PROVIDER_ERROR", 0), (" [] ", "VALID_EMPTY", 0), ("[1, \"x\", null]", "INSUFFICIENT_MALFORMED", 0),
        (json.dumps([{"fixture": {"id": 1}}]), "INSUFFICIENT_MALFORMED", 0), (json.dumps([{"fixture": "x", "teams": {}}]), "INSUFFICIENT_MALFORMED", 0), (json.dumps([GOOD, {"teams": {}}, GOOD]), "VALID_DATA", 2), (json.dumps([{"fixture": {}, "teams": {}}]), "VALID_DATA", 1),
    ],
)
def test_verdicts_on_lists(spark, payload, status, items):
    got = spark.createDataFrame([(payload,)], "p string").select(waterfall.fixtures_verdict(F.col("p")).alias("v")).first()["v"]
    assert (got["status"], len(got["items"])) == (status, items)


def test_statistics_and_acquisition(spark):
    def stats(played, gf, ga):
        return json.dumps({"fixtures": {"played": {"total": played}}, "goals": {"for": gf, "against": ga}})

    avg, tot = {"average": {"total": "1.2"}}, {"total": {"total": 9}}
    cases = [(stats(5, avg, avg), True), (stats(4, avg, avg), False), (stats("9", tot, avg), True), (stats(9, {}, avg), False), (stats(None, avg, avg), False), (None, False), ("[]", False), ("x", False), (stats(0, tot, tot), False)]
    got = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p string").select("i", waterfall.statistics_suffice(F.col("p")).alias("v")).collect()
    assert [r["v"] for r in sorted(got)] == [w for _, w in cases]
    rows = [(5, None, None, True, True), (5, True, None, True, False), (5, None, False, True, False), (5, False, True, False, False), (5, None, True, None, False), (0, None, None, True, False), (None, None, None, True, False)]
    got = spark.createDataFrame(rows, "n int, partial boolean, complete boolean, verified boolean, want boolean").select(waterfall.acquisition_suffices(*map(F.col, ("n", "partial", "complete", "verified"))).alias("v"), "want").collect()
    assert all(r["v"] == r["want"] for r in got)
