"""Fits, merges and joins without SQL, and what rounding does to a fit, against plain Python."""

import json
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strictbefore.functions import decision, model, text
from strictbefore.operators import calibration, documents, metrics, reconcile
from strictbefore.plans import library

SF = "/root/testdata/sf0.01"


def descent(samples):
    """Full-batch descent over the samples as they are."""
    a, b = 1.0, 0.0
    xs = [math.log(max(min(p, 1 - 1e-6), 1e-6) / (1 - max(min(p, 1 - 1e-6), 1e-6))) for p, _ in samples]
    for _ in range(100):
        errors = [1 / (1 + math.exp(-(a * x + b))) - y for x, (_, y) in zip(xs, samples, strict=True)]
        a, b = a - 0.05 * sum(e * x for e, x in zip(errors, xs, strict=True)) / len(xs), b - 0.05 * sum(errors) / len(xs)
    return a, b


def test_rounding_moves_a_fit_little(spark):
    rng = np.random.default_rng(2)
    ps = rng.uniform(0.02, 0.98, 3000)
    rows = [("x", float(p), bool(rng.random() < p**1.3)) for p in ps]
    (got,) = calibration.platt_fits(spark.createDataFrame(rows, "outcome string, p double, y boolean")).collect()
    a, b = descent([(p, y) for _, p, y in rows])
    assert got["a"] == pytest.approx(a, abs=1e-4) and got["b"] == pytest.approx(b, abs=1e-4) and got["samples"] == 3000


def test_walk_forward_trains_on_earlier_periods_only(spark):
    rng = np.random.default_rng(3)
    rows = [("o", k % 2, 2000 + k % 4, float(p), bool(rng.random() < p)) for k, p in enumerate(rng.uniform(0.1, 0.9, 800))]
    got = calibration.walk_forward(spark.createDataFrame(rows, "outcome string, league int, season int, p double, y boolean"), "season", "league").collect()
    for r in got:
        past = [(p, y) for _, lg, s, p, y in rows if lg == r["league"] and s < r["season"]]
        assert (r["status"] == "APPLIED") == (len(past) >= 20)
    late = next(r for r in got if r["season"] == 2003 and r["league"] == 1)
    a, b = descent([(p, y) for _, lg, s, p, y in rows if lg == 1 and s < 2003])
    assert late["a"] == pytest.approx(a, abs=1e-3) and late["b"] == pytest.approx(b, abs=1e-3)


def pooled(points):
    """Pool adjacent violators; a pool stands at the midpoint of what it joins."""
    pools = []
    for x, y, n in points:
        pools.append([x, y, n])
        while len(pools) > 1 and pools[-2][1] > pools[-1][1]:
            (x1, y1, n1), (x2, y2, n2) = pools[-2], pools.pop()
            pools[-1] = [(x1 + x2) / 2, (n1 * y1 + n2 * y2) / (n1 + n2), n1 + n2]
    return [p[0] for p in pools], [p[1] for p in pools]


def test_isotonic_query_against_pooling(spark):
    from strictbefore.plans.model_queries import outcome_samples

    by = defaultdict(lambda: defaultdict(list))
    for r in outcome_samples(spark, SF).select("outcome", F.round("p", 6).alias("p"), "y").collect():
        by[r["outcome"]][r["p"]].append(r["y"])
    found = {r["outcome"]: r for r in library.QUERIES["isotonic_fits"](spark, SF).collect()}
    assert set(found) == set(by)
    for outcome, places in by.items():
        xs, ys = pooled([(p, sum(v) / len(v), len(v)) for p, v in sorted(places.items())])
        assert found[outcome]["xs"] == pytest.approx(xs) and found[outcome]["ys"] == pytest.approx(ys)
        assert ys == sorted(ys)


def test_merged_documents_against_plain_merges(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").collect()
    got = {r["event_id"]: r for r in library.QUERIES["merged_documents"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(events)
    for e in events:
        old = json.loads(e["props"]) if e["props"] else None
        merged, conflicts = documents.additive(old, {"k": e["event_id"] % 100, "extra": {"type": e["event_type"]}})
        assert json.loads(got[e["event_id"]]["merged"]) == merged and got[e["event_id"]]["conflicts"] == sorted(conflicts)


def test_multiclass_calibration(spark):
    fit = lambda a, b: (F.lit(a).cast("double"), F.lit(b).cast("double"))
    ps = [F.lit(0.5), F.lit(0.3), F.lit(0.2)]
    said, status = calibration.multiclass(ps, [fit(1.2, 0.1), fit(0.9, 0.0), fit(1.0, -0.2)])
    none, unavailable = calibration.multiclass(ps, [fit(1.2, 0.1), fit(None, None), fit(1.0, -0.2)])
    odd, error = calibration.multiclass([F.lit(float("nan")), *ps[1:]], [fit(1.0, 0.0)] * 3)
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate([*said, status, *none, unavailable, *odd, error])]).first()
    logistic = lambda p, a, b: 1 / (1 + math.exp(-(a * math.log(p / (1 - p)) + b)))
    own = [logistic(0.5, 1.2, 0.1), logistic(0.3, 0.9, 0), logistic(0.2, 1, -0.2)]
    assert row[:3] == pytest.approx([x / sum(own) for x in own]) and row[3] == "APPLIED"
    assert row[4:7] == (0.5, 0.3, 0.2) and row[7] == "UNAVAILABLE" and row[11] == "ERROR"


def test_bins_clamp_and_stay(spark):
    rows = [(1.2, True), (-0.1, False), (0.52, True), (0.54, False)]
    bins = metrics.calibration(spark.createDataFrame(rows, "p double, y boolean"))
    got = {r["bin"]: (r["n"], r["mean_p"], r["gap"]) for r in metrics.all_bins(bins).collect()}
    assert len(got) == 8 and got[0.8] == (1, 1.0, 0.0) and got[0.0] == (1, 0.0, 0.0) and got[0.5] == (2, 0.53, 0.03) and got[0.6][0] == 0


def test_as_of_ties_and_nulls(spark):
    facts = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 9), (4, None, 9), (5, "a", None)], "id int, k string, t int")
    dim = spark.createDataFrame([("a", 5, 10.0), ("a", 5, 11.0), ("a", 1, 1.0), ("c", 1, 3.0), (None, 1, 4.0)], "k string, since int, v double")
    got = {r["id"]: r["d_v"] for r in reconcile.as_of(facts, dim, "k", "t", "since").collect()}
    assert got == {1: 1.0, 2: 11.0, 3: None, 4: None, 5: None}


def test_names_fold_by_the_character_database(spark):
    import unicodedata

    odd = ["Ére", "É́", "Nguyễn Ạ", "ＦＣ Ａ", "ﬁn ﬂ", "İst", "Ǆ x", "½", "ø æ ł", "한국", "áb"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").orderBy("i").select(text.fold(F.col("t")).alias("f")).collect()
    for t, r in zip(odd, rows, strict=True):
        if t == "한국":  # syllables decompose into several letters and stay whole
            continue
        assert r["f"] == "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower(), t


def test_erf_and_market_faults(spark):
    xs = [-7.0, -3.1, -0.5, 0.0, 1e-9, 0.3, 2.0, 5.9, 6.5]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(model.erf(F.col("x"))).collect()]
    assert got == pytest.approx([math.erf(x) for x in xs], abs=2e-14)
    fine = {"home_win": 0.5, "draw": 0.3, "away_win": 0.2, "home_or_draw": 0.8, "over_1_5": 0.7, "over_2_5": 0.4, "under_2_5": 0.6}
    says = lambda **more: spark.range(1).select(decision.market_fault({k: F.lit(v) for k, v in (fine | more).items()})).first()[0]
    assert says() is None and says(over_2_5=0.75) == "impossible_over_1_5" and says(home_or_draw=0.7) == "inconsistent_home_or_draw"
    assert says(draw=1.3) == "invalid_probability" and says(draw=0.9) == "invalid_sum" and says(under_2_5=0.1) == "invalid_pair_over_2_5"
