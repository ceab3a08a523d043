"""Merged pools against the sequential fit, on unrounded values."""

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strictbefore.operators import isotonic
from strictbefore.plans import library

SF = "/root/testdata/sf0.01"


def sequential(points):
    """Pool by pool from the left, in fractions."""
    pools = []
    for x, s, n in points:
        pools.append([x, Fraction(s, n), n])
        while len(pools) > 1 and pools[-2][1] > pools[-1][1]:
            x2, y2, n2 = pools.pop()
            x1, y1, n1 = pools[-1]
            pools[-1] = [(x1 + x2) / 2, (n1 * y1 + n2 * y2) / (n1 + n2), n1 + n2]
    return [p[0] for p in pools], [float(p[1]) for p in pools]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 5)), max_size=40), st.lists(st.integers(0, 40), max_size=5))
def test_blocks_dont_depend_on_how_places_are_cut(counts, cuts):
    points = [(float(i), min(s, n), n) for i, (s, n) in enumerate(counts)]
    whole = [(p[3], p[1], p[2]) for p in isotonic.pooled(points)]
    edges = [0, *sorted(c for c in cuts if c < len(points)), len(points)]
    parts = [p for a, b in zip(edges, edges[1:], strict=False) for p in isotonic.pooled(points[a:b])]
    assert [(p[3], p[1], p[2]) for p in isotonic.pooled((first, s, n) for _, s, n, first in parts)] == whole


def test_fits_equal_the_sequential_ones(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k, outcome in [(1, "a"), (1, "b"), (2, "a"), (None, "a")]:
        p = np.round(rng.random(700), 3 if outcome == "a" else 12)
        y = rng.random(700) < (p if k != 2 else 1 - p)
        rows += [(k, outcome, float(a), bool(b)) for a, b in zip(p, y, strict=True)]
        places = {}
        for a, b in zip(p.tolist(), y.tolist(), strict=True):
            s, n = places.get(a, (0, 0))
            places[a] = (s + b, n + 1)
        want[k, outcome] = sequential([(x, *places[x]) for x in sorted(places)])
    rows += [(3, "few", 0.1 * i, True) for i in range(5)] + [(1, "a", None, True), (1, "a", 0.5, None), (1, "a", float("nan"), True)]
    got = {(r["k"], r["outcome"]): (r["xs"], r["ys"]) for r in isotonic.fits(spark.createDataFrame(rows, "k int, outcome string, p double, y boolean").repartition(7), "k").collect()}
    assert set(got) == set(want)
    for key, (xs, ys) in want.items():
        assert got[key][0] == xs and got[key][1] == pytest.approx(ys, abs=1e-15)
    assert len(got[2, "a"][0]) < 10 < len(got[1, "b"][0])
    assert isotonic.fits(spark.createDataFrame([], "outcome string, p double, y boolean")).count() == 0


def test_query_equals_the_sequential_fit(spark):
    from strictbefore.plans.model_queries import outcome_samples

    by = {}
    for r in outcome_samples(spark, SF).groupBy("outcome", "p").agg(F.sum(F.col("y").cast("long")).alias("s"), F.count("*").alias("n")).collect():
        by.setdefault(r["outcome"], []).append((r["p"], r["s"], r["n"]))
    found = {r["outcome"]: r for r in library.QUERIES["isotonic_steps"](spark, SF).collect()}
    assert set(found) == set(by)
    for outcome, points in by.items():
        xs, ys = sequential(sorted(points))
        assert found[outcome]["xs"] == pytest.approx(xs) and found[outcome]["ys"] == pytest.approx(ys)
