"""Clustering by differences against Lloyd's rounds in plain Python, and odd vectors."""

import hashlib
import math

import numpy as np

from strictbefore.llm import delta_lloyd


def brute(rows, dims, k, rounds, salt=3, scale=1024):
    """Every vector against every centroid, every round."""
    kept = [(i, [math.floor(float(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centres = [q for _, q in start[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda q: min((apart(q, c), j) for j, c in enumerate(centres))
    for _ in range(rounds if centres else 0):
        own = [best(q)[1] for _, q in kept]
        for j in range(len(centres)):
            mine = [q for (_, q), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *best(q)[::-1]) for i, q in kept] if centres else []
    per = {j: sum(d for _, c, d in last if c == j) for j in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, per[c], sum(per.values()), digest[c]) for i, c, d in last), key=str)


def got(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 1, 2, "q") for i, v in rows], "vec_id long, embedding array<float>, cluster int, at int, q string").repartition(3)
    return sorted((tuple(r) for r in delta_lloyd.clusters(table, **options).collect()), key=str)


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) + 2 * (i % 5)).astype(np.float32).tolist()) for i in range(300)]
    for k, rounds in ((8, 10), (3, 2), (1, 1)):
        assert got(spark, rows, dims=4, k=k, rounds=rounds) == brute(rows, 4, k, rounds)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, None), (1, []), (2, [1.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [0.5, -0.5]), (6, [0.5, -0.5]), (None, [0.25, 0.0]), (7, [-0.0001, 0.0]), (8, [0.25, 0.0]), (9, [0.25, 0.0]), (10, [5.0, 5.0])]
    assert got(spark, rows, dims=2, k=8) == brute(rows, 2, 8, 10)
    assert got(spark, rows, dims=2, k=2) == brute(rows, 2, 2, 10)
    same = [(i, [0.5, 0.5]) for i in range(40)]  # ties: one cluster takes all, seven stay empty
    assert got(spark, same, dims=2) == brute(same, 2, 8, 10)
    assert got(spark, rows[:6], dims=2) == [] and got(spark, [(None, [1.0, 2.0])], dims=2) == []
    assert got(spark, [], dims=2) == []
    wide = got(spark, [(1, [3e38, -3e38]), (2, [0.0, 0.0])], dims=2, k=1)
    assert len(wide) == 2 and all(0 <= r[2] < 1 << 63 for r in wide)


def test_only_differences_are_computed():
    rng = np.random.default_rng(4)
    q = np.concatenate([rng.integers(-20, 20, (400, 6)) + 1000 * c for c in range(8)])
    centres = np.stack([q[400 * c] for c in range(8)])
    cluster, distance, first = delta_lloyd.nearest(q, np.full(len(q), -1), np.zeros(len(q), np.int64), centres, np.ones(8, bool))
    assert first == len(q) * 8
    moved = centres.copy()
    moved[2] += 3
    changed = (moved != centres).any(1)
    again = delta_lloyd.nearest(q, cluster, distance, moved, changed)
    whole = delta_lloyd.nearest(q, np.full(len(q), -1), np.zeros(len(q), np.int64), moved, np.ones(8, bool))
    assert (again[0] == whole[0]).all() and (again[1] == whole[1]).all()
    assert again[2] == 400 * 8 + 2800  # the changed cluster's vectors with all, the rest with one centroid
    assert delta_lloyd.nearest(q, whole[0], whole[1], moved, np.zeros(8, bool))[2] == 0


def test_rounds_move_no_vectors(spark):
    """Vectors and assignments meet without a shuffle."""
    rows = [(i, [i / 7, -i / 3], 1) for i in range(50)]
    points = delta_lloyd.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int"), "vec_id", "embedding", 2, 1024)
    a, b = (delta_lloyd.bucketed(points.select(*delta_lloyd.KEYS, c), f"test_{c}", 4, *delta_lloyd.KEYS) for c in ("id", "q"))
    joined = a.join(b.hint("merge"), list(delta_lloyd.KEYS))
    assert joined.count() == 50 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    for t in (a, b):
        delta_lloyd.forget(t)
