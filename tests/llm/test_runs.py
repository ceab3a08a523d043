"""Periodic runs against brute force, and odd tables."""

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strictbefore.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute(ids):
    """Every stretch of smallest period q with enough words that can't be extended."""
    n, out = len(ids), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)  # q grows: the smallest stays
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def test_overlap_is_the_least_one():
    assert runs.overlap() == 5 == min(max(6, 4 * q) - q for q in range(1, 1000))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 9)), max_size=10))
def test_runs_equal_brute_force(parts):
    ids = [x for word, times in parts for x in word * times]
    assert runs.runs(np.array(ids, np.int64)) == brute(ids)


def test_long_runs_over_many_divisions():
    rng = np.random.default_rng(5)
    for _ in range(30):
        ids = np.concatenate([np.tile(rng.integers(0, 3, rng.integers(1, 40)), rng.integers(1, 30)) for _ in range(6)])
        assert runs.runs(ids) == brute(ids.tolist())
    assert runs.runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert runs.runs(np.arange(100_000)) == []


def expected(doc_id, text, rewrite):
    words = [w for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if rewrite and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    ids = {w: k for k, w in enumerate(set(words))}
    got = brute([ids[w] for w in words])
    gone = {i for a, m, q in got for i in range(a + q, a + m)}
    top = min(got, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id, len(got), *(top or (None,) * 3), top and 1000 * top[1] // top[2], hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in got).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_odd_tables(spark):
    texts = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3, "x y z " * 4 + "q", "ä ö " * 7, "a " * 30_000 + "b", "long words " * 3, "A a A a A a A a"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "a " * 9, 7), (None, None, 7), (3, "b " * 8, 7), (3, "b " * 8, 7)] + [(i, " ".join(f"w{j * j % 97}" for j in range(120)), 7) for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    for rewrite in (True, False):
        got = sorted((tuple(r)[:8] for r in runs.find(docs, rewrite=rewrite).collect()), key=str)
        assert [r for r in got if r[0] != 10] == sorted((expected(i, t, rewrite) for i, t, _ in rows if i != 10), key=str)
        assert [r[1:6] for r in got if r[0] == 10] == [(1, 0, 30_000, 1, 30_000_000)]
    assert runs.find(docs.limit(0)).count() == 0
    kept = {r["id"]: (r["collapsed"], [tuple(x) for x in r["runs"]]) for r in runs.find(docs).filter("id in (5, 8)").collect()}
    assert kept == {5: ("a", [(0, 6, 1)]), 8: ("x y z q", [(0, 12, 3)])}


def test_query_against_brute_force(spark):
    docs = {(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len((r["text"] or "").split()) < 1500}
    got = {tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    want = {expected(i, t, True) for i, t in docs}
    assert len(want) > 150 and want <= got and sum(r[1] > 0 for r in want) > 5
