"""The similarity join against all pairs, and the bound it stands on."""

import difflib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strictbefore.operators import similarity
from strictbefore.plans import library


def plain(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@settings(max_examples=1500, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.sampled_from([0.7, 0.8, 0.85, 0.95]))
def test_alike_texts_share_enough_pairs(a, b, least):
    if a and b and plain(a, b) >= least:
        bag = lambda t: Counter(t[i : i + 2] for i in range(len(t) - 1))
        assert (bag(a) & bag(b)).total() >= similarity.must_share(len(a), len(b), least)
        assert min(len(a), len(b)) >= max(len(a), len(b)) * least / (2 - least) - 1e-9
        # too short to have to share a pair: equal
        assert a == b or (bag(a) & bag(b)).total() >= 1


def variants(rng, n):
    base = ["".join(rng.choice(list("abdegilnorst "), int(rng.integers(4, 22)))).strip() or "x" for _ in range(n)]
    out = list(base)
    for b in base:
        t = list(b)
        for _ in range(int(rng.integers(1, 4))):
            at = int(rng.integers(0, len(t)))
            t[at : at + 1] = [rng.choice(list("aeiou")), *t[at : at + 1]][: int(rng.integers(0, 3))]
        out.append("".join(t))
    return base, out


@pytest.mark.parametrize("least", [0.7, 0.85, 1.0])
def test_all_pairs_are_found(spark, least):
    rng = np.random.default_rng(3)
    left, right = variants(rng, 220)
    left += ["", "a", "ab", "ää ü", "aaaaaaaaaaaa", "ab" * 9]
    right += ["", "a", "b", "ab", "ba", "ää u", "aaaaaaaaaaa", "ab" * 8]
    a = spark.createDataFrame([(i % 2, t) for i, t in enumerate(left)] * 2 + [(0, None)], "k int, name string")
    b = spark.createDataFrame([(i % 2, t) for i, t in enumerate(right)] + [(0, None)], "k int, other string")
    found = {(r["k"], r["name"], r["other"], round(r["ratio"], 9)) for r in similarity.similar(a, b, "name", "other", least, ["k"]).collect()}
    want = {(i % 2, x, y, round(plain(x, y), 9)) for i, x in enumerate(left) for j, y in enumerate(right) if i % 2 == j % 2 and x and y and plain(x, y) >= least}
    assert found == want and len(want) > 20


def test_bounds_of_the_threshold(spark):
    rows = spark.createDataFrame([("a",)], "name string")
    for bad in (0.5, 2 / 3, 1.1):
        with pytest.raises(ValueError):
            similarity.similar(rows, rows, "name", "name", bad)
    assert similarity.similar(rows.limit(0), rows.withColumnRenamed("name", "other"), "name", "other").count() == 0


def test_query_against_brute_force(spark):
    from strictbefore.plans.stream_queries import named_sides

    sf = "/root/testdata/sf0.001"
    left, right = ({(r["c_nationkey"], r[c]) for r in side.collect()} for side, c in zip(named_sides(spark, sf), ("c_name", "s_name"), strict=True))
    found = {(r["c_nationkey"], r["c_name"], r["s_name"]): r["ratio"] for r in library.QUERIES["similar_names"](spark, sf).collect()}
    assert found == {(n, x, y): pytest.approx(plain(x, y)) for n, x in left for m, y in right if n == m and plain(x, y) >= 0.7} and found


@pytest.mark.parametrize("least", [0.7, 0.8])
def test_short_texts_without_a_common_pair(spark, least):
    """Ratio 0.75 or more by single characters alone, beside all short texts of two letters."""
    some = ["aaa", "ababa", "abc", "axbxc", "a", "ab", "ba", "aba", "aa", "bab", "abababab", "aaaa", "acacaca"]
    left = spark.createDataFrame([(t,) for t in some], "name string")
    found = {(r["name"], r["other"]) for r in similarity.similar(left, left.withColumnRenamed("name", "other"), "name", "other", least).collect()}
    assert found == {(x, y) for x in some for y in some if plain(x, y) >= least}
    assert least > 0.75 or ("aaa", "ababa") in found


@pytest.mark.parametrize("least", [0.7, 0.9])
@pytest.mark.parametrize("by_tokens", [False, True])
def test_blocks_and_tokens_find_the_same(spark, monkeypatch, least, by_tokens):
    """Several blocks a key, texts of up to 300 characters, one and no keys: what blocks compare and what tokens bring together."""
    monkeypatch.setattr(similarity, "BLOCK", 40)
    if by_tokens:
        monkeypatch.setattr(similarity, "BLOCK_PAIRS", 0)
        monkeypatch.setattr(similarity, "PER_ROW", 0)
    rng = np.random.default_rng(5)
    _, some = variants(rng, 60)
    long = ["".join(rng.choice(list("abcdefghij é\U0001f600"), int(n))) for n in (63, 64, 65, 70, 120, 199, 260, 300)]
    some += [x for t in long for x in (t, t[:7] + "q" + t[9:], t[5:], t + "zz")] + ["x", "xx", "a" * 64, "a" * 70]
    rows = spark.createDataFrame([(i % 2, t) for i, t in enumerate(some)] + [(i % 2, t[::-1]) for i, t in enumerate(some)] + [(None, "null key")], "k int, name string")
    other = spark.createDataFrame([(i % 2, t) for i, t in enumerate(some[::-1])] + [(None, "null key")], "k int, other string")
    left, right = {tuple(r) for r in rows.collect()}, {tuple(r) for r in other.collect()}
    found = {tuple(r) for r in similarity.similar(rows, other, "name", "other", least, ["k"]).collect()}
    assert found == {(k, x, y, plain(x, y)) for k, x in left for m, y in right if k is not None and k == m and plain(x, y) >= least} and len(found) > 40
    found = {tuple(r) for r in similarity.similar(rows, other, "name", "other", least).collect()}
    assert found == {(x, y, plain(x, y)) for _, x in left for _, y in right if plain(x, y) >= least}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abcé ", min_size=1, max_size=70), min_size=1, max_size=6), st.lists(st.text("abcé ", min_size=1, max_size=70), min_size=1, max_size=6), st.sampled_from([0.67, 0.7, 0.85, 1.0]))
def test_candidates_hold_all_pairs(a, b, least):
    held = {(i, j) for one, other in similarity.candidates(a, b, least) for i, j in zip(one.tolist(), other.tolist(), strict=True)}
    assert held >= {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if plain(x, y) >= least}


def test_names_that_share_a_pair_of_characters_are_not_compared_one_by_one():
    """A third of the names of ten characters share a pair of neighbours; the ratio is asked for few of all pairs."""
    rng = np.random.default_rng(7)
    a, b = (["".join(rng.choice(list("bdfgklmnprstvzao"), 8)) + end for _ in range(400)] for end in (" FC", " SC"))
    assert sum(len(one) for one, _ in similarity.candidates(a, b, 0.7)) < 400 * 400 / 50
