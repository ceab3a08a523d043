"""The Pitman-Yor model against brute force: seats, probabilities, base scores, and odd tables."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strictbefore.llm import pitman_yor as py

SF = "/root/testdata/sf0.001"


def seated_one_by_one(c, others, parent, theta, d, steps, rng):
    """Gibbs by customers: each leaves its table and sits down again."""
    sizes, total, seen = [c], 0, 0
    for step in range(steps):
        k = rng.choice(len(sizes), p=np.array(sizes) / c)
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
        chance = np.array([n - d for n in sizes] + [(theta + d * (others + len(sizes))) * parent])
        k = rng.choice(len(chance), p=chance / chance.sum())
        if k == len(sizes):
            sizes.append(1)
        else:
            sizes[k] += 1
        if step >= steps // 10:
            total, seen = total + len(sizes), seen + 1
    return total / seen


@pytest.mark.parametrize("c, others, parent, theta, d", [(2, 5, 0.1, 1.0, 0.7), (6, 40, 0.2, 1.0, 0.5), (20, 300, 0.05, 0.5, 0.8)])
def test_tables_follow_the_customers_gibbs_sampler(c, others, parent, theta, d):
    rng = np.random.default_rng(1)
    drawn = py.draw_tables(np.full(20_000, c), np.full(20_000, others), np.full(20_000, parent), theta, d, rng)
    assert drawn.min() >= 1 and drawn.max() <= c
    assert drawn.mean() == pytest.approx(seated_one_by_one(c, others, parent, theta, d, 30_000, rng), rel=0.05)


@pytest.mark.parametrize("c, others, parent, d", [(60, 5, 0.001, 0.7), (200, 100, 0.01, 0.5), (400, 2000, 0.05, 0.8), (400, 10, 0.5, 0.6), (300, 1000, 1e-5, 0.9)])
def test_large_dishes_follow_the_exact_conditional(c, others, parent, d):
    chances = py.log_chances(py.stirling(d, c), c, np.array([float(others)]), np.array([parent]), 1.0, d)[0]
    exact = np.exp(chances - chances.max())
    exact /= exact.sum()
    t = np.arange(1, c + 1)
    mean = (exact * t).sum()
    deviation = math.sqrt((exact * t * t).sum() - mean**2)
    drawn = py.draw_tables(np.full(20_000, c), np.full(20_000, others), np.full(20_000, parent), 1.0, d, np.random.default_rng(2))
    assert abs(drawn.mean() - mean) <= 0.1 * (mean - 1) + 0.25 * deviation + 0.02
    assert drawn.std() == pytest.approx(deviation, rel=0.35, abs=0.05)  # first order: the spread may be a third off


def test_packing():
    arrays = [np.arange(5, dtype=np.int64), np.array([], np.uint64), np.array([2**64 - 1, 0], np.uint64), np.array([1.5, -0.0]), np.array([True, False]).astype(np.uint8), np.arange(7, dtype=np.int32)]
    back = py.unpack(py.pack(*arrays))
    assert all((a == b).all() and a.dtype == b.dtype and len(a) == len(b) for a, b in zip(arrays, back, strict=True))


def words_of(text):
    return [*("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()), None]


def code(word):
    return py.END if word is None else xxhash.xxh64_intdigest(word, py.SEED)


def trains(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 0, 2.0) for i, t in rows], "doc_id long, text string, file int, at int, score double").repartition(3)


ROWS = [(i, " ".join(f"w{(i * j + j * j) % (5 + i % 7)}" for j in range(i % 40))) for i in range(150)]
ROWS += [(200, None), (201, ""), (202, " \t"), (203, "Ä B"), (203, "Ä B"), (None, "w1 w2"), (None, None), (204, "lone " * 700), (205, "never seen before w1"), (206, "\x0bw1\x0cw2")]
ROWS += [(next(i for i in range(300, 400) if not trains(i)), "quite unknown w1 w2")]


def expected_base(rows):
    c = Counter(w for i, t in rows if trains(i) for w in words_of(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        ws = words_of(t)
        out.append((i, not trains(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)))
    return sorted(out, key=str)


def test_counts_and_odd_tables(spark):
    got = py.score(table(spark, ROWS)).collect()
    assert sorted(((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == expected_base(ROWS)
    assert all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert py.score(table(spark, ROWS).limit(0)).count() == 0
    out = [i for i in range(300) if not trains(i)][:2]
    alone = py.score(table(spark, [(i, "a b") for i in out])).collect()  # nothing to learn from
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in alone] == [(0, 0, 0.0, 0.0)] * 2


def test_scores_equal_the_formula_over_the_sampled_seats(spark):
    """The distributed sums against dictionaries, and every context's distribution against one."""
    py.bounded_batches(spark)
    parts = 3
    docs = py.keyed(table(spark, ROWS), "row")
    rows = docs.select(*[F.col("row")[k].alias(k) for k in py.KEYS], (~py.held_out(F.col("doc_id"))).alias("train"), "text", "doc_id")
    hot = np.array([code(b"w1"), code(b"lone"), py.START], np.uint64)  # spread over all ranges
    m = py.fit(rows.drop("doc_id"), hot, parts, 1, 3, 1.0)
    c, t = Counter(), defaultdict(float)
    for r in m.ranges.collect():
        own = py.Range(r["grams"], r["words"], r["hot"])
        extra = sum(py.unpack(next(x for x in s.collect() if x["part"] == r["part"])["extra"])[0] for s in m.states) / 3
        seated = (own.c > 0).astype(float)
        seated[own.live] += extra
        heads = {}
        for u, w, n, k in zip(own.u, own.w, own.c, seated, strict=True):
            heads.setdefault(int(u), []).append((int(own.words[w]), int(n), k))
        m_heads = context_keys(rows, hot, parts, r["part"])
        for u, dishes in heads.items():
            for w, n, k in dishes:
                c[m_heads[u], w] += n
                t[m_heads[u], w] += k
    true = Counter()
    for i, text in ROWS:
        ws = [code(w) for w in words_of(text)]
        if trains(i):
            true.update(zip([py.START, *ws[:-1]], ws, strict=True))
    assert {k: n for k, n in c.items() if n} == dict(true)
    root = {}
    for r in py.answers(m.words, m.roots, m.v, m.d_root, 1.0, True).collect():
        for s in r["sent"]:
            p, n = py.unpack(s["data"])
            own = m.ranges.filter(F.col("part") == s["other"]).first()
            one = py.Range(own["grams"], own["words"], own["hot"], m.keepers)
            a, b = one.cuts[r["keeper"]], one.cuts[r["keeper"] + 1]
            root.update({int(w): (x, int(k)) for w, x, k in zip(one.words[a:b], p, n, strict=True)})
    unknown = next(p for p, n in root.values() if not n)
    assert sum(p for p, n in root.values() if n) + unknown == pytest.approx(1)
    customers, tables = Counter(), Counter()
    for (u, w), n in c.items():
        customers[u] += n
        tables[u] += t[u, w]
    chance = lambda u, w: (c.get((u, w), 0) - m.d * t.get((u, w), 0) + (1 + m.d * tables[u]) * root.get(w, (unknown, 0))[0]) / (1 + customers[u])
    known = [w for w, (_, n) in root.items() if n]
    for u in customers:
        assert sum(chance(u, w) for w in known) + chance(u, -1) == pytest.approx(1)
    per = py.added_up(py.scored(m, py.answers(m.words, m.roots, m.v, m.d_root, 1.0, True)))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 6)) for r in rows.join(per, list(py.KEYS)).select("doc_id", "score").collect())
    want = []
    for i, text in ROWS:
        ws = [code(w) for w in words_of(text)]
        want.append((i is None, i or 0, round(sum(math.log10(chance(u, w)) for u, w in zip([py.START, *ws[:-1]], ws, strict=True)), 6)))
    assert got == sorted(want)


def context_keys(rows, hot, parts, part):
    """The contexts of a range in their order, from the pairs that were sent to it."""
    keys = set()
    for r in py.pairs(rows.drop("doc_id"), parts, hot).filter(F.col("part") == part).collect():
        keys |= set(py.unpack(r["packed"])[2].tolist())
    return sorted(keys)


def test_query_learns_and_its_base_is_exact(spark):
    from strictbefore.llm import queries

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op12_pitman_yor"](spark, SF).collect()
    got.sort(key=lambda r: r["doc_id"])
    want = sorted(expected_base(rows))
    assert [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [x[:5] for x in want]
    assert [r["base_score"] for r in got] == pytest.approx([x[5] for x in want], abs=1e-5)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
