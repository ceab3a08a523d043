import re

import numpy as np
import pytest
import xxhash

from strictbefore.llm import simhash


def brute_fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (id, fingerprint); roots by union-find over all pairs."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return {f: least.get(find(f)) for f in fps}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One TWO", "a b c", "a  b\tc d", "É é X", "x " * 500, "\x1c a \x1f b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_steps_change_nothing(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500))
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_embedding_bounds_the_distance_and_cells_meet(spark):
    rng = np.random.default_rng(0)
    masks = simhash.cells(2)
    assert len(masks) == 6

    def emb(x):
        return sum((0, 1, 3)[(x >> 2 * s & 3).bit_count()] << 2 * s for s in range(32))

    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, 2, replace=False):
            b ^= 1 << int(bit)
        assert (emb(a) ^ emb(b)).bit_count() <= 2
        assert any(emb(a) & m % (1 << 64) == emb(b) & m % (1 << 64) for m in masks)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    values = [int(rng.integers(0, 1 << 63)) * 2 + 1 for _ in range(50)]
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long").select("fp", simhash.embedding(simhash.F.col("fp")).alias("e"))
    assert {r["fp"] % (1 << 64): r["e"] % (1 << 64) for r in frame.collect()} == {v: emb(v) for v in values}


@pytest.mark.parametrize("cell", [65, 1])
def test_components_equal_all_pairs(spark, cell):
    rng = np.random.default_rng(1)
    fps = set()
    for _ in range(12):  # chains and clouds around a few centres
        at = int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(1, 30))):
            fps.add(at)
            for bit in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                at ^= 1 << int(bit)
    fps |= {0, 3, (1 << 64) - 1}
    fps = sorted(fps)
    rows = [(i, f) for i, f in enumerate(fps)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    points = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = simhash.links(points, 2, cell).collect()
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 2 for r in edges)
    rank = {signed(f): i for i, f in rows}
    ranked = spark.createDataFrame([(rank[r["a"]], rank[r["b"]]) for r in edges], "a long, b long")
    found = simhash.components(ranked).collect()
    roots = {r["node"]: r["root"] for r in found}
    assert len(found) == len(roots)
    want = brute_components(rows)
    assert {i: roots.get(i, i) for i, _ in rows} == {i: want[f] for i, f in rows}


def test_documents_with_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(300))
    near = base + " extra"
    rows = [(5, base), (3, near), (9, near), (None, base), (None, "alone here now then"), (7, None), (8, ""), (4, "  "), (7, None), (1, "x " * 20000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r["id"] is None, r["id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    want = brute_components(fps)
    assert got == sorted(((i is None, i or 0, f"{f:016x}", want[f]) for i, f in fps), key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_over_the_table(spark):
    from strictbefore.llm import queries

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op4_simhash_components"](spark, sf).collect()}
    fps = [(r["doc_id"], brute_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_components(fps)
    assert got == {i: (f"{f:016x}", want[f]) for i, f in fps}
