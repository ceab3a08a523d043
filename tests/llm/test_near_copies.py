"""Near copies against a search of all pairs."""

import numpy as np
from pyspark.sql import functions as F

from strictbefore.llm import near_copies
from strictbefore.llm.common import keyed


def shingles(text, n=5):
    words = text.lower().split() if text.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def brute_near(texts, similarity=0.8):
    """Root of every id, and the links, of a dict of texts; documents that share no shingle aren't compared."""
    sets = {i: shingles(t or "") for i, t in texts.items()}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    links = set()
    for i, s in sets.items():
        met = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    met[j] = met.get(j, 0) + 1
        links |= {(i, j) for j, n in met.items() if n >= similarity * (len(s) + len(sets[j]) - n)}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in texts}, links


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        at = int(rng.integers(0, len(words)))
        kind = rng.integers(0, 3)
        if kind == 0:
            words[at] = f"new{rng.integers(10**6)}"
        elif kind == 1:
            words.insert(at, f"more{rng.integers(10**6)}")
        elif len(words) > 6:
            del words[at]
    return words


def test_recall_over_planted_copies(spark):
    """Copies of the table's texts with as many edits as leave four of five shingles; whole families too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r[0]: r[1] for r in docs.collect() if r[1]}
    rng, at, planted = np.random.default_rng(5), 10**6, {}
    for i, t in list(texts.items())[:400]:
        words = t.split()
        if len(words) >= 40:
            planted[at] = " ".join(edited(words, rng, max(1, len(words) // 60)))
            at += 1
    base = texts[next(i for i, t in texts.items() if len(t.split()) > 150)].split()
    for _ in range(150):
        planted[at] = " ".join(edited(base, rng, 2))
        at += 1
    texts |= planted
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    frame = keyed(frame, "row")
    made = near_copies.near_copies(frame, "row").join(frame, "row").select("doc_id", "root", "node").collect()
    own = {r["doc_id"]: r["root"] for r in made}
    root, links = brute_near(texts)
    joined = sum(a in own and own[a] == own.get(b) for a, b in links)
    print("links", len(links), "joined", joined)
    assert len(links) > 1000 and joined >= 0.97 * len(links)
    alone = [(a, b) for a, b in links if a < 10**6 <= b]
    assert sum(a in own and own[a] == own.get(b) for a, b in alone) >= 0.93 * len(alone) and len(alone) > 200
    # nothing is joined that the search doesn't join
    by_root = {}
    for i, r in own.items():
        by_root.setdefault(r, set()).add(root[i])
    assert all(len(x) == 1 for x in by_root.values())
    # the pairs differ in a few bits of the sketch
    assert all(np.unpackbits((near_copies.sketch(texts[a]) ^ near_copies.sketch(texts[b])).view(np.uint8)).sum() <= near_copies.RADIUS for a, b in alone[:200])


def test_crowded_cells_are_divided(spark):
    """Few members a cell and no deeper grids: the first member holds a family together, and what is unlike stays apart."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(words, rng, 1)), 0) for i in range(60)] + [(100 + i, " ".join(f"v{rng.integers(10**6)}" for _ in range(50)), 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = {r["doc_id"] for r in near_copies.keep_one(docs).collect()}
    assert kept == {0, *range(100, 140)}
    nodes = near_copies.sketches(keyed(docs, "key"), "key", "doc_id", "text")
    pairs = near_copies.near_pairs(nodes, most=2)
    assert pairs.count() and pairs.filter(F.col("distance") > near_copies.RADIUS).count() == 0


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(5, text), (3, text + " end"), (None, text), (None, "alone"), (7, None), (8, ""), (9, "  "), (2, "alone"), (2, "alone"), (4, "x " * 30000), (6, "one two"), (1, "one three")]
    docs = spark.createDataFrame([(i, t, "n", "g") for i, t in rows], "doc_id long, text string, node string, gone string").repartition(3)
    out = near_copies.keep_one(docs)
    assert out.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert left == sorted([(3, text + " end"), (7, None), (8, ""), (9, "  "), (2, "alone"), (4, "x " * 30000), (6, "one two"), (1, "one three")], key=str)
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def joined(spark, texts):
    """How many of a brute-force search's links the components join, and how many there are; nothing else may be joined."""
    frame = keyed(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "row")
    own = {r["doc_id"]: r["root"] for r in near_copies.near_copies(frame, "row").join(frame, "row").select("doc_id", "root").collect()}
    root, links = brute_near(texts)
    for i, r in own.items():
        assert len({root[j] for j, q in own.items() if q == r}) == 1, i
    return sum(a in own and own[a] == own.get(b) for a, b in links), len(links)


def test_texts_of_one_set_of_words(spark):
    """Pairs that differ in one word among texts of the same words in another order."""
    rng = np.random.default_rng(11)
    words, texts = [f"w{i}" for i in range(120)], {}
    for i in range(200):
        one = list(rng.permutation(words))
        texts[2 * i] = " ".join(one)
        one[int(rng.integers(0, 120))] = "other"
        texts[2 * i + 1] = " ".join(one)
    found, links = joined(spark, texts)
    assert links == 200 and found >= 195


def test_texts_of_few_words(spark):
    """Pairs of 300 words out of 40 with two edits, and a family of 60 among them."""
    rng = np.random.default_rng(12)
    texts = {}
    for i in range(200):
        one = [f"w{x}" for x in rng.integers(0, 40, 300)]
        texts[2 * i] = " ".join(one)
        for _ in range(2):
            one[int(rng.integers(0, 300))] = f"w{rng.integers(0, 40)}"
        texts[2 * i + 1] = " ".join(one)
    for k in range(60):
        one = texts[0].split()
        one[int(rng.integers(0, 300))] = f"w{rng.integers(0, 40)}"
        texts[1000 + k] = " ".join(one)
    found, links = joined(spark, texts)
    assert links >= 200 and found >= 0.97 * links


def test_cells_that_no_axis_divides(spark):
    """Texts of one word set and one set of three-word shingles: the shingle sets alone tell them apart, exactly."""
    rng = np.random.default_rng(13)
    sets = {}
    centres = [rng.integers(0, 10**6, 60) for _ in range(5)]
    for i in range(150):  # families, and members halfway between two of them
        own = set(centres[i % 5].tolist())
        for x in rng.choice(centres[i % 5], int(rng.integers(0, 9)), replace=False):
            own.discard(int(x))
            own.add(int(rng.integers(10**6, 10**7)))
        sets[i] = own
    for i in range(150, 170):
        sets[i] = set(centres[0][:30].tolist()) | set(centres[1][:30].tolist())
    cells = spark.createDataFrame([(i % 2, i) for i in sets], "cell long, node long")
    table = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "node long, shingles array<long>")
    links, pairs = near_copies.peeled(cells, table, 0.8, most=4)
    got = {(r["a"], r["b"]) for r in links.unionByName(near_copies.alike(pairs, table, 0.8)).collect()}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert got and all(jaccard(a, b) >= 0.8 for a, b in got)

    def components(pairs):
        root = {i: i for i in sets}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {i: find(i) for i in sets}

    assert components(got) == components([(a, b) for a in sets for b in sets if a < b and a % 2 == b % 2 and jaccard(a, b) >= 0.8])


def test_case_variants_and_repeats_of_few_words(spark):
    """A hundred texts that no sketch tells apart."""
    texts = {i: " ".join(("Aa" if (i >> k) & 1 else "aa") if k < 7 else "b" for k in range(40)) for i in range(100)} | {500: "aa b " * 20}
    assert joined(spark, texts)[0] == 100 * 99 // 2


def test_no_link_is_lost(spark):
    """Families in crowded cells, a footer that all texts share, short texts, and pairs whose sketches are far apart: all links, not most."""
    rng = np.random.default_rng(14)
    footer, texts = [f"f{i}" for i in range(16)], {}
    for i in range(150):  # one edit in 60 words leaves 0.8 or less over, two of three
        one = [f"w{x}" for x in rng.integers(0, 400, 50)]
        texts[3 * i] = " ".join([*one, *footer])
        texts[3 * i + 1] = " ".join([*edited(one, rng, 1), *footer])
        texts[3 * i + 2] = " ".join([*edited(one, rng, 2), *footer])
    for i in range(300):
        one = [f"v{x}" for x in rng.integers(0, 12, 24)]
        texts[1000 + 2 * i], texts[1001 + 2 * i] = " ".join(one), " ".join([*one, f"u{i}"][int(rng.integers(0, 3)) :])
    for i in range(60):  # few distinct words, all changed at the ends
        one = [f"a{i}"] * 3 + [f"b{i} c{i}"] * 20
        texts[2000 + 2 * i], texts[2001 + 2 * i] = " ".join(one), " ".join([*one, f"p{i} q{i}"])
    for options in ({}, {"radius": 0}):
        frame = keyed(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "row")
        own = {r["doc_id"]: r["root"] for r in near_copies.near_copies(frame, "row", **options).join(frame, "row").select("doc_id", "root").collect()}
        root, links = brute_near(texts)
        assert len(links) > 300 and all(a in own and own[a] == own.get(b) for a, b in links)
        assert set(own) == {x for link in links for x in link} and all(len({root[j] for j in own if own[j] == r}) == 1 for r in set(own.values()))


def test_shingles_that_crowd_come_last(spark):
    """Sections of a common stock in all texts: turns of moving, then pairs in full, against a search of all pairs."""
    rng = np.random.default_rng(15)
    stock = [[f"s{k}w{i}" for i in range(12)] for k in range(14)]
    texts = {}
    for i in range(240):
        picked = [w for k in rng.choice(14, int(rng.integers(3, 12)), replace=False) for w in stock[k]]
        texts[i] = " ".join([*picked, *(f"x{rng.integers(10**6)}" for _ in range(int(rng.integers(0, 30))))])
    for i in range(240, 300):
        texts[i] = " ".join(edited(texts[i - 240].split(), rng, int(rng.integers(1, 3))))
    frame = spark.createDataFrame(list(texts.items()), "node long, text string")
    none = spark.createDataFrame([], "a long, b long")
    firsts = near_copies.ordered_shingles(frame, "node", 5, 0.8)
    placed = firsts.select("node", "size", F.explode("shingles").alias("shingle"))
    root, links = brute_near(texts)
    assert len(links) > 40
    for crowd, turns in ((10, 3), (10, 0), (10**6, 3)):
        found = near_copies.complete(placed, none, lambda some: frame.join(some, "node").select("node", "text"), 5, 0.8, crowd, turns)
        own = {r["node"]: r["root"] for r in near_copies.components(found).collect()}
        assert set(own) == {x for link in links for x in link}, (crowd, turns)
        assert all(own[a] == own[b] for a, b in links) and all(len({root[j] for j in own if own[j] == r}) == 1 for r in set(own.values()))


def test_frequent_shingles_stand_last(spark):
    """A passage of long words in all texts and stock sections: nothing of them is among the first shingles, and all links are found whether the frequent ones fit the list or not."""
    rng = np.random.default_rng(16)
    passage, texts = [f"verylongwordofapassage{i}" for i in range(20)], {}
    for i in range(120):
        texts[2 * i] = " ".join([*(f"w{x}" for x in rng.integers(0, 10**6, 60)), *passage])
        texts[2 * i + 1] = " ".join(edited(texts[2 * i].split(), rng, 1))
    frame = spark.createDataFrame(list(texts.items()), "node long, text string").repartition(3)
    none = spark.createDataFrame([], "a long, b long")
    root, links = brute_near(texts)
    common = set(near_copies.shingle_hashes(" ".join(passage), 5).view(np.int64).tolist())
    assert len(links) >= 100
    for most in (1 << 17, 5):
        last = near_copies.often(frame.select("text"), 5, most)
        listed = {r["shingle"] for r in last.collect()}
        firsts = near_copies.ordered_shingles(frame, "node", 5, 0.8, last=last)
        if most > 5:
            assert listed > common and not any(common & set(r["shingles"]) for r in firsts.collect())
        else:
            assert listed <= common
        placed = firsts.select("node", "size", F.explode("shingles").alias("shingle"))
        for crowd in (20, 500):
            found = near_copies.complete(placed, none, lambda some: frame.join(some, "node").select("node", "text"), 5, 0.8, crowd, ends=last)
            own = {r["node"]: r["root"] for r in near_copies.components(found).collect()}
            assert set(own) == {x for link in links for x in link} and all(own[a] == own[b] for a, b in links)
            assert all(len({root[j] for j in own if own[j] == r}) == 1 for r in set(own.values()))


def test_pairs_are_made_once_or_not_at_all(spark, monkeypatch):
    """A passage among the first shingles of all texts: a pair isn't made for each shingle of it, with parity bits hardly any but links are made, and no link is lost."""
    rng = np.random.default_rng(17)
    passage, texts = [f"verylongwordofapassage{i}" for i in range(60)], {}
    for i in range(40):
        texts[i] = " ".join([*passage, *(f"w{rng.integers(10**6)}" for _ in range(40))])
    for i in range(40, 48):
        texts[i] = " ".join(edited(texts[i - 40].split(), rng, 1))
    frame = spark.createDataFrame(list(texts.items()), "node long, text string").coalesce(2)
    none = spark.createDataFrame([], "a long, b long")
    firsts = near_copies.ordered_shingles(frame, "node", 5, 0.8)
    placed = firsts.select("node", "size", F.explode("shingles").alias("shingle"))
    odd = firsts.select("node", *[F.get("parity", F.lit(k)).alias(o) for k, o in enumerate(near_copies.ODD)])
    root, links = brute_near(texts)
    assert len(links) >= 8
    made, enough = [], near_copies.enough
    monkeypatch.setattr(near_copies, "enough", lambda met, similarity: made.append(met.count()) or enough(met, similarity))
    for options, most in (({}, 4 * 48 * 47 // 2), ({"odd": odd}, 8 * len(links))):
        made.clear()
        found = near_copies.complete(placed, none, lambda some: frame.join(some, "node").select("node", "text"), 5, 0.8, 10**6, 0, **options)
        own = {r["node"]: r["root"] for r in near_copies.components(found).collect()}
        assert set(own) == {x for link in links for x in link} and all(own[a] == own[b] for a, b in links)
        assert 0 < sum(made) <= most


def test_parity_bits_of_any_sets():
    """Parity bits differ in no more bits than the sets in hashes, of any size."""
    rng = np.random.default_rng(18)
    for n, d in ((3, 0), (40, 9), (400, 88), (5000, 700), (5000, 5000)):
        whole = rng.integers(0, 1 << 63, n + d, dtype=np.uint64)
        a, b = whole[:n], np.concatenate([whole[d // 2 : n], whole[n:]])
        bits = np.unpackbits((near_copies.parity(a) ^ near_copies.parity(b)).view(np.uint8)).sum()
        assert bits <= len(set(a.tolist()) ^ set(b.tolist())) and (bits > 0) == (d > 0)
