"""Odd rows for the operators whose queries are compared with SQL: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strictbefore.llm import chat, exact_dedup, lang_id, mixing, token_counts, topk, url_filter

LONG = "long words " * 20000


# exact dedup

DOCS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "ab "), (5, None), (6, ""), (7, " \t\n"), (8, "c"), (8, "c"), (9, LONG), (10, LONG), (None, "ab"), (None, "z"), (11, "A b"), (12, "a\x0bb\x0c")]


def brute_dedup(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((i, t or ""))
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        kept = False
        for m in sorted(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0)):
            out.append((m[0], best[0], len(members), not kept, hashlib.sha256(text.encode()).hexdigest()))
            kept = True
    return sorted(out, key=str)


@pytest.mark.parametrize("counters", [1024, 1, 3])
def test_exact_dedup(spark, counters):
    docs = spark.createDataFrame([(i, t, 0) for i, t in DOCS], "doc_id long, text string, digest int").repartition(3)
    got = sorted((tuple(r) for r in exact_dedup.decide(docs, counters=counters).collect()), key=str)
    assert got == brute_dedup(DOCS)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    # a row without an id is held to its text like any other, and of rows that repeat an id and a text one stays
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in brute_dedup(DOCS) if r[3])
    assert exact_dedup.decide(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=200), st.integers(1, 4))
def test_misra_gries_bounds(keys, counters):
    kept, true = exact_dedup.misra_gries(iter(keys), counters), Counter(keys)
    assert len(kept) <= counters
    for k, n in true.items():
        assert n - len(keys) / (counters + 1) <= kept.get(k, 0) <= n


# mixing

def test_mixing(spark):
    rows = [(i, "w " * (i % 50 + 1), f"s{i % 4}") for i in range(400)] + [(1000, None, "s0"), (1001, "", None), (1002, "x y", None), (1002, "x y", None), (1003, LONG, "big"), (None, "q", "s1")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, first int")
    for block in (mixing.BLOCK, 7):
        got = mixing.mix(docs, block=block).collect()
        assert len(got) == len(rows)
        per = {}
        for r in got:
            s = per.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
            s[0] += r["size"]
            s[1] += r["taken"]
            assert 0 <= r["taken"] <= 3 * r["size"]
        total = sum(s[0] for s in per.values())
        assert sum(s[2] for s in per.values()) == pytest.approx(total)
        for size, taken, target, said in per.values():
            assert size == said and target <= 3 * size + 1e-9 and abs(taken - target) <= 0.5
        again = mixing.mix(docs.repartition(5), block=block).collect()
        key = lambda r: (r["id"] or -1, r["size"], r["taken"])
        assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_documents_are_what_was_taken(spark):
    rows = [(i, "\n".join(f"d{i}w{k}  x" for k in range(i % 40 + 1)), f"s{i % 5}", 7, "row") for i in range(300)]
    rows += [(3, rows[3][1], "s3", 0, "again"), (None, "no id here", "s1", 0, ""), (None, "no id here", "s1", 0, ""), (None, None, None, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, row string")
    taken = Counter()
    for r in mixing.mix(docs, block=32).collect():
        taken[r["id"]] += r["taken"]
    out = mixing.mixed_documents(docs, block=32, shard_slots=4)
    assert out.columns == docs.columns
    words, texts = Counter(), {r[0]: r[1] for r in rows if r[1]}
    for r in out.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
        assert len(r["text"]) < len(texts[r["doc_id"]]) or r["text"] == texts[r["doc_id"]]
    assert +taken == words and sum(words.values()) > 1000
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_permutations(spark):
    seen = set()
    for n in (1, 2, 7, 1000, 4096):
        for key in ("a", "b"):
            got = [r[0] for r in spark.range(n).select(mixing.shuffled(F.col("id"), F.lit(n), F.lit(key))).collect()]
            assert sorted(got) == list(range(n))
            seen.add(tuple(got))
        if n >= 1000:  # neighbours part, and two keys agree in about one place
            assert abs(np.corrcoef(got[:-1], got[1:])[0, 1]) < 0.1 and abs(np.mean(np.abs(np.diff(got))) - n / 3) < n / 20
    assert len(seen) >= 8


def test_shards_are_draws_without_replacement(spark):
    """Counts of a shard's sources have the mean and variance of the hypergeometric law, and shards don't follow one another."""
    takes, shard = [13_000, 20_000, 27_000], 256
    quota = spark.createDataFrame([(i + 1, n, n // 2, n, 64, sum(takes[:i]), sum(takes)) for i, n in enumerate(takes)], "place int, take long, blocks long, words long, last_words long, start long, slots long")
    made = mixing.slots(quota, 64, shard)
    rows = made.groupBy("shard", "place").count().collect()
    assert made.select("slot").distinct().count() == sum(takes) == made.count()
    shards = sum(takes) // shard
    counts = np.zeros((shards + 1, 3))
    for r in rows:
        counts[r["shard"], r["place"] - 1] = r["count"]
    counts = counts[:shards]
    for place, n in enumerate(takes):
        p = n / sum(takes)
        variance = shard * p * (1 - p) * (sum(takes) - shard) / (sum(takes) - 1)
        assert abs(counts[:, place].mean() - shard * p) < 4 * (variance / shards) ** 0.5
        assert 0.7 < counts[:, place].var() / variance < 1.4  # five deviations of a variance of 234 draws
        assert abs(np.corrcoef(counts[:-1, place], counts[1:, place])[0, 1]) < 0.25
    # every block is used once in each of the two passes
    used = made.groupBy("place", "pass").agg(F.count_distinct("block").alias("d"), F.count("*").alias("n")).collect()
    assert all(r["d"] == r["n"] == takes[r["place"] - 1] // 2 for r in used) and len(used) == 6


# top-k

def brute_topk(rows, k=10, scale=1024):
    good = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({i: min(v for j, v in good if j == i) for i, _ in good if i % 100 == 0}.items()):
        scores = [(-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(b) == len(a)]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(12).tolist()) for i in range(350)] + [(1000 + i, [0.5] * 12) for i in range(40)] + [(2000, [0.5] * 12), (400, None), (500, []), (600, [float("nan")] * 12), (700, [None] * 12), (800, [1.0] * 5), (801, [2.0] * 5), (None, [1.0] * 12), (3, [9.0] * 12)]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double").repartition(5)
    got = sorted(tuple(r) for r in topk.search(frame, frame.filter("vec_id % 100 = 0"), "vec_id", "embedding", query_block=2).collect())
    assert got == brute_topk(rows)
    assert topk.search(frame.limit(0), frame.limit(0), "vec_id", "embedding").count() == 0


def test_topk_of_huge_components(spark):
    rows = [(0, [1e9, -3e12]), (1, [2e9, 5.0]), (2, [-1e9, 7.5]), (3, [1.0, 1.0]), (100, [0.25, 3e7])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(frame, frame.filter("vec_id % 100 = 0"), "vec_id", "embedding").collect())
    assert got == [(q, n, i, min(max(s, topk.LEAST), topk.MOST)) for q, n, i, s in brute_topk(rows)]


# chat

def test_chat_parts_and_escapes(spark):
    part = "struct<kind:string,text:string,ref:string,tokens:int>"
    rows = [
        (1, 1, "assistant", [("text", "see <image:0> \\l", None, None), ("image", None, "b", 3)]), (1, 0, "user", [("image", None, "a", None), ("text", "x", None, None), ("audio", None, "c", None)]),
        (2, 0, "us<er", [("text", "\\### </turn>\n<turn assistant>", None, None)]), (2, None, None, None), (3, 300, "assistant", [("text", None, None, None)]), (3, 1, "assistant", [("text", "é" * 9, None, None)]),
    ]
    frame = spark.createDataFrame(rows, f"c long, t long, r string, p array<{part}>")
    got = {(r["conv"], r["chunk"]): r for r in chat.format_parts(frame, "c", "t", "r", "p").collect()}
    one = got[(1, 0)]
    assert one["formatted"] == "<turn user>\n<image:0>x<audio:1></turn>\n<turn assistant>\nsee \\limage:0> \\bl<image:2></turn>\n"
    assert [(a["placeholder"], a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [(0, "image", "a", 256), (1, "audio", "c", 128), (2, "image", "b", 3)] and one["expanded_tokens"] == 387
    (span,) = one["loss_spans"]
    assert one["formatted"][span["start"] : span["start"] + span["length"]] == "see \\limage:0> \\bl<image:2>"
    turns = chat.format_parts(frame, "c", "t", "r", "p").filter("conv = 2").select("chunk", chat.turns_of(F.col("formatted")).alias("t")).collect()
    assert {(t["role"], t["text"]) for r in turns for t in r["t"]} == {("us<er", "\\### </turn>\n<turn assistant>"), ("", "")}
    assert set(got) == {(1, 0), (2, 0), (2, None), (3, 0), (3, 1)}


def test_chat_read_back_against_python(spark):
    rows = [(1, 2, "assistant", "b<\\"), (1, 1, "user", None), (1, 1, "user", None), (1, 600, "assistant", "z\n"), (None, 0, "assistant", "n"), (2, 5, None, ">\n")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_texts(frame)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([(t, r or "", x or "") for c, t, r, x in rows if c == conv])
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_texts(frame.limit(0))).count() == 0


# URL filter

def test_url_filter(spark, monkeypatch):
    log = [("example.com", "a", "2024-01-10", True), ("example.com", "a", "2024-01-20", False), ("x.org/p/q", "b", "2024-01-01", True), ("x.org/p/q", "b", "2024-01-01", False), ("x.org/p", "c", "2024-01-05", True), ("x.org/p", "c", "2024-01-06", True), (None, "d", "2024-01-01", True)]
    entries = spark.createDataFrame(log, "key string, list string, at string, added boolean")
    shots = [(1, "http://www.Sub.Example.com:80/a", "2024-01-10"), (2, "http://example.com/", "2024-01-09"), (3, "http://example.com", "2024-01-20"), (4, "https://u@x.org/p/q/r?x", "2024-02-01"), (5, "https://x.org/pq", "2024-02-01"), (6, None, "2024-02-01"), (7, "nonsense", "2024-02-01"), (8, "http://example.com/", None), (1, "http://www.Sub.Example.com:80/a", "2024-01-10"), (9, "http://notexample.com/", "2024-01-12")]
    frame = spark.createDataFrame([(*s, "k") for s in shots], "page_id long, url string, at string, key string")
    got = [(r["id"], r["blocked"], r["lists"], r["key"]) for r in url_filter.evaluate(frame, url_filter.intervals(entries), "page_id", "url", "at").orderBy("id").collect()]
    free = (False, [], None)
    assert got == [(1, True, ["a"], "example.com")] * 2 + [(2, *free), (3, *free), (4, True, ["c"], "x.org/p"), *[(i, *free) for i in (5, 6, 7, 8, 9)]]
    monkeypatch.setattr(url_filter, "LIST_ROWS", 0)
    monkeypatch.setattr(url_filter, "COMMON", 5)  # hot keys and others, by shuffle
    crowd = frame.unionByName(spark.range(500).selectExpr("100 + id", "concat('http://s', id, '.example.com/')", "'2024-01-11'", "'k'").toDF("page_id", "url", "at", "key"))
    again = url_filter.evaluate(crowd, url_filter.intervals(entries), "page_id", "url", "at")
    assert [(r["id"], r["blocked"], r["lists"], r["key"]) for r in again.filter("id < 100").orderBy("id").collect()] == got
    assert again.filter("id >= 100 and blocked and key = 'example.com'").count() == 500
    none = url_filter.intervals(entries.limit(0))
    assert url_filter.evaluate(frame, none, "page_id", "url", "at").filter("blocked").count() == 0
    assert url_filter.evaluate(frame.limit(0), url_filter.intervals(entries), "page_id", "url", "at").count() == 0


# token counts

def viterbi(run, scores):
    text = token_counts.MARK + run
    best = [(0, 0)]
    for n in range(1, len(text) + 1):
        cost = len(text[n - 1].encode())
        options = [(best[n - 1][0] - token_counts.UNKNOWN * cost, -(best[n - 1][1] + cost))]
        options += [(best[k][0] + scores[text[k:n]], -(best[k][1] + 1)) for k in range(n) if text[k:n] in scores]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.piece_scores(path)
    own = token_counts.Trie(scores)
    runs = ["hello", "hell", "he", "world,", "日本語", "ééé", "😀", "x" * 300, "antidisestablishmentarianism", "hello"]
    assert [own[r] for r in runs] == [viterbi(r, scores) for r in runs]
    nodes = len(own.best)
    assert own["hel"] == viterbi("hel", scores) and len(own.best) == nodes  # a shared prefix makes no node
    rows = [(1, "hello world,"), (2, None), (3, ""), (3, " \n"), (None, "he he"), (4, LONG)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted((r["id"] or 0, r["n_tokens"], r["n_words"]) for r in token_counts.count_tokens(docs, path).collect())
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert got == sorted((i or 0, sum(viterbi(w, scores) for w in words(t)), len(words(t))) for i, t in rows)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


# language

def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    net = lang_id.fresh_network(["a", "b", "c"], 3)
    net.inputs, net.recurrent, net.outputs, net.bias = [w.astype(np.float64) for w in net.weights()]
    x = rng.integers(0, 257, (7, 4))
    label = rng.integers(0, 3, 4)
    # float32 states limit the precision of differences
    _, grads = lang_id.gradients(net, x, label)
    for w, g in zip(net.weights(), grads, strict=True):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if w.ndim == 3 and w.shape[2] == 257:
                at = (at[0], at[1], int(rng.choice(x.ravel())))
            old, step = w[at], 1e-2
            w[at] = old + step
            up, _ = lang_id.gradients(net, x, label)
            w[at] = old - step
            down, _ = lang_id.gradients(net, x, label)
            w[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_probabilities(net, data):
    """A text's mean position probabilities by the textbook GRU, one unit at a time."""
    h, n_lang = lang_id.UNITS, len(net.langs)
    total = [0.0] * n_lang
    for at in range(0, len(data), lang_id.WINDOW):
        window = list(data[at : at + lang_id.WINDOW])
        x = window + [lang_id.PAD] * (lang_id.WINDOW - len(window))
        states = []
        for d in (0, 1):
            state, seen = [0.0] * h, []
            for byte in x if d == 0 else x[::-1]:
                dot = [sum(float(net.recurrent[d, g, k]) * state[k] for k in range(h)) for g in range(3 * h)]
                into = [float(net.inputs[d, g, byte]) for g in range(3 * h)]
                r = [sigmoid(into[k] + dot[k]) for k in range(h)]
                z = [sigmoid(into[h + k] + dot[h + k]) for k in range(h)]
                n = [math.tanh(into[2 * h + k] + r[k] * dot[2 * h + k]) for k in range(h)]
                state = [(1 - z[k]) * n[k] + z[k] * state[k] for k in range(h)]
                seen.append(state)
            states.append(seen if d == 0 else seen[::-1])
        for t in range(len(window)):
            logits = [float(net.bias[m, 0]) + sum(float(net.outputs[d, m, k]) * states[d][t][k] for d in (0, 1) for k in range(h)) for m in range(n_lang)]
            top = max(logits)
            e = [math.exp(v - top) for v in logits]
            total = [a + b / sum(e) for a, b in zip(total, e, strict=True)]
    return [v / len(data) for v in total]


def test_probabilities_against_a_plain_network():
    import pyarrow as pa

    net = lang_id.fresh_network(["a", "b", "c"], 4)
    texts = ["short", "é ñ ü", "a text of more than one window, " * 8]
    got = lang_id.document_probabilities(net, pa.array(texts))
    for row, text in zip(got.tolist(), texts, strict=True):
        assert row == pytest.approx(plain_probabilities(net, text.encode()), abs=2e-4)


def test_language_of_odd_tables(spark):
    rows = [(1, "the cat and the dog", "en", 5), (1, "the cat and the dog", "en", 5), (2, "le 5 et la une " * 30000, "fr", 0), (3, None, None, 0), (None, "la la", None, 0)]
    rows += [(10 + i, f"the {i} and of it", "en", 0) for i in range(40)] + [(60 + i, f"le {i} et la une", "fr", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    net = lang_id.learn(docs)
    got = [(r["id"], r["lang_pred"]) for r in lang_id.predict(docs, net).collect()]
    assert len(got) == len(rows) and got.count((1, "en")) == 2 and (2, "fr") in got and (3, "und") in got
    assert lang_id.predict(docs.limit(0), net).count() == 0 and lang_id.learn(docs.limit(0)) is None
    assert lang_id.keep_known(docs, None).count() == len(rows) - 1


def test_windows_run_as_training_does():
    net = lang_id.fresh_network(["a", "b"], 5)
    text = "Some bytes é of a text that is longer than one window. " * 9
    import pyarrow as pa

    p = lang_id.document_probabilities(net, pa.array([text, "", None, "x"]))
    assert p.shape == (4, 2) and p[0].sum() == pytest.approx(1) and p[1].sum() == p[2].sum() == 0
    labels = lang_id.position_labels(net, text)
    assert len(labels) == len(text.encode()) and set(labels) <= {"a", "b"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = lang_id.learn(docs)
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, "123 --"), (None, "the of and"), (10**6 + 2, "")], "doc_id long, text string")
    said = {r["id"]: r for r in lang_id.predict(odd, net).collect()}
    assert said[10**6]["lang_pred"] == said[10**6 + 1]["lang_pred"] == said[10**6 + 2]["lang_pred"] == "und" and said[10**6]["score"] == 0
    assert said[None]["lang_pred"] in net.langs
    got = lang_id.predict(docs, net).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").filter(lang_id.held_out(F.col("id"))).collect()
    right = sum(r["lang_pred"] == r["lang"] for r in got)
    print("held-out accuracy", right / len(got))
    assert len(got) > 200 and right / len(got) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    kept = lang_id.keep_known(docs.withColumn("said", F.lit(1)), net)
    assert kept.columns == [*docs.columns, "said"] and kept.count() >= 0.99 * docs.filter(F.col("text").rlike("[A-Za-z]")).count()
    assert lang_id.learn(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert lang_id.predict(docs.limit(3), None).filter("lang_pred = 'und'").count() == 3
