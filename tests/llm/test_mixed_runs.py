"""The mix's texts are stretches of their documents: nothing is joined over a gap."""

from collections import Counter

from pyspark.sql import functions as F

from strictbefore.llm import mixing


def test_every_text_is_a_stretch_of_its_document(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(1500)), "abc"[i % 3] if i % 10 else "a", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out, texts = mixing.mixed_documents(docs, block=32).collect(), {r[0]: r[1] for r in rows}
    taken = {r["id"]: r["taken"] for r in mixing.mix(docs, block=32).collect()}
    words, parts = Counter(), Counter()
    for r in out:
        assert f"{r['text'].strip()} " in f"{texts[r['doc_id']]} " and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(r["text"].split())
        parts[r["doc_id"]] += 1
    assert dict(words) == {i: n for i, n in taken.items() if n}
    assert max(parts.values()) > 3 and any(len(r["text"].split()) > 32 for r in out if r["text"] != texts[r["doc_id"]])


def test_rows_stand_in_the_order_of_shards(spark):
    rows = [(i, f"d{i} " * 40, "ab"[i % 2], 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    slot = {r["id"]: r["slot"] for r in mixing.mix(docs, block=40, shard_slots=8).collect()}
    parts = mixing.mixed_documents(docs, block=40, shard_slots=8).select(F.spark_partition_id().alias("part"), "doc_id").collect()
    by_shard = {}
    for r in parts:
        by_shard.setdefault(r["part"], []).append(r["doc_id"])
    once = [i for i in slot if sum(r["doc_id"] == i for r in parts) == 1]
    assert len(once) > 10
    where = {i: p for p, ids in by_shard.items() for i in ids}
    for a in once:
        for b in once:
            if slot[a] // 8 == slot[b] // 8:
                assert a == b or where[a] == where[b] and (by_shard[where[a]].index(a) < by_shard[where[a]].index(b)) == (slot[a] < slot[b])
