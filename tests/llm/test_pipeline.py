"""Every stage of the pipeline against brute force on its own input."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strictbefore.llm import lang_id, mixing
from tests.llm.test_edges import brute_dedup
from tests.llm.test_near_copies import brute_near

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "mixing sources", "BPE"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copy = docs.filter("doc_id = 7").first()["text"]
    odd = spark.createDataFrame([(9000, None, "en", "s", None), (9001, "12 34", None, None, 5), (9002, "", "en", None, 0), (9003, copy + "  ", "en", "s", 1)], docs.schema)
    steps = [docs.unionByName(odd)]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], SF).write.parquet(str(tmp_path / str(i)))
        steps.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < 4:
            assert steps[-1].columns == docs.columns
    inside = [{r["doc_id"]: r["text"] for r in s.collect()} for s in steps[:4]]

    net = lang_id.learn(steps[0])
    said = {r["id"]: r for r in lang_id.predict(steps[0], net).collect()}
    assert set(inside[1]) == {i for i, r in said.items() if r["lang_pred"] != "und" and r["score"] >= lang_id.least_score(net)}
    assert not {9000, 9001, 9002} & set(inside[1]) and len(inside[1]) >= 0.95 * docs.count()

    assert set(inside[2]) == {r[0] for r in brute_dedup(list(inside[1].items())) if r[3]}
    assert len(inside[2]) < len(inside[1])

    root, links = brute_near(inside[2])
    gone = set(inside[2]) - set(inside[3])
    assert gone <= {i for i, r in root.items() if r != i} and len(gone) >= 0.9 * sum(r != i for i, r in root.items())

    taken = {r["id"]: r["taken"] for r in mixing.mix(steps[3]).collect()}
    words = Counter()
    for r in steps[4].collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert dict(words) == {i: n for i, n in taken.items() if n}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in steps[4].collect():
        ids = np.array(library.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes()
        want.append((r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    got = steps[5].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_run_is_the_stages_in_turn(spark):
    a, b = (corpus_pipeline.run(spark, SF).agg(F.count("*"), F.sum("n_tokens"), F.min("ids_sha256"), F.max("ids_sha256")).first() for _ in range(2))
    assert a == b and a[0] > 100


def test_stages_take_odd_tables(spark, tmp_path):
    """Null and repeated ids, extra columns and no rows at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.filter("doc_id = 7").first()["text"]
    odd = spark.createDataFrame([(None, text, "en", "s", 1), (None, text + " ", "en", None, 1), (7, text, "en", "s", 1), (None, None, None, None, None)], docs.schema)
    for i, table in enumerate((docs.limit(50).unionByName(odd).withColumn("row", F.lit("x")).withColumn("said", F.lit(1)), docs.limit(0))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, table, SF).write.parquet(str(tmp_path / f"{i}-{k}"))
            after = spark.read.parquet(str(tmp_path / f"{i}-{k}"))
            if k < 4:
                assert after.columns == table.columns
            if i == 0 and k == 1:  # ids or none, one row of a text stays
                assert sum(r["text"].split() == text.split() for r in after.collect()) == 1
            table = after
        assert (table.count() > 0) == (i == 0)
