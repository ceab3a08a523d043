import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strictbefore.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2**32 - 1), st.integers(0, 2**64 - 1)), max_size=400))
def test_blocks_round_trip(values):
    array = np.array(values, np.uint64)
    assert tf.decode_block(tf.encode_block(array), len(array)).tolist() == values


def test_blocks_are_dense():
    words = tf.encode_block(np.zeros(8192, np.uint64))
    assert len(words) <= 8192 // 240 + 2
    assert len(tf.encode_block(np.full(8000, 1000, np.uint64))) == -(-8000 // 6)


def test_files_round_trip():
    ids = np.random.default_rng(0).integers(0, 50000, 30000).astype("<u4")
    names, upto, back = tf.from_file(tf.to_file([None, 3, 9], [10000, 0, 20000], ids))
    assert names.tolist() == [tf.NULL_ID, 3, 9] and upto.tolist() == [10000, 10000, 30000] and back.tolist() == ids.tolist()


TEXTS = ["", "Hello, WORLD!", "it's we'll THEY'RE", "a b c", "x\x1cy \x1d z", "é É ǅ İ ß Σας", "<|endoftext|> a<|startoftext|>b", "12 345 6,7", "日本語 😀", "w" * 900, "don't.stop", "ab,", "Ab,.;"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_library(text):
    assert np.frombuffer(tf.encoder(PATH).encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("abT'.,! \né", max_size=80)))
def test_any_text_equals_the_library(text):
    assert np.frombuffer(tf.encoder(PATH).encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def expected(rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(spark, docs):
    manifest = tf.write(docs, PATH, tf.fresh_folder(spark))
    return [(r["id"], r["start"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in tf.read(manifest).orderBy("start").collect()]


def test_documents(spark, monkeypatch):
    rows = [(i * 7 % 101 - 20, f"Text {i} of some words, {'x' * (i % 9)}") for i in range(101)] + [(5, None), (5, None), (None, "no id"), (200, "long " * 3000)]
    docs = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, range string").repartition(3)
    assert read(spark, docs) == expected(rows)
    assert read(spark, docs.limit(0)) == []


def test_query_over_the_table(spark):
    from strictbefore.llm import queries

    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.QUERIES["op6_token_files"](spark, sf).collect())
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == sorted(expected(rows))
