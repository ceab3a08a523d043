import hashlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strictbefore.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)

TEXTS = [
    "", " ", "\n", "hello world", "  two  spaces ", "it's we'll they've", "x<|endoftext|>y <|endoftext|><|endoftext|>", "a" * 700, "ab" * 400, " " * 300 + "x",
    "=" * 129, "naïve café 日本語 😀 é ​", "1234567890" * 30, "   mixed\t\twhite\r\n", "antidisestablishmentarianism" * 5, "\x00\x01\x7f",
]


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(PATH)


def ids(own, text):
    return np.frombuffer(own.encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_text_equal_the_library(own, text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(own, text) == want
    assert own.decode(own.encode(text)) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.one_of(st.text(max_size=60), st.text("abehint sT'. \n1", max_size=200), st.text("aaaab", max_size=300)))
def test_any_text_equals_the_library(own, text):
    assert ids(own, text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_any_ids_decode_as_the_library_decodes(own, numbers):
    assert own.decode(np.array(numbers, "<u4").tobytes()) == LIBRARY.decode(numbers, skip_special_tokens=False)


def test_parts_of_a_long_text_change_nothing(own, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 50)
    text = " ".join(["word  with   gaps", "nospaces" * 20, "x\n y \n\n z"] * 30)
    assert ids(own, text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == text


def test_a_stream_emits_early_and_holds_little(own):
    data = ("thequickbrownfoxjumpsoverthelazydog" * 600).encode()
    stream = bpe.Transducer(own.merges)
    early = stream.feed(data)
    assert len(early) > 0.9 * len(data) / 8
    # the stable boundary may lie up to a token before the lookahead
    assert stream.most_held <= own.merges.lookahead + own.merges.longest + bpe.LOOK
    assert early + stream.finish() == LIBRARY.encode(data.decode(), add_special_tokens=False).ids


def test_long_runs_of_random_letters(own):
    rng = np.random.default_rng(3)
    for alphabet in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz"):
        text = "".join(rng.choice(list(alphabet), 3000))
        stream = bpe.Transducer(own.merges)
        assert stream.feed(text.encode()) + stream.finish() == LIBRARY.encode(text, add_special_tokens=False).ids
        # the stable boundary may lie up to a token before the lookahead
    assert stream.most_held <= own.merges.lookahead + own.merges.longest + bpe.LOOK


def test_documents(spark):
    rows = [(1, "Hello there", "x"), (2, None, None), (None, "no id", "y"), (2, None, None), (3, "", "z"), (4, "w" * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.round_trip(docs, PATH)
    got = sorted((r["id"] or 0, bytes(r["ids"]).hex(), r["decoded"]) for r in out.collect())
    want = sorted((i or 0, np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes().hex(), t or "") for i, t, _ in rows)
    assert got == want
    again = bpe.decode_ids(bpe.encode_documents(docs, PATH), PATH)
    assert sorted((r["id"] or 0, r["decoded"]) for r in again.collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_query_over_the_table(spark):
    from strictbefore.llm import queries

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_bpe_round_trip"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        want = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]]["n_tokens"] == len(want)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 50255), min_size=1, max_size=300), st.integers(1, 200))
def test_what_is_emitted_is_before_every_live_state(own, numbers, step):
    merges = own.merges
    data = b"".join(merges.bytes_of.get(i, b"") for i in numbers) + b"=" * 300
    last, back = [-1], [0]
    for upto in range(step, len(data) + 1, step):
        bpe.states(merges, data[:upto].decode("latin-1"), len(last) - 1, last, back, -1)
        stable = upto
        while stable > upto - merges.lookahead and stable:
            stable = back[stable]
        for state in range(max(0, upto - merges.longest + 1), upto + 1):  # a token that is yet to end begins at one of these
            while state > stable:
                state = back[state]
            assert state == stable


def test_long_pre_tokens_stream(own):
    for text in ("a" * 200_000, "日本語中文字符" * 12_000, "=-" * 60_000, " " * 90_000 + "x"):
        assert ids(own, text) == LIBRARY.encode(text, add_special_tokens=False).ids
        assert own.decode(own.encode(text)) == text
