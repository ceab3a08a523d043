"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder as an incremental state machine.

Encoding reads bytes left to right. For every prefix exactly one token can be the last of its encoding: the one that is
a suffix of the prefix and forms a valid pair with the last token of the prefix before it. A pair is valid if no merge
of higher priority would have crossed its boundary; ``valid_pair`` undoes the two tokens' merges in time order to see. So
each byte adds one state, and each state points back to the one its token follows. The tokens that end at a byte come, longest
first, from an automaton over the vocabulary that follows links to the next shorter suffix.

How far a merge's effect can travel left is bounded by the merge list: ``lookahead`` computes the bound once. A token
boundary with so many bytes read behind it is stable: what lies before it is emitted and forgotten, so a pre-token of
any length is encoded in memory that the merge list alone bounds.

Pre-tokens are runs of the vocabulary's published pattern; short ones keep their encoding in a bounded cache.

Decoding maps ids to bytes and feeds an incremental UTF-8 machine that holds back at most three bytes; invalid sequences
become U+FFFD by maximal subparts.

Defined cases: a null text encodes like an empty one, to no ids. The strings of the file's added tokens are those tokens
wherever they stand. Ids outside the vocabulary decode to nothing. Repeated rows give repeated rows; extra columns play no
part; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strictbefore.llm.common import bounded_batches, trim

#: Pre-tokens of up to CACHED_BYTES are kept, CACHED of them at least and twice as many at most per worker, and up to PAIRS pairs.
CACHED, CACHED_BYTES, PAIRS = 100_000, 64, 200_000
#: Bytes between two looks for what is stable, and characters of a text or a pre-token that are handled at a time.
LOOK, PART = 1024, 1 << 16
NEVER = 1 << 60
BASE = -1


def byte_letters() -> dict[str, int]:
    """The vocabulary file's letter of each byte: printable Latin-1 stands for itself, the rest count on from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A merge list: ranks of pairs, and each token's rank and halves."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.id_of = vocab
        self.bytes_of = {i: t for t, i in vocab.items()}
        self.longest = max(map(len, vocab))
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {vocab[bytes([b])]: (BASE, -1, -1) for b in range(256)}
        for rank, (a, b) in enumerate(merges):
            pair = (vocab[a], vocab[b])
            if pair not in self.rank:
                self.rank[pair] = rank
                self.made.setdefault(vocab[a + b], (rank, *pair))
        self.lookahead = self._lookahead(merges)
        self._valid: dict[int, bool] = {}  # by left * 2^32 + right
        # bytes as Latin-1 letters; yields (end, (token, length)) in the order of ends, the longest token of an end first
        self.automaton = ahocorasick.Automaton()
        for token in self.made:
            raw = self.bytes_of[token]
            self.automaton.add_word(raw.decode("latin-1"), (token, len(raw)))
        self.automaton.make_automaton()

    def _lookahead(self, merges: list[tuple[bytes, bytes]]) -> int:
        """Bytes to the right of a token boundary that can still move it.

        What follows can take a token's right neighbour away or not; either way a later merge may now take the token
        itself, and so on to the left. Such a chain has rising ranks, so its longest extent follows from one pass.
        """
        reach: dict[bytes, int] = {}
        longest = 0
        for a, b in merges:
            far = len(a) + reach.get(b, len(b))
            longest = max(longest, far)
            for edge in (a, a + b):
                reach[edge] = max(reach.get(edge, 0), far)
        return longest + self.longest

    def valid_pair(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes encode to just these two."""
        found = self._valid.get(left << 32 | right)
        if found is None:
            if len(self._valid) >= PAIRS:
                self._valid.clear()
            found = self._valid[left << 32 | right] = self._uncrossed(left, right)
        return found

    def _uncrossed(self, x: int, y: int) -> bool:
        rank, made = self.rank, self.made
        x_until = y_until = NEVER  # the rank at which x, y is used up
        while True:
            crossing = rank.get((x, y), NEVER)
            if crossing < x_until and crossing <= y_until and crossing != NEVER:
                return False  # of equal ranks the leftmost merges first
            (x_rank, _, x_right), (y_rank, y_left, _) = made[x], made[y]
            if x_rank == BASE and y_rank == BASE:
                return True
            if x_rank > y_rank:
                x_until, x = x_rank, x_right
            else:
                y_until, y = y_rank, y_left


def states(merges: Merges, letters: str, known: int, last: list[int], back: list[int], before: int) -> None:
    """Add the states of the prefixes of ``letters`` longer than ``known``; what went before only matters as far as a token is long."""
    valid, get = merges.valid_pair, merges._valid.get
    start = max(0, known - merges.longest + 1)
    done = known
    for end, (token, length) in merges.automaton.iter(letters, start):
        if end < done:
            continue
        begin = end + 1 - length
        previous = last[begin] if begin else before
        if previous != -1:
            fits = get(previous << 32 | token)
            if not (valid(previous, token) if fits is None else fits):
                continue
        last.append(token)
        back.append(begin)
        done = end + 1
    if len(last) <= len(letters):
        raise ValueError("the vocabulary lacks a byte")


def chain(last: list[int], back: list[int], end: int) -> list[int]:
    """The tokens of the prefix of ``end`` bytes."""
    out = []
    while end:
        out.append(last[end])
        end = back[end]
    return out[::-1]


class Transducer:
    """One pre-token's bytes in, its ids out as soon as no continuation can change them."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.held = ""  # letters since the last stable boundary
        self.last: list[int] = [-1]  # per prefix of held: its last token, and where that begins
        self.back: list[int] = [0]
        self.before = -1  # the token before held
        self.most_held = 0

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), LOOK):
            known = len(self.held)
            self.held += data[at : at + LOOK].decode("latin-1")
            self.most_held = max(self.most_held, len(self.held))
            states(self.merges, self.held, known, self.last, self.back, self.before)
            out += self._stable()
        return out

    def _stable(self) -> list[int]:
        """Emit what ends ``lookahead`` bytes before the last one read, or earlier."""
        at, far = len(self.held), len(self.held) - self.merges.lookahead
        while at > far and at:
            at = self.back[at]
        if not at:
            return []
        out = chain(self.last, self.back, at)
        self.before, self.held = out[-1], self.held[at:]
        self.last = [-1, *self.last[at + 1 :]]
        self.back = [0, *(b - at for b in self.back[at + 1 :])]
        return out

    def finish(self) -> list[int]:
        out = chain(self.last, self.back, len(self.held))
        self.__init__(self.merges)
        return out


class Encoder(dict):
    """Pre-tokens to ids as little-endian unsigned 32-bit integers; the dict is the younger half of the cache."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.added = {x["content"]: x["id"] for x in file["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        self.merges = Merges({raw(t): i for t, i in file["model"]["vocab"].items()}, [(raw(a), raw(b)) for a, b in pairs])
        texts = [self.merges.bytes_of.get(i, b"") for i in range(max(max(self.merges.bytes_of), *self.added.values(), 0) + 1)]
        for text, i in self.added.items():
            texts[i] = text.encode()
        self.sizes = np.array([*map(len, texts), 0])  # ids beyond the vocabulary stand for nothing
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        # fixed value: the published pre-tokenisation pattern of this vocabulary
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        # the same over ASCII without the four separators that the two engines class differently
        self.plain_pieces = re.compile(r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            if len(piece) > PART:
                return b"".join(self._long(piece))
            data = piece.encode()
            if len(data) > CACHED_BYTES:
                transducer = Transducer(self.merges)
                return packed(transducer.feed(data) + transducer.finish())
            last, back = [-1], [0]
            states(self.merges, data.decode("latin-1"), 0, last, back, -1)
            found = packed(chain(last, back, len(data)))
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found

    def _long(self, piece: str) -> Iterator[bytes]:
        """A pre-token of any length, PART characters at a time."""
        transducer = Transducer(self.merges)
        for at in range(0, len(piece), PART):
            yield packed(transducer.feed(piece[at : at + PART].encode()))
        yield packed(transducer.finish())

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.marks and any(x in text for x in self.added):
            found = []
            for i, span in enumerate(self.marks(text)):
                found.append(packed([self.added[span]]) if i % 2 else self._plain(span))
            return b"".join(found)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        plain = text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f")
        pieces = self.plain_pieces if plain else self.pieces
        if len(text) <= PART:
            return b"".join(map(self.__getitem__, pieces.findall(text)))
        out = bytearray()
        for found in pieces.finditer(text):
            out += self[found[0]]
        return bytes(out)

    def decode(self, ids: bytes) -> str:
        machine = ByteText()
        values = np.frombuffer(ids, "<u4")
        parts = [machine.feed(self.bytes_of(values[at : at + PART])) for at in range(0, len(values), PART)]
        return "".join(parts) + machine.finish()

    def bytes_of(self, values: np.ndarray) -> bytes:
        """The tokens' bytes, gathered at once."""
        values = np.minimum(values, len(self.sizes) - 1)
        sizes = self.sizes[values]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[values] - ends + sizes, sizes)].tobytes()


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class ByteText:
    """Bytes in, text out; the bytes of an unfinished character wait for the next call."""

    def __init__(self):
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's encoder of a vocabulary file, which every node has at this path; its cache outlives tasks."""
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (little-endian unsigned 32-bit integers): one row per document."""

    def mapped(batches):
        own = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.encode(x.as_py()) for x in batch.column(1)], pa.binary())], names=["id", "ids"])

    bounded_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(mapped, "id long, ids binary")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id, decoded: one row per row of ids; null ids decode to an empty text."""

    def mapped(batches):
        own = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x.as_py() or b"") for x in batch.column(1)], pa.string())], names=["id", "decoded"])

    bounded_batches(encoded.sparkSession)
    return encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].cast("binary").alias("ids")).mapInArrow(mapped, "id long, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, decoded: encodes every text and decodes the ids again, in one pass over the workers."""

    def mapped(batches):
        own = encoder(path)
        for batch in batches:
            ids = [own.encode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.string())], names=["id", "ids", "decoded"])
        trim()

    bounded_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(mapped, "id long, ids binary, decoded string")
