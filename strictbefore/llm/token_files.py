"""Token-id files in Simple-8b, written in ascending document order and read back.

A 64-bit word holds a 4-bit selector and 60 bits of ids: the selector says how many ids of how many bits each. Runs of
zeros take a selector without payload; a value of over 30 bits is escaped, a selector word followed by the value in a
word of its own. Ids are packed in blocks of BLOCK_IDS; each block begins a word, and a file lists its blocks' first words,
so any block decodes by itself and all of them with a few vectorised steps.

A file, little-endian 64-bit words throughout: magic, documents, ids, blocks; the documents' ids (null: the smallest
long) and the running count of their tokens; the blocks' first words, and one past the last; the packed words.

Files hold a range of document ids each; an id that many rows bear may be spread over ranges. The texts are shuffled once,
straight to their range, sorted, encoded and written. A task writes under a name of its own, so a task that runs twice
leaves a file that nothing refers to; the manifest, a table, names the files that count.

Defined cases: a null text encodes like an empty one, to the end id alone. A null document id comes first. Rows that repeat
an id stand side by side, by their first HEAD characters, then by hash. Extra columns play no part. An empty table writes no file and reads back empty.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strictbefore.llm.bpe import byte_letters
from strictbefore.llm.common import bounded_batches, materialise, shared_dir

#: Fixed values: (ids, bits) by selector; 15 is the escape.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30))
ESCAPE = 15
MAGIC = int.from_bytes(b"S8B-IDS1", "little")
BLOCK_IDS = 8192
#: Blocks that are packed or unpacked side by side.
BLOCKS = 16
#: Ids in a file, after which a task begins the next.
FILE_IDS = 1 << 23
#: Characters of a text by which rows of one id are ordered.
HEAD = 64
NULL_ID = -(1 << 63)
END_ID = 1


def widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    high = values >> np.uint64(32)
    found = np.frexp(low)[1].astype(np.int8)
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], found).astype(np.int8) if high.any() else found


def all_of_next(flags: np.ndarray, count: int) -> np.ndarray:
    """Whether all of the ``count`` flags from each place of a row on are set; what lies beyond the end counts as set."""
    held = np.concatenate([flags, np.ones((len(flags), count), bool)], 1)
    width = 1
    while width < count:  # windows of twice the width, at last the exact one
        more = min(width, count - width)
        held = held[:, :-more] & held[:, more:]
        width += more
    return held[:, : flags.shape[1]]


def encode_blocks(values: np.ndarray, size: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """Words of consecutive blocks of ``size`` values, the last may be short, and how many words each block has.

    A block's last word may stand for more ids than there are, which the count settles.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks, most = -(-n // size), SELECTORS[0][0]
    size = min(size, n)
    rows = np.zeros((blocks, size + most), np.uint64)  # each row ends in zeros for the last word to take
    flat = np.zeros(blocks * size, np.uint64)
    flat[:n] = values
    rows[:, :size] = flat.reshape(blocks, size)
    need = widths(rows[:, :size])
    choice = np.full((blocks, size), ESCAPE, np.int8)
    for selector in range(len(SELECTORS) - 1, -1, -1):  # from few to many ids, so that the most ids win
        count, bits = SELECTORS[selector]
        fits = need <= bits
        if fits.all(1).any() or np.count_nonzero(fits) >= min(count, n):
            np.copyto(choice, np.int8(selector), where=all_of_next(fits, count))
    counts = np.array([c for c, _ in SELECTORS] + [1])
    step = counts[choice].ravel().tolist()
    starts, per = [], []
    for block in range(blocks):
        at, end = block * size, min((block + 1) * size, n)
        had = len(starts)
        while at < end:
            starts.append(at)
            at += step[at]
        per.append(len(starts) - had)
    starts = np.array(starts)
    chosen = choice.ravel()[starts]
    room = np.where(chosen == ESCAPE, 2, 1)
    slot = np.cumsum(room) - room
    words = np.zeros(int(room.sum()), np.uint64)
    padded, places = rows.ravel(), starts + starts // size * most
    for selector in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == selector)
        head = np.uint64(selector << 60)
        at = places[mine]
        if selector == ESCAPE:
            words[slot[mine]] = head
            words[slot[mine] + 1] = padded[at]
            continue
        count, bits = SELECTORS[selector]
        packed = np.full(len(mine), head, np.uint64)
        for k in range(count if bits else 0):
            packed |= padded[at + k] << np.uint64(k * bits)
        words[slot[mine]] = packed
    return words, np.add.reduceat(room, np.cumsum([0, *per[:-1]]))


def encode_block(values: np.ndarray) -> np.ndarray:
    """Words of one block."""
    return encode_blocks(values, max(len(values), 1))[0]


def decode_blocks(words: np.ndarray, ends: np.ndarray, n: int, size: int = BLOCK_IDS) -> np.ndarray:
    """The n values of consecutive blocks; ``ends`` has each block's first word and one past the last."""
    if not n:
        return np.zeros(0, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    if (selectors == ESCAPE).any():
        heads = np.array(list(_heads(selectors.tolist())))  # an escape's second word is no selector word
    else:
        heads = np.arange(len(words))
    chosen = selectors[heads]
    counts = np.array([c for c, _ in SELECTORS] + [1])[chosen]
    first = np.cumsum(counts) - counts
    block = np.searchsorted(ends, heads, "right") - 1
    begins = np.searchsorted(heads, ends[:-1])
    first = first - first[begins][block] + block * size  # what a block's last word has too much is overwritten or cut off
    out = np.zeros(len(begins) * size + SELECTORS[0][0], np.uint64)
    beyond = (block + 1) * size
    for selector in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == selector)
        if selector == ESCAPE:
            out[first[mine]] = words[heads[mine] + 1]
            continue
        count, bits = SELECTORS[selector]
        if bits:
            mask, word, at, end = np.uint64((1 << bits) - 1), words[heads[mine]], first[mine], beyond[mine]
            tail = at + count > end
            whole = np.flatnonzero(~tail)
            for k in range(count):
                out[at[whole] + k] = (word[whole] >> np.uint64(k * bits)) & mask
            for i in np.flatnonzero(tail).tolist():  # one word a block at most
                for k in range(int(end[i] - at[i])):
                    out[at[i] + k] = (word[i] >> np.uint64(k * bits)) & mask
    return out[:n]


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of one block's words."""
    return decode_blocks(words, np.array([0, len(words)]), n, max(n, 1))


def _heads(selectors: list[int]) -> Iterator[int]:
    at = 0
    while at < len(selectors):
        yield at
        at += 2 if selectors[at] == ESCAPE else 1


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, and each block's first word with one past the last."""
    step = BLOCK_IDS * BLOCKS
    made = [encode_blocks(ids[at : at + step].astype(np.uint64)) for at in range(0, len(ids), step)]
    ends = np.cumsum(np.concatenate([[0], *[per for _, per in made]])).astype(np.uint64)
    return (np.concatenate([w for w, _ in made]) if made else np.zeros(0, np.uint64)), ends


def to_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, ends = pack(ids)
    head = np.array([MAGIC, len(doc_ids), len(ids), len(ends) - 1], "<u8")
    names = np.array([NULL_ID if x is None else x for x in doc_ids], "<i8")
    return b"".join([head.tobytes(), names.tobytes(), np.cumsum(lengths).astype("<u8").tobytes(), ends.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def from_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, running token counts, and all ids."""
    head = np.frombuffer(data, "<u8", 4)
    if int(head[0]) != MAGIC:
        raise ValueError("not a token-id file")
    docs, n, blocks = map(int, head[1:])
    at = 32
    names, at = np.frombuffer(data, "<i8", docs, at), at + 8 * docs
    upto, at = np.frombuffer(data, "<u8", docs, at).astype(np.int64), at + 8 * docs
    ends, at = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64), at + 8 * (blocks + 1)
    words = np.frombuffer(data, "<u8", int(ends[-1]), at)
    parts = []
    for b in range(0, blocks, BLOCKS):
        own = ends[b : b + BLOCKS + 1]
        parts.append(decode_blocks(words[own[0] : own[-1]], own - own[0], min(BLOCK_IDS * BLOCKS, n - b * BLOCK_IDS)))
    return names, upto, (np.concatenate(parts) if parts else np.zeros(0, np.uint64)).astype("<u4")


#: Marks that end a word and are no part of a contraction.
MARKS = ".,;:!?"
#: Letters below this are lower-cased alike everywhere and their words need no normalisation, but for one.
PLAIN, NOT_PLAIN = "\u0250", "\u0130"


class Encoder(dict):
    """Runs without ASCII white space to ids as bytes, through the tokenizers library; a bounded cache in two halves.

    The vocabulary's normaliser and pre-tokeniser never reach across white space, so a text's ids are those of its runs;
    that and the short cut for plain words hold for files of KIND only, others are refused.
    """

    CACHED, CACHED_CHARS = 400_000, 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            if (found := kind(json.load(f))) != KIND:
                raise ValueError(f"token files need a vocabulary that treats runs between white space one by one; {path} has {found}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.older: dict[str, bytes] = {}
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        letters = byte_letters()
        self.letters = {b: c for c, b in letters.items()}

    def __missing__(self, run: str) -> bytes:
        found = self.older.get(run)
        if found is None:
            # a plain word and the marks after it are pre-tokens of their own, whatever the case
            word = run.rstrip(MARKS)
            if not word.isalpha() or max(word) >= PLAIN or NOT_PLAIN in word:
                found = np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
            elif len(word) < len(run):
                found = self[word] + self[run[len(word) :]]
            elif not word.islower():
                found = self[word.lower()]
            else:
                letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                found = b"".join([self.raw[t.id] for t in self.tokenize(letters)])
            if len(run) > self.CACHED_CHARS:
                return found
        if len(self) >= self.CACHED:
            self.older = dict(self)
            self.clear()
        self[run] = found
        return found

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, runs(text))) if text else b""


#: The steps before the model in a vocabulary file of the kind that is understood here.
KIND = (
    ("NFC", "Replace", "Lowercase"), r"\s+", " ",
    ("Split", "ByteLevel"), r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "Removed", True, False,
    "BPE", "</w>", False,
)


def kind(file: dict) -> tuple | None:
    """What KIND states, as a vocabulary file has it."""
    try:
        before, cut, model = file["normalizer"]["normalizers"], file["pre_tokenizer"]["pretokenizers"], file["model"]
        return (
            tuple(x["type"] for x in before), before[1]["pattern"]["Regex"], before[1]["content"],
            tuple(x["type"] for x in cut), cut[0]["pattern"]["Regex"], cut[0]["behavior"], cut[0]["invert"], cut[1]["add_prefix_space"],
            model["type"], model["end_of_word_suffix"], bool(model.get("ignore_merges") or model.get("dropout")),
        )
    except (KeyError, TypeError, IndexError):
        return None


def runs(text: str) -> list[str]:
    """Runs between white space; str.split() also splits at four separators that are no white space to the vocabulary's patterns."""
    return RUN.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


RUN = re.compile(r"[^\x20\x09-\x0D]+")


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's encoder, which every node has its vocabulary file of at this path; its cache outlives tasks."""
    return Encoder(path)


def put(path: str, data: bytes) -> None:
    """Write a whole file; it takes its name when complete."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_output_stream(f"{inner}.part") as out:
        out.write(data)
    store.move(f"{inner}.part", inner)


def get(path: str) -> bytes:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner) as source:
        return source.read()


def write(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode every text, append ``end_id``, write files to ``folder`` and return the manifest: file, range, seq, docs, tokens, start.

    ``folder`` is one that all executors see. The manifest has one row per file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), F.substring(text, 1, HEAD).alias("head"), F.xxhash64(text).alias("hash"))
    order = (F.asc_nulls_first("id"), F.asc_nulls_first("head"), F.asc("hash"))
    # rows that are alike in all of these hold the same text, so they may be dealt to neighbouring ranges in any way
    ranged = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "nth")
    dealt = ranged.sortWithinPartitions(*order).select("id", "text")
    local = pa.schema([("file", pa.string()), ("range", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names, held, lengths, total, seq, part = encoder(path), [], [], [], 0, 0, TaskContext.get().partitionId()

        def close():
            file = f"{folder}/ids-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.s8b"
            put(file, to_file(names, lengths, np.frombuffer(b"".join(held), "<u4")))
            return pa.RecordBatch.from_pylist([{"file": file, "range": part, "seq": seq, "docs": len(names), "tokens": total}], schema=local)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = own.encode(text.as_py()) + end
                names.append(name)
                held.append(ids)
                lengths.append(len(ids) // 4)
                total += len(ids) // 4
                if total >= FILE_IDS:
                    yield close()
                    names, held, lengths, total, seq = [], [], [], 0, seq + 1
        if names:
            yield close()

    manifest = materialise(dealt.mapInArrow(written, "file string, range int, seq int, docs long, tokens long"), "manifest")
    before = Window.orderBy("range", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """id, start (ids of all documents before it), ids (little-endian unsigned 32-bit integers): one row per document."""

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, upto, ids = from_file(get(file))
                first = np.concatenate([[0], upto[:-1]]).astype(np.int64)
                for at in range(0, len(names), 1000):
                    cut = slice(at, at + 1000)
                    begin, end = int(first[at]), int(upto[cut][-1])
                    offsets = (np.concatenate([first[cut], [end]]) - begin) * 4
                    values = pa.Array.from_buffers(pa.large_binary(), len(names[cut]), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(ids[begin:end].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(names[cut], pa.int64(), mask=names[cut] == NULL_ID), pa.array(first[cut] + base), values.cast(pa.binary())], names=["id", "start", "ids"])

    spark = manifest.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "start").repartition(parts, "file").mapInArrow(loaded, "id long, start long, ids binary")


def fresh_folder(spark: SparkSession) -> str:
    """A new folder for files under the shared one."""
    base = shared_dir(spark)
    folder = f"{base if ':' in base else 'file://' + base}/token-ids-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return folder
