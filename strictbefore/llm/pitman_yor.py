"""Language-model scoring by a hierarchical Pitman-Yor model whose seating is sampled by Gibbs.

Tokens are a text's words, A-Z lower-cased, and an end. Every token that something follows is a context with a restaurant of its own; the start of a
text is one too. Its customers are the training tokens that follow it, its dishes the distinct ones. All these restaurants share one parent, the
root: each table of a context's restaurant sends a customer to the root, whose tables take their dish from the V training types and one unknown, evenly. With c
customers and t tables of a dish, c. and t. of a restaurant, strength theta and discount d, a restaurant predicts

    p(w) = (c - d t) / (theta + c.) + (theta + d t.) / (theta + c.) * parent(w)

Seating. A Gibbs step draws the number of tables of one dish in one restaurant given all other seats: t has a chance in proportion to
S(c, t) * parent(w)^t * (theta + d t') (theta + d (t' + 1)) ..., where t' are the restaurant's other tables and S the generalised Stirling
numbers, which add up all seatings of c customers at t tables. Up to EXACT customers that is drawn from the whole table of chances. A dish of more
is seated one customer after another, the chance of a new table weighed by what one more table is worth to all later customers, which is the exact rule for
two neighbouring numbers of tables taken to first order; a test holds its mean and, within a third, its spread to the exact one. Restaurants of a
level are sampled side by side, given the other level as the last step left it. After BURN sweeps, SAMPLES sweeps are
averaged: tables in the contexts, predictive probabilities in the root; what comes of it sums to one over the words. Discounts are estimated from
the numbers of dishes ordered once and twice, n1 / (n1 + 2 n2), over all the corpus.

Work. Words are known by their XXH64. Texts are cut into chunks of whole documents; a chunk's pairs (context, word) are sent, sorted and packed,
to the task of the context's range of hashes: the one shuffle of the corpus. There the pairs of all chunks become one table of counts, with
who asked. Tasks of ranges of word hashes hold the root: they get each context range's customers and answer with probabilities; a sweep
exchanges only changes and only words with a dish of two customers or more. At the end each document's log probabilities are added up per task, then per
block of documents. Contexts that a sample of SAMPLE_ROWS documents shows to be frequent are spread over all ranges by their words; their totals, some numbers a context, pass through
the driver. The sample decides about this layout only, and no result depends on it but by the seats drawn. Tables written between jobs cut the lineage; those a
sweep replaces are deleted.

Defined cases: a null, empty or blank text is an end alone. A null id trains and isn't held out. Repeated rows are documents of their own.
Without training rows N and V are 0, every token is unknown and has a probability of one. Extra columns play no part. An empty table gives an empty result.
A text is one row; a chunk of one text is as long as the text.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strictbefore.llm.common import bounded_batches, bucketed, forget, fresh, keyed, materialise
from strictbefore.llm.simhash import LOWER

THETA = 1.0
BURN, SAMPLES = 1, 3
#: Turns of forward and backward means for a dish of many customers.
ROUNDS = 4
#: Customers of a dish up to which its tables are drawn from the exact conditional; the growth of a step beyond.
EXACT, GROWTH = 48, 1 / 16
#: Tokens of a range of contexts, whose pairs are one row, and ranges of contexts for each range of words.
RANGE_TOKENS, FAN = 1_300_000, 8
#: Pairs asked for that are added up at a time.
SLICE = 1 << 19
#: As many buckets as a table may have.
MOST_RANGES = 100_000
#: Tokens of a chunk, documents of a block, documents looked at for the layout.
CHUNK, BLOCK, SAMPLE_ROWS = 1 << 19, 1024, 4000
#: Words whose hashes a worker remembers.
MEMO = 300_000
SEED = 42
#: Holds white space, so no word is one of them.
START, END = (xxhash.xxh64_intdigest(b"\n" + x, SEED) for x in (b"start", b"end"))
KEYS = ("file", "check", "at")


class Hashes(dict):
    """XXH64 by word, of the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def tokens(text: str | None, hashes: Hashes) -> np.ndarray:
    words = (text or "").encode().translate(LOWER).split()  # bytes.split() splits at [\x20\x09-\x0D]
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, those of equal significance side by side, compressed."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at = raw[0], 1 + 10 * raw[0]
    out = []
    for i in range(n):
        kind, size = struct.unpack_from("<2sQ", raw, 1 + 10 * i)
        dtype = np.dtype("<" + kind.decode())
        width = size * dtype.itemsize
        out.append(np.frombuffer(raw, np.uint8, width, at).reshape(dtype.itemsize, size).T.copy().view(dtype).reshape(-1))
        at += width
    return out


def gaps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of hashes a key lies in; ascending keys have ascending ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = (a ^ (b >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15) + b
    return (z ^ (z >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


# seats


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    out = np.full((most + 1, most + 2), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, most + 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            grow = np.where(c > d * t, np.log(np.maximum(c - d * t, 1e-300)), -np.inf)
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], grow + out[c, 1:])
    return out


def log_chances(table: np.ndarray, c: int, others: np.ndarray, parent: np.ndarray, theta: float, d: float) -> np.ndarray:
    """Per row the logarithm of the unnormalised chance of 1, 2, ..., c tables, given the restaurant's other tables and the dish's parent probability."""
    opened = np.log(theta + d * (others[:, None] + np.arange(c))) + np.log(parent)[:, None]
    return np.cumsum(opened, axis=1) + table[c, 1 : c + 1]


def draw_tables(c: np.ndarray, others: np.ndarray, parent: np.ndarray, theta: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """A Gibbs step for many dishes: tables t of c customers each."""
    t = np.ones(len(c), np.int64)
    table = stirling(d)
    small = np.flatnonzero((c > 1) & (c <= EXACT))
    order = small[np.argsort(c[small], kind="stable")]
    bounds = np.searchsorted(c[order], np.arange(2, EXACT + 2))
    for size, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), 2):
        for at in range(a, b, 20_000):
            rows = order[at : min(b, at + 20_000)]
            chances = log_chances(table, size, others[rows], parent[rows], theta, d)
            summed = np.cumsum(np.exp(chances - chances.max(1, keepdims=True)), axis=1)
            t[rows] = 1 + (summed < rng.random(len(rows))[:, None] * summed[:, -1:]).sum(1)
    big = np.flatnonzero(c > EXACT)
    for at in range(0, len(big), 2000):
        rows = big[at : at + 2000]
        t[rows] = seat_many(c[rows].astype(float), theta + d * others[rows], parent[rows], d, rng)
    return t


def seat_many(c: np.ndarray, before: np.ndarray, parent: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of many customers, seated in steps; ``before`` is theta + d t'.

    ``gain`` is the logarithm of what one more table is worth to all customers still to come. It follows backwards from the
    expected numbers of tables and these forwards from it; ROUNDS turns settle both, then the customers are seated.
    """
    n = [1.0]
    while n[-1] < c.max():
        n.append(n[-1] + max(1.0, np.floor(n[-1] * GROWTH)))
    n = np.array(n[:-1])
    steps = np.clip(c - n[:, None], 0, np.maximum(1.0, np.floor(n * GROWTH))[:, None])
    mid = n[:, None] + steps / 2 - 0.5
    gain = d * (1 - parent) * np.log(np.minimum(mid / c, 1.0))

    def chance(i: int, k: np.ndarray) -> np.ndarray:
        new = (before + d * k) * parent * np.exp(gain[i])
        return new / (new + np.maximum(mid[i] - d * k, 1e-9))

    for _ in range(ROUNDS):
        k, path = np.ones(len(c)), np.empty_like(gain)
        for i in range(len(n)):
            more = steps[i] * chance(i, k)
            path[i] = k + more / 2
            k = k + more
        late = np.zeros(len(c))
        for i in range(len(n) - 1, -1, -1):
            weight = (before + d * path[i]) * parent * np.exp(late) + np.maximum(mid[i] - d * path[i], 1e-9)
            early = late - steps[i] * d * (1 - parent * np.exp(late)) / weight
            gain[i], late = (early + late) / 2, early
    k = np.ones(len(c))
    for i in range(len(n)):
        k += rng.binomial(steps[i].astype(np.int64), chance(i, k))
    return k.astype(np.int64)


def discount(once: int, twice: int) -> float:
    """From the numbers of dishes of one and of two customers."""
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5


# pairs


def chunk_pairs(ats: list[int], train: list[bool], texts: list[np.ndarray], parts: int, hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A chunk's pairs per range: (range, packed places and training flags of documents, contexts, words, and per pair their numbers and the document's)."""
    words = np.concatenate(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), lengths)
    keys, w = np.unique(words, return_inverse=True)
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[np.cumsum(lengths) - lengths] = len(keys)
    named = np.r_[keys, np.uint64(START)]
    part = part_of(named, parts)[u]
    often = np.isin(named, hot)[u]
    part[often] = part_of(mixed(named[u[often]], keys[w[often]]), parts)
    code = u * len(keys) + w
    order = np.lexsort((code, part))
    u, w, doc, part = u[order], w[order], doc[order], part[order]
    bounds = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    places, flags = np.array(ats, np.int64), np.array(train, np.uint8)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        us, ui = np.unique(u[a:b], return_inverse=True)
        ws, wi = np.unique(w[a:b], return_inverse=True)
        ds, di = np.unique(doc[a:b], return_inverse=True)
        yield int(part[a]), pack(gaps(places[ds]), flags[ds], named[us], gaps(keys[ws]), gaps(ui.astype(np.int32)), wi.astype(np.int32), di.astype(np.int32))


def layout(docs: DataFrame, text: Column) -> tuple[int, np.ndarray]:
    """How many ranges of contexts to make, and the hashes of the contexts that are spread over all of them: those that make a 16th of a range or more, 16 a range at most. From a sample."""
    rows = docs.count()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, n = np.unique(np.concatenate([tokens(x.as_py(), Hashes()) for x in batch.column(0)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["key", "n"])

    counts = docs.select(text.alias("text")).sample(min(1.0, SAMPLE_ROWS / max(rows, 1)), seed=SEED).mapInArrow(mapped, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "sampled-contexts")
    signed = lambda key: key - (1 << 64) if key >> 63 else key
    total, texts = counts.agg(F.sum("n"), F.sum(F.when(F.col("key") == signed(END), F.col("n")))).first()  # a text has one end
    parts = min(MOST_RANGES, math.ceil((total or 0) / (texts or 1) * rows / RANGE_TOKENS)) or 1
    often = counts.filter(F.col("n") * 16 * parts >= (total or 0)).select("key").collect()
    return parts, np.array([r["key"] for r in often] + [signed(START)], np.int64).view(np.uint64)


def pairs(rows: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """part, file, check, packed of the rows (file, check, at, train, text)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, file = Hashes(), ([], [], []), 0, None

        def flushed() -> Iterator[pa.RecordBatch]:
            if held[0]:
                got = list(chunk_pairs(*held, parts, hot))
                for x in held:
                    x.clear()
                for at in range(0, len(got), 64):
                    some = got[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int32()), pa.array([file[0]] * len(some), pa.int64()), pa.array([file[1]] * len(some), pa.int64()), pa.array([x for _, x in some], pa.binary())], names=["part", "file", "check", "packed"])

        for batch in batches:
            for f, check, at, train, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                if (f, check) != file or size >= CHUNK:
                    yield from flushed()
                    size, file = 0, (f, check)
                found = tokens(text.as_py(), hashes)
                for x, value in zip(held, (at, train, found), strict=True):
                    x.append(value)
                size += len(found)
        yield from flushed()

    return rows.mapInArrow(mapped, "part int, file long, check long, packed binary")


COUNTED = "part int, grams binary, words binary, hot binary, asked binary, docs binary, once long, twice long"


def counted(packed: DataFrame, hot: np.ndarray) -> DataFrame:
    """Per range one row: its pairs with their training counts, its words, which contexts are spread, and for each pair the documents that hold it."""

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("file", "ascending"), ("check", "ascending"), ("packed", "ascending")])
        us, ws, ui, wi, di, train, docs = [], [], [], [], [], [], []
        n_u = n_w = n_d = 0
        for file, check, data in zip(table["file"].to_pylist(), table["check"].to_pylist(), table["packed"], strict=True):
            places, flags, u, w, du, iw, idoc = unpack(data.as_py())
            us.append(u)
            ws.append(np.cumsum(w))
            ui.append(np.cumsum(du) + n_u)
            wi.append(iw + n_w)
            di.append(idoc + n_d)
            train.append(flags)
            docs.append(np.stack([np.full(len(places), file), np.full(len(places), check), np.cumsum(places)]))
            n_u, n_w, n_d = n_u + len(u), n_w + len(w), n_d + len(places)
        u_keys, u_at = np.unique(np.concatenate(us), return_inverse=True)
        w_keys, w_at = np.unique(np.concatenate(ws), return_inverse=True)
        code = u_at[np.concatenate(ui)] * len(w_keys) + w_at[np.concatenate(wi)]
        doc, train, docs = np.concatenate(di), np.concatenate(train), np.concatenate(docs, axis=1)
        del us, ws, ui, wi, di, u_at, w_at, table
        order = np.argsort(code, kind="stable")
        code, doc = code[order], doc[order].astype(np.int32)
        del order
        first = np.flatnonzero(np.diff(code, prepend=-1))
        c = np.add.reduceat(train[doc].astype(np.int32), first)
        gu, gw = (code[first] // len(w_keys)).astype(np.int32), (code[first] % len(w_keys)).astype(np.int32)
        asked = np.diff(np.r_[first, len(code)]).astype(np.int32)
        hot_at = np.flatnonzero(np.isin(u_keys, hot))
        row = [key[0].as_py(), pack(gaps(gu), gw, c), pack(gaps(w_keys)), pack(hot_at.astype(np.int32), u_keys[hot_at]), pack(asked, doc), pack(*docs), int((c == 1).sum()), int((c == 2).sum())]
        kinds = [pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int64()]
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in COUNTED.split(", ")])

    return packed.groupBy("part").applyInArrow(merged, COUNTED)


class Range:
    """A range of contexts: its pairs, and what a sweep needs of them."""

    def __init__(self, grams: bytes, words: bytes, hot: bytes, keepers: int = 1):
        du, self.w, self.c = unpack(grams)
        self.u = np.cumsum(du)
        self.words = np.cumsum(unpack(words)[0])
        self.hot_at, self.hot_keys = unpack(hot)
        n = int(self.u[-1]) + 1
        self.customers = np.bincount(self.u, self.c, n)
        self.fixed = np.bincount(self.u, self.c > 0, n)
        self.live = np.flatnonzero(self.c > 1)
        self.active = np.zeros(len(self.words), bool)
        self.active[self.w[self.live]] = True
        self.cuts = np.searchsorted(part_of(self.words, keepers), np.arange(keepers + 1))

    def tables(self, extra: np.ndarray) -> np.ndarray:
        """Tables per context, from those beyond the first of each live pair."""
        return self.fixed + np.bincount(self.u[self.live], extra, len(self.fixed))

    def spread(self, values: np.ndarray, totals: dict[int, float] | None) -> np.ndarray:
        """Values per context with those of spread contexts replaced by their totals over all ranges."""
        if totals:
            values[self.hot_at] = [totals[int(k)] for k in self.hot_keys]
        return values

    def by_word(self, values: np.ndarray, pairs: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bincount(self.w[pairs], values, len(self.words))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def whole(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


SENT = pa.list_(pa.struct([("other", pa.int32()), ("data", pa.binary())]))
SENT_SQL = "array<struct<other:int,data:binary>>"


def delivered(sent: DataFrame, own: str, to: str) -> DataFrame:
    """What the rows of a table sent to each other part, gathered by the receiver: ``to``, got (sender, data)."""
    out = sent.select(F.col(own).alias("sender"), F.explode("sent").alias("s")).select(F.col("s.other").alias(to), "sender", "s.data")
    return out.groupBy(to).agg(F.sort_array(F.collect_list(F.struct("sender", "data"))).alias("got"))


def first_words(table: DataFrame, keepers: int) -> DataFrame:
    """Each range's words to their keepers: part, sent (words, customers, first tables, whether any pair is live)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            own = Range(r["grams"], r["words"], r["hot"], keepers)
            c, t = own.by_word(own.c).astype(np.int64), own.by_word(own.c > 0).astype(np.int32)
            sent = [{"other": k, "data": pack(gaps(own.words[a:b]), c[a:b], t[a:b], own.active[a:b].astype(np.uint8))} for k, (a, b) in enumerate(zip(own.cuts[:-1].tolist(), own.cuts[1:].tolist(), strict=True)) if b > a]
            yield whole([(r["part"], sent)], ["part", "sent"], [pa.int32(), SENT])

    return table.select("part", "grams", "words", "hot").mapInArrow(mapped, f"part int, sent {SENT_SQL}")


def word_ranges(sent: DataFrame) -> DataFrame:
    """Per range of words one row: counts c, tables from the contexts' first ones, who asked for which words; and the numbers of tokens, types, and words sent once and twice."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            got = [(g["sender"], unpack(g["data"])) for g in r["got"]]
            keys, at = np.unique(np.concatenate([np.cumsum(x[0]) for _, x in got]), return_inverse=True)
            c = np.bincount(at, np.concatenate([x[1] for _, x in got]), len(keys)).astype(np.int64)
            t = np.bincount(at, np.concatenate([x[2] for _, x in got]), len(keys)).astype(np.int64)
            ends = np.cumsum([len(x[0]) for _, x in got]).tolist()
            routes = [{"other": s, "data": pack(gaps(at[b - len(x[0]) : b].astype(np.int32)), x[3])} for (s, x), b in zip(got, ends, strict=True)]
            yield whole([(r["keeper"], pack(c, t), routes, int(c.sum()), int((c > 0).sum()), int((t == 1).sum()), int((t == 2).sum()))], ["keeper", "counts", "routes", "n", "v", "once", "twice"], [pa.int32(), pa.binary(), SENT, *[pa.int64()] * 4])

    return delivered(sent, "part", "keeper").mapInArrow(mapped, f"keeper int, counts binary, routes {SENT_SQL}, n long, v long, once long, twice long")


def root_sweep(table: DataFrame, changes: DataFrame | None, before: DataFrame | None, turn: int, v: int, totals: tuple[int, int], d: float, theta: float) -> DataFrame:
    """The root's Gibbs step: keeper, seats (customers and tables), customers, tables. ``totals`` are the last sweep's tables and this one's customers."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            _, customers = unpack(r["counts"])
            customers = customers.copy()
            routes = {x["other"]: unpack(x["data"]) for x in r["routes"]}
            for g in r.get("got") or []:
                gap, active = routes[g["sender"]]
                np.add.at(customers, np.cumsum(gap)[active > 0], unpack(g["data"])[0])
            own = unpack(r["seats"])[1] if r.get("seats") is not None else np.minimum(customers, 1)
            seats = np.zeros(len(customers), np.int64)
            some = np.flatnonzero(customers)
            others = np.maximum(totals[0] - own[some], 0).astype(float)
            seats[some] = draw_tables(customers[some], others, np.full(len(some), 1 / (v + 1)), theta, d, np.random.default_rng((SEED, turn, 1, r["keeper"])))
            yield whole([(r["keeper"], pack(customers, seats), int(customers.sum()), int(seats.sum()))], ["keeper", "seats", "customers", "tables"], [pa.int32(), pa.binary(), pa.int64(), pa.int64()])

    joined = table.select("keeper", "counts", "routes")
    if changes is not None:
        joined = joined.join(delivered(changes, "part", "keeper"), "keeper", "left")
    if before is not None:
        joined = joined.join(before.select("keeper", "seats"), "keeper")
    return joined.mapInArrow(mapped, "keeper int, seats binary, customers long, tables long")


def root_probabilities(customers: np.ndarray, seats: np.ndarray, v: int, totals: tuple[int, int], d: float, theta: float) -> np.ndarray:
    """The root's prediction; ``totals`` are its tables and customers."""
    t, c = totals
    return (customers - d * seats) / (theta + c) + (theta + d * t) / (theta + c) / (v + 1)


def answers(table: DataFrame, seats: list[tuple[DataFrame, tuple[int, int]]], v: int, d: float, theta: float, last: bool) -> DataFrame:
    """keeper, sent: the root's probabilities, averaged over ``seats``, of the words each range asked for: the active ones in a sweep, at the end all and with their counts."""

    every = [totals for _, totals in seats]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            p = sum(root_probabilities(*unpack(r[f"seats{i}"]), v, totals, d, theta) for i, totals in enumerate(every)) / len(every)
            c, sent = unpack(r["counts"])[0], []
            for x in r["routes"]:
                gap, active = unpack(x["data"])
                at = np.cumsum(gap)
                sent.append({"other": x["other"], "data": pack(p[at], c[at]) if last else pack(p[at[active > 0]])})
            yield whole([(r["keeper"], sent)], ["keeper", "sent"], [pa.int32(), SENT])

    joined = table.select("keeper", "counts", "routes")
    for i, (s, _) in enumerate(seats):
        joined = joined.join(s.select("keeper", F.col("seats").alias(f"seats{i}")), "keeper")
    return joined.mapInArrow(mapped, f"keeper int, sent {SENT_SQL}")


def context_sweep(table: DataFrame, answered: DataFrame, before: DataFrame | None, turn: int, spread: dict[int, float], d: float, theta: float, keepers: int) -> DataFrame:
    """The contexts' Gibbs step: part, extra (tables beyond the first of live pairs), sent (their change of customers by word), spread (key, tables)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            own = Range(r["grams"], r["words"], r["hot"], keepers)
            extra = unpack(r["extra"])[0] if r.get("extra") is not None else np.zeros(len(own.live), np.int32)
            p = np.zeros(len(own.words))
            p[own.active] = np.concatenate([unpack(g["data"])[0] for g in r["got"]])
            tables = own.spread(own.tables(extra), spread)
            live = own.live
            others = tables[own.u[live]] - 1 - extra
            drawn = draw_tables(own.c[live], np.maximum(others, 0), p[own.w[live]], theta, d, np.random.default_rng((SEED, turn, 0, r["part"])))
            extra = (drawn - 1).astype(np.int32)
            more = own.by_word(extra, live).astype(np.int32)
            sent = [{"other": k, "data": pack(more[a:b][own.active[a:b]])} for k, (a, b) in enumerate(zip(own.cuts[:-1].tolist(), own.cuts[1:].tolist(), strict=True)) if own.active[a:b].any()]
            now = own.tables(extra)
            told = [{"key": int(k), "tables": float(now[i])} for k, i in zip(own.hot_keys.view(np.int64), own.hot_at, strict=True)]
            yield whole([(r["part"], pack(extra), sent, told)], ["part", "extra", "sent", "spread"], [pa.int32(), pa.binary(), SENT, SPREAD])

    joined = table.select("part", "grams", "words", "hot").join(delivered(answered, "keeper", "part"), "part")
    if before is not None:
        joined = joined.join(before.select("part", "extra"), "part")
    return joined.mapInArrow(mapped, f"part int, extra binary, sent {SENT_SQL}, spread array<struct<key:long,tables:double>>")


SPREAD = pa.list_(pa.struct([("key", pa.int64()), ("tables", pa.float64())]))


def spread_totals(states: list[DataFrame]) -> dict[int, float]:
    """Tables of the spread contexts over all ranges, averaged over states."""
    out: dict[int, float] = {}
    for s in states:
        for r in s.select(F.explode("spread").alias("s")).groupBy("s.key").agg(F.sum("s.tables").alias("t")).collect():
            key = r["key"] & ((1 << 64) - 1)
            out[key] = out.get(key, 0.0) + r["t"] / len(states)
    return out


def spread_customers(table: DataFrame) -> tuple[dict[int, float], dict[int, float]]:
    """Customers and first tables of the spread contexts over all ranges: a few numbers a range."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            own = Range(r["grams"], r["words"], r["hot"])
            rows = [(int(k), float(own.customers[i]), float(own.fixed[i])) for k, i in zip(own.hot_keys.view(np.int64), own.hot_at, strict=True)]
            yield whole(rows, ["key", "customers", "tables"], [pa.int64(), pa.float64(), pa.float64()])

    got = table.select("grams", "words", "hot").mapInArrow(mapped, "key long, customers double, tables double").groupBy("key").agg(F.sum("customers").alias("c"), F.sum("tables").alias("t")).collect()
    unsigned = lambda k: k & ((1 << 64) - 1)
    return {unsigned(r["key"]): r["c"] for r in got}, {unsigned(r["key"]): r["t"] for r in got}


def scored(m: Model, answered: DataFrame) -> DataFrame:
    """file, check, block, part, sums: each range's part of the scores of documents, a block of them a row."""
    samples, customers, tables, n, v, d, theta = len(m.states), m.customers, m.tables, m.n, m.v, m.d, m.theta

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            own = Range(r["grams"], r["words"], r["hot"])
            got = [unpack(g["data"]) for g in r["got"]]
            p, c_w = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
            extra = sum((unpack(r[f"extra{i}"])[0] for i in range(samples)), np.zeros(len(own.live))) / max(samples, 1)
            seated = own.c.clip(0, 1).astype(float)
            seated[own.live] += extra
            all_tables = own.spread(own.tables(extra), tables)
            all_customers = own.spread(own.customers, customers)
            chance = (own.c - d * seated + (theta + d * all_tables[own.u]) * p[own.w]) / (theta + all_customers[own.u])
            log_p, log_base = np.log10(chance), np.log10((c_w + 1) / (n + v + 1))[own.w]
            known = (c_w > 0)[own.w]
            asked, doc = unpack(r["asked"])
            docs = np.stack(unpack(r["docs"]))
            size, ends = docs.shape[1], np.cumsum(asked)
            sums = [np.zeros(size), np.zeros(size), np.zeros(size), np.bincount(doc, minlength=size).astype(np.int32)]
            for at in range(0, len(doc), SLICE):
                some = doc[at : at + SLICE]
                gram = np.searchsorted(ends, np.arange(at, at + len(some)), side="right")
                for total, values in zip(sums, (log_p, log_base, known), strict=False):
                    total += np.bincount(some, values[gram], size)
            sums[2] = sums[2].astype(np.int32)
            order = np.lexsort((docs[2], docs[1], docs[0]))
            docs, sums = docs[:, order], [s[order] for s in sums]
            block = docs[2] // BLOCK
            cut = np.flatnonzero(np.r_[True, (np.diff(docs[:2], axis=1) != 0).any(0) | (np.diff(block) != 0), True])
            rows = [(int(docs[0, a]), int(docs[1, a]), int(block[a]), r["part"], pack((docs[2, a:b] % BLOCK).astype(np.int32), *[s[a:b] for s in sums])) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            for at in range(0, len(rows), 2000):
                yield whole(rows[at : at + 2000], ["file", "check", "block", "part", "sums"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()])

    joined = m.ranges.drop("once", "twice").join(delivered(answered, "keeper", "part"), "part")
    for i, s in enumerate(m.states):
        joined = joined.join(s.select("part", F.col("extra").alias(f"extra{i}")), "part")
    return joined.mapInArrow(mapped, "file long, check long, block long, part int, sums binary")


def added_up(sums: DataFrame) -> DataFrame:
    """file, check, at, score, base_score, n_known, n_tokens per document, the ranges' parts added in their order."""
    names, kinds = [*KEYS, "score", "base_score", "n_known", "n_tokens"], [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.int64()] * 2

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        got = [unpack(x.as_py()) for x in table.combine_chunks().sort_by([("part", "ascending")])["sums"]]
        at = np.concatenate([x[0] for x in got])
        found = np.unique(at)
        out = [np.bincount(at, np.concatenate([x[k] for x in got]), BLOCK)[found] for k in range(1, 5)]
        n = len(found)
        values = [np.full(n, key[0].as_py()), np.full(n, key[1].as_py()), found.astype(np.int64) + key[2].as_py() * BLOCK, *out[:2], *[o.astype(np.int64) for o in out[2:]]]
        return pa.table([pa.array(x, k) for x, k in zip(values, kinds, strict=True)], names=names)

    return sums.groupBy("file", "check", "block").applyInArrow(merged, "file long, check long, at long, score double, base_score double, n_known long, n_tokens long")


def held_out(doc_id: Column) -> Column:
    """Whether the document only tests: crc32 of the id in decimal leaves 2 of 7; a null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 7 == 2, F.lit(False))


@dataclass
class Model:
    """What scoring needs: the ranges of pairs and of words, the samples' seats, totals of the spread contexts, N, V and the discounts."""

    ranges: DataFrame
    words: DataFrame
    states: list[DataFrame]
    roots: list[tuple[DataFrame, tuple[int, int]]]
    customers: dict[int, float]
    tables: dict[int, float]
    n: int
    v: int
    d: float
    d_root: float
    theta: float
    keepers: int


def fit(rows: DataFrame, hot: np.ndarray, parts: int, burn: int, samples: int, theta: float) -> Model | None:
    """The model of the rows (file, check, at, train, text); none of an empty table."""
    ranges = bucketed(counted(pairs(rows, parts, hot), hot), "pairs", parts, "part")
    once, twice = ranges.agg(F.sum("once"), F.sum("twice")).first()
    if once is None:
        return None
    d, keepers = discount(once, twice), math.ceil(parts / FAN)
    words = bucketed(word_ranges(first_words(ranges, keepers)), "words", keepers, "keeper")
    n, v, once, twice = words.agg(F.sum("n"), F.sum("v"), F.sum("once"), F.sum("twice")).first()
    d_root = discount(once, twice)
    customers, tables = spread_customers(ranges)
    state = seats = None
    states, roots = [], []
    for turn in range(burn + samples if v else 1):
        new = bucketed(root_sweep(words, state, seats[0] if seats else None, turn, v, seats[1] if seats else (v, 0), d_root, theta), "root", keepers, "keeper")
        old, seats = seats, (new, tuple(new.agg(F.sum("tables"), F.sum("customers")).first()))
        if old and turn <= burn:
            forget(old[0])
        if turn >= burn or not v:
            roots.append(seats)
        if not v:
            break
        after = bucketed(context_sweep(ranges, answers(words, [seats], v, d_root, theta, False), state, turn, tables, d, theta, keepers), "seats", parts, "part")
        if state is not None and turn <= burn:
            forget(state)
        state, tables = after, spread_totals([after])
        if turn >= burn:
            states.append(state)
    return Model(ranges, words, states, roots, customers, spread_totals(states) if states else tables, n, v, d, d_root, theta, keepers)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", burn: int = BURN, samples: int = SAMPLES, theta: float = THETA) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability)."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    (row,) = fresh(docs, "row")
    docs = keyed(docs, row)
    place = [docs[row][k].alias(k) for k in KEYS]
    doc_id, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    ids = docs.select(*place, doc_id.alias("id"))
    parts, hot = layout(docs, text)
    m = fit(docs.select(*place, (~held_out(doc_id)).alias("train"), text.alias("text")), hot, parts, burn, samples, theta)
    if m is None:
        none = lambda name, kind: F.lit(None).cast(kind).alias(name)
        return ids.select("id", held_out(F.col("id")).alias("held_out"), none("n_tokens", "long"), none("n_known", "long"), none("train_tokens", "long"), none("base_score", "double"), none("score", "double")).filter("false")
    per = materialise(added_up(scored(m, answers(m.words, m.roots, m.v, m.d_root, theta, True))), "scores")
    got = ids.toDF("_f", "_c", "_a", "id").join(per, (F.col("_f") == F.col("file")) & (F.col("_c") == F.col("check")) & (F.col("_a") == F.col("at")))
    return got.select("id", held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", F.lit(m.n).cast("long").alias("train_tokens"), "base_score", "score")
