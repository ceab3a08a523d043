"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy by backpropagation through time, on a bounded sample of labelled rows: at most
2 * DOCS_PER_LANG documents per language, chosen by a hash of their ids, and WINDOWS windows of each document at hashed places. It
labels every byte position; a document's probabilities are the mean over its positions, of its whole text. Texts are read
in windows of WINDOW bytes, at whose edges the state starts anew, so that all windows run side by side.

Arrays hold features first and windows last: every gate is one contiguous block, both directions in one product.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if no row has a label.
Rows with a null label or a null id aren't learned from. Repeated rows are predicted alike. The label, the source and the id are
never inputs of a prediction; extra columns are kept by ``label_documents``. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strictbefore.llm.common import fresh, trim

#: Bytes of a window, units of each direction, windows that run side by side.
WINDOW, UNITS, BATCH = 192, 8, 1024
#: The bounds of the training sample: documents per language (twice as many at most), windows per document, languages by rows.
DOCS_PER_LANG, WINDOWS, LANGS = 500, 6, 256
#: Training: windows per step, steps, learning rate.
TRAIN_BATCH, STEPS, RATE = 96, 350, 0.02
PAD = 256
#: How far above chance, as a share of what is left to 1, a score has to be for keep_known() to keep a document.
MARGIN = 0.05
UNKNOWN = "und"


@dataclass
class Network:
    """langs, and weights: inputs (2, 3H, 257), recurrence (2, 3H, H), outputs (2, L, H), bias (L, 1); gates r, z, n."""

    langs: list[str]
    inputs: np.ndarray
    recurrent: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.outputs, self.bias]


def fresh_network(langs: list[str], seed: int = 0) -> Network:
    draw = np.random.default_rng(seed).standard_normal
    h, n = UNITS, len(langs)
    f = np.float32
    return Network(langs, draw((2, 3 * h, 257)).astype(f) * f(0.3), draw((2, 3 * h, h)).astype(f) * f(0.3), draw((2, n, h)).astype(f) * f(0.3), np.zeros((n, 1), f))


def softmax(logits: np.ndarray, axis: int) -> np.ndarray:
    """In place."""
    logits -= logits.max(axis, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis, keepdims=True)
    return logits


def position_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """(W, L, B): probabilities at every position of the windows x (W, B)."""
    steps, b = x.shape
    h2 = 2 * UNITS
    scale = np.concatenate([np.full(h2, 0.5), np.ones(UNITS)]).astype(np.float32)[:, None]  # a sigmoid is half a tanh of half
    inputs, recurrent = np.ascontiguousarray(net.inputs * scale), np.ascontiguousarray(net.recurrent * scale)
    h = np.zeros((2, UNITS, b), np.float32)
    a, g = np.empty((2, 3 * UNITS, b), np.float32), np.empty((2, 3 * UNITS, b), np.float32)
    said = np.empty((2, len(net.langs), b), np.float32)
    out = np.zeros((steps, len(net.langs), b), np.float32)
    out += net.bias
    gates, r, z, n, gn = a[:, :h2], a[:, :UNITS], a[:, UNITS:h2], a[:, h2:], g[:, h2:]
    for t in range(steps):
        np.take(inputs[0], x[t], axis=1, out=a[0], mode="clip")
        np.take(inputs[1], x[steps - 1 - t], axis=1, out=a[1], mode="clip")
        np.matmul(recurrent, h, out=g)
        gates += g[:, :h2]
        np.tanh(gates, out=gates)
        gates *= np.float32(0.5)
        gates += np.float32(0.5)
        gn *= r
        n += gn
        np.tanh(n, out=n)
        h -= n
        h *= z
        h += n
        np.matmul(net.outputs, h, out=said)
        out[t] += said[0]
        out[steps - 1 - t] += said[1]
    return softmax(out, 1)


def gradients(net: Network, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over the positions of windows x (W, B) with one label each, and its gradients through time."""
    steps, b = x.shape
    h2, n_lang = 2 * UNITS, len(net.langs)
    hs = np.zeros((steps + 1, 2, UNITS, b), np.float32)
    rs, zs, ns, gs = (np.empty((steps, 2, UNITS, b), np.float32) for _ in range(4))
    both = np.stack([x, x[::-1]])
    for t in range(steps):
        a = np.stack([net.inputs[d][:, both[d, t]] for d in (0, 1)])
        g = net.recurrent @ hs[t]
        gate = 1 / (1 + np.exp(-(a[:, :h2] + g[:, :h2])))
        rs[t], zs[t], gs[t] = gate[:, :UNITS], gate[:, UNITS:], g[:, h2:]
        ns[t] = np.tanh(a[:, h2:] + rs[t] * gs[t])
        hs[t + 1] = ns[t] + zs[t] * (hs[t] - ns[t])
    states = [hs[1:, 0], hs[1:, 1][::-1]]
    logits = sum(np.einsum("lh,thb->tlb", net.outputs[d], states[d]) for d in (0, 1)) + net.bias
    p = softmax(logits, 1)
    real = x != PAD
    count = max(int(real.sum()), 1)
    loss = -float((np.log(p[:, label, np.arange(b)] + 1e-9) * real).sum()) / count
    p[:, label, np.arange(b)] -= 1
    p *= real[:, None, :] / np.float32(count)
    d_out = np.stack([np.einsum("tlb,thb->lh", p, states[d]) for d in (0, 1)])
    d_state = [np.einsum("lh,tlb->thb", net.outputs[d], p) for d in (0, 1)]
    d_state = np.stack([d_state[0], d_state[1][::-1]], 1)
    d_in, d_rec = np.zeros_like(net.inputs), np.zeros_like(net.recurrent)
    dh = np.zeros((2, UNITS, b), np.float32)
    d_pre = np.empty((steps, 2, 3 * UNITS, b), np.float32)
    for t in range(steps - 1, -1, -1):
        dh = dh + d_state[t]
        dn = dh * (1 - zs[t]) * (1 - ns[t] ** 2)
        dz = dh * (hs[t] - ns[t]) * zs[t] * (1 - zs[t])
        dr = dn * gs[t] * rs[t] * (1 - rs[t])
        d_pre[t] = np.concatenate([dr, dz, dn], 1)
        dg = np.concatenate([dr, dz, dn * rs[t]], 1)
        d_rec += dg @ hs[t].transpose(0, 2, 1)
        dh = dh * zs[t] + net.recurrent.transpose(0, 2, 1) @ dg
    for d in (0, 1):
        flat, where = d_pre[:, d].transpose(1, 0, 2).reshape(3 * UNITS, -1), both[d].ravel()
        for k in range(3 * UNITS):
            d_in[d, k] = np.bincount(where, flat[k], 257)
    return loss, [d_in, d_rec, d_out, p.sum((0, 2))[:, None]]


def trained(texts: list[bytes], labels: list[str], seed: int = 0, steps: int = STEPS) -> Network:
    """Adam over balanced draws of windows; the same sample gives the same network."""
    langs = sorted(set(labels))
    net, rng = fresh_network(langs, seed), np.random.default_rng(seed)
    windows = np.full((len(texts), WINDOW), PAD, np.int64)
    for i, text in enumerate(texts):
        cut = np.frombuffer(text[:WINDOW], np.uint8)
        windows[i, : len(cut)] = cut
    label = np.searchsorted(langs, labels)
    by = [np.flatnonzero(label == k) for k in range(len(langs))]
    mean, square = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(by[k]) for k in rng.integers(0, len(langs), TRAIN_BATCH)])
        _, grads = gradients(net, np.ascontiguousarray(windows[pick].T), label[pick])
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
        rate = RATE * (1 - 0.9 * step / steps)
        for w, g, m, s in zip(net.weights(), grads, mean, square, strict=True):
            g = g * np.float32(min(1, 1 / (norm + 1e-9)))
            m += np.float32(0.1) * (g - m)
            s += np.float32(0.01) * (g * g - s)
            w -= np.float32(rate) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(s / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return net


def document_probabilities(net: Network, texts: pa.Array) -> np.ndarray:
    """(documents, L): mean probabilities over all byte positions; zero for empty texts."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    windows = -(-lengths // WINDOW)
    doc = np.repeat(np.arange(len(texts)), windows)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = offsets[:-1][doc] + nth * WINDOW
    size = np.minimum(lengths[doc] - nth * WINDOW, WINDOW)
    sums = np.zeros((len(texts), len(net.langs)))
    place = np.arange(WINDOW)[:, None]
    for at in range(0, len(doc), BATCH):
        one, n = start[at : at + BATCH], size[at : at + BATCH]
        inside = place < n
        x = np.where(inside, data[np.minimum(one + place, len(data) - 1)].astype(np.intp), PAD)  # a byte can't hold the padding
        p = position_probabilities(net, x)
        pooled = np.einsum("tlb,tb->bl", p, inside.astype(np.float32))
        np.add.at(sums, doc[at : at + BATCH], pooled)
    return sums / np.maximum(lengths, 1)[:, None]


def position_labels(net: Network, text: str) -> list[str]:
    """The language of every byte of a text."""
    data = np.frombuffer(text.encode(), np.uint8)
    out = []
    for at in range(0, len(data), WINDOW):
        x = np.full((WINDOW, 1), PAD, np.intp)
        x[: len(data[at : at + WINDOW]), 0] = data[at : at + WINDOW]
        best = position_probabilities(net, x)[:, :, 0].argmax(1)
        out += [net.langs[k] for k in best[: len(data[at : at + WINDOW])].tolist()]
    return out


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[bytes], list[str]]:
    """Windows and labels to learn from; its size is bounded by the module's constants."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    if not counts:
        return [], []
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1_000_000, -(-1_000_000 * DOCS_PER_LANG // r["count"])))])
    chosen = rows.filter(draw < F.element_at(rate, F.col("lang")))
    span = F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1
    places = F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), span).cast("int") + 1 for i in range(WINDOWS)])
    cut = F.transform(places, lambda p: F.substr(F.col("text"), p, F.lit(WINDOW)))
    bound = 2 * DOCS_PER_LANG * len(counts)
    got = chosen.select(F.xxhash64("id").alias("h"), "id", "lang", cut.alias("cuts")).orderBy("h", "id", "lang").limit(bound).collect()
    pairs = [(c.encode(), r["lang"]) for r in got for c in r["cuts"] if c and any(x.isalpha() for x in c)]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    texts, labels = sample(docs, id_col, text_col, lang_col)
    return trained(texts, labels) if texts else None


def guess(net: Network | None, text: Column) -> Column:
    """struct<lang, score> of a whole text."""
    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if net is None:
        return nothing

    @arrow_udf("struct<lang:string,score:double>")
    def label(texts: pa.Array) -> pa.Array:
        p = document_probabilities(net, texts)
        best = p.argmax(1)
        names = pa.array([net.langs[k] for k in best.tolist()], pa.string())
        trim()
        return pa.StructArray.from_arrays([names, pa.array(np.clip(p[np.arange(len(p)), best], 0, 1))], names=["lang", "score"])

    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.when(letters, label(F.when(letters, text).otherwise(""))).otherwise(nothing)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score."""
    said = docs.select(docs[id_col].alias("id"), guess(net, docs[text_col]).alias("said"))
    return said.select("id", F.col("said.lang").alias("lang_pred"), F.col("said.score").alias("score"))


def keep_known(docs: DataFrame, net: Network | None, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The documents that have a language, all columns as they are.

    ``und`` goes, and so does a text whose best score is no more than chance, 1 / languages, and ``margin`` of what is left up
    to 1. Where nothing could be learned, all that have a letter stay.
    """
    if net is None:
        return docs.filter(F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False)))
    names = docs.columns
    (said,) = fresh(docs, "said")
    labelled = docs.withColumn(said, guess(net, docs[text_col]))
    known = (F.col(said)["lang"] != UNKNOWN) & (F.col(said)["score"] >= least_score(net, margin))
    return labelled.filter(known).select(*[F.col(f"`{c}`") for c in names])


def least_score(net: Network, margin: float = MARGIN) -> float:
    """The score that keep_known() asks for; a float's error of one language's certain score is allowed for."""
    chance = 1 / len(net.langs)
    return chance + margin * (1 - chance) - 1e-6
