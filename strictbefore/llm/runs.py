"""Periodic runs of words: repeated k-grams mask what can't be part of a run, Main-Lorentz finds the runs in what is left.

Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of consecutive words with smallest period q and
LEAST words or more, TIMES * q or more, that can't be extended by a word with the period kept.

Mask. A run of n words agrees with itself q words on, over n - q words; with the bounds above that is at least
``overlap()`` words for whatever q, 5 here. So every window of k = overlap() words within the first n - q words of a run
comes again in the document q words later, and these windows and their repeats cover the run. A word outside all windows
that come more than once is in no run. Windows are compared by a 64-bit hash: equal windows have equal hashes, so a
collision can only leave a word unmasked, which costs time and changes nothing.

Search. Each maximal stretch of unmasked words is searched by Main and Lorentz's divide and conquer: the runs that reach
over the middle of a stretch come from four prefix functions (Z functions) over its halves, one candidate a period and side; the
halves are searched in turn, so n log n steps in all. The neighbours of a stretch are in no run, so runs that end at a
stretch's end end there in the document too.

A word is dropped if a run holds it after that run's first q words: one period of every run stays.

Defined cases: a null, empty or blank text has no words and no run. A null id is no number, so nothing of its text
is rewritten. Repeated rows give repeated rows. Extra columns play no part. An empty table gives an empty result. A text
is one row; beyond it the search holds a few integers a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strictbefore.llm.common import bounded_batches

LEAST, TIMES = 6, 4
#: Stretches of at most so many words are searched by comparing words at each distance.
SHORT = 48
#: Odd multipliers of a 64-bit finaliser.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def overlap(least: int = LEAST, times: int = TIMES) -> int:
    """The fewest words over which a run agrees with itself one period on: max(least, times * q) - q at its least, which a q up to ``least`` reaches."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number: equal words have equal ones."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def stretches(ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The maximal stretches [a, b) of words that a window of k words covers which comes more than once."""
    if len(ids) <= k:
        return []
    h = np.zeros(len(ids) - k + 1, np.uint64)
    for j in range(k):
        h = (h + ids[j : j + len(h)].astype(np.uint64) + np.uint64(1)) * np.uint64(MIX[0])
        h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX[1])
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return []
    repeated = np.zeros(len(h), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    at = np.flatnonzero(repeated)
    first = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + k])  # windows that touch or overlap are one stretch
    return list(zip(at[first].tolist(), (at[np.r_[first[1:] - 1, len(at) - 1]] + k).tolist(), strict=True))


def prefixes(s: list[int]) -> list[int]:
    """For each place of ``s`` how many items from there agree with its beginning (the Z function); the first is its length."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k > right - i:
                k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def crossing(s: list[int], lo: int, mid: int, hi: int, times: int) -> Iterator[tuple[int, int, int]]:
    """Candidates (start, end, period) within [lo, hi) that hold words on both sides of ``mid``.

    A run of four periods has a whole one before or after the middle, so the words at the middle agree with those a period on, or those
    a period before it with those at the middle; each period and side gives one greatest stretch.
    """
    left, right = s[lo:mid], s[mid:hi]
    n, m = len(left), len(right)
    backward = left[::-1]
    own_right = prefixes(right)  # right[p:] against right
    ends = prefixes([*backward, -1, *right[::-1], *backward])  # what ends at each place against the end of left
    own_left = prefixes(backward)
    starts = prefixes([*right, -1, *left, *right])  # what starts at each place against right
    most = (n + m) // times
    for p in range(1, min(m, most) + 1):
        ahead = own_right[p] if p < m else 0
        behind = ends[n + 1 + m - p]  # the words before mid + p against those before mid
        if ahead + behind >= p:
            yield mid - behind, mid + p + ahead, p
    for p in range(1, min(n, most) + 1):
        ahead = starts[m + 1 + n - p]
        behind = own_left[p] if p < n else 0
        if ahead + behind >= p:
            yield mid - p - behind, mid + ahead, p


def by_distance(ids: np.ndarray, times: int) -> Iterator[tuple[int, int, int]]:
    """All greatest stretches of a short sequence that agree with themselves at a distance, by comparing at every distance."""
    n = len(ids)
    for p in range(1, n // times + 1):
        agree = np.flatnonzero(np.diff(np.r_[False, ids[p:] == ids[:-p], False]))
        yield from ((int(a), int(b) + p, p) for a, b in agree.reshape(-1, 2))


def main_lorentz(ids: np.ndarray, least: int, times: int) -> dict[tuple[int, int], int]:
    """Every run of the sequence: (start, end) to its smallest period."""
    s, found = ids.tolist(), {}
    parts = [(0, len(s))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < least:
            continue
        if hi - lo <= SHORT:
            got = ((lo + a, lo + b, p) for a, b, p in by_distance(ids[lo:hi], times))
        else:
            mid = (lo + hi) // 2
            got = crossing(s, lo, mid, hi, times)
            parts += [(lo, mid), (mid, hi)]
        for a, b, p in got:
            # a stretch that goes on beyond this part is found where a larger part was divided
            if b - a >= least and b - a >= times * p and (a > lo or lo == 0 or s[a - 1] != s[a - 1 + p]) and (b < hi or hi == len(s) or s[b] != s[b - p]):
                if found.get((a, b), p) >= p:
                    found[a, b] = p
    return found


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of a sequence of numbers by start, then period."""
    out = []
    for a, b in stretches(ids, overlap(least, times)):
        out += [(a + x, y - x, p) for (x, y), p in main_lorentz(ids[a:b], least, times).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One document in ten made periodic from a word on, as the query's contract has it: by the crc32 of the id in decimal."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * whole + words[a : a + rest]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by a space, without those that a run holds after its first period."""
    if found:
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, [a + q for a, _, q in found], 1)
        np.add.at(gone, [a + n for a, n, _ in found], -1)
        words = [w for w, d in zip(words, np.cumsum(gone).tolist(), strict=False) if not d]
    return b" ".join(words)


SCHEMA = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = False, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row of ``docs``: id, its runs, the longest of them (ties: smallest start, then period), the collapsed text and digests of both.

    ``rewrite`` first makes one document in ten periodic, see ``rewritten``.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = [*[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(run), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def one(doc_id: int | None, text: str | None) -> tuple:
        words = (text or "").encode().split()  # bytes.split() splits at [\x20\x09-\x0D]
        if rewrite:
            words = rewritten(words, doc_id)
        got = runs(numbered(words), least, times) if len(words) >= least else []
        top = max(got, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        text = collapsed(words, got)
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in got)
        return (doc_id, len(got), *top, 1000 * top[1] // top[2] if got else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in got], text.decode())

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(i.as_py(), t.as_py()) for i, t in zip(batch.column(0), batch.column(1), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    bounded_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(mapped, SCHEMA)
