"""Similarity join: all pairs of texts whose Ratcliff-Obershelp ratio reaches a threshold; the ratio itself is computed for few.

The ratio is 2 M / (|a| + |b|), M the characters in matching blocks. Two ways lead to it, and both lose no pair that reaches the threshold.

By blocks: a block of texts of one side meets a block of the other under the same keys, in one task and in whole arrays. Matching blocks are a common subsequence, so M is
at most the characters that two texts have in common, counted with repeats, and at most their longest common subsequence. The first is a sum of minima of counts, some nanoseconds a
pair; the second eleven steps on words of 64 bits for names of eleven characters. That is all pairs, but in bounded memory, spread over all tasks, and in a time that a join's rows take a hundred times over.

By shared tokens: between two matching blocks at least one character of either text is unmatched, so there are at most
1 + |a| + |b| - 2 M blocks; a block of n characters shares its n - 1 pairs of neighbours with the other text. So texts of ratio t share at least

    (1.5 t - 1) (|a| + |b|) - 1

neighbouring pairs, counted with repeats, and neither is shorter than t / (2 - t) of the other. That is a set-overlap join: tokens are a text's pairs, the second
occurrence of one being another token, in one order for all texts, the rarest first. Texts of enough overlap share a token among the first few of each (prefix
filter); where such a token stands bounds what can follow (positional filter); then the overlap itself is counted, and the ratio computed for what is left. Texts so short that the bound
is no pair at all meet by their characters. At 0.7 and names of ten characters the bound is one pair, and a third of all names share one.

Blocks do up to BLOCK_PAIRS; of more, they do unless the tokens' counts say that fewer than one in PER_ROW pairs would be made. ``least`` has to be over 2/3, below which the bound on pairs of neighbours says nothing.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strictbefore.functions.text import ratio
from strictbefore.sources.sinks import stored

#: Distinct tokens whose frequencies are sent to all tasks; more of them meet the texts by a shuffle.
BROADCAST_ROWS = 500_000
#: Texts, and characters, of a block; pairs of blocks a task; left texts compared at a time.
BLOCK, BLOCK_CHARS, TASK_BLOCKS, STRIP = 2048, 2**21, 64, 256
#: Pairs that blocks compare without asking how many the tokens would make, and how many they compare in the time of one of those.
BLOCK_PAIRS, PER_ROW = 2**33, 100
#: Characters are told apart by their code modulo this.
BINS = 64


def pairs_of(text: Column) -> Column:
    """The pairs of neighbouring characters, each with the number of its occurrence."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(0))), lambda i: F.substring(text, i, F.lit(2)))
    grams = F.when(F.length(text) > 1, grams).otherwise(F.array().cast("array<string>"))
    numbered = lambda gs: F.transform(gs, lambda g, i: F.concat(g, F.lit("\x01"), F.size(F.filter(F.slice(gs, F.lit(1), i + 1), lambda h: h == g)).cast("string")))
    # bound once, as the text's pairs are used for every one of them
    return F.get(F.transform(F.array(grams), numbered), F.lit(0))


def shared_at_least(a: Column, b: Column, least: float) -> Column:
    """How many pairs two texts of these lengths must share to reach the ratio."""
    return F.greatest(F.ceil((1.5 * least - 1) * (a + b) - 1 - 1e-9), F.lit(0))


def counted(texts: list[str], tokens: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths; how often a text has each bin; and all its bins in one array with the text's number beside it. ``tokens`` = 2: bins of pairs of neighbours."""
    lengths = np.fromiter(map(len, texts), "int64", len(texts))
    codes, of = np.frombuffer("".join(texts).encode("utf-32-le"), "uint32").astype("int64"), np.repeat(np.arange(len(texts)), lengths)
    if tokens == 2:
        inner = of[1:] == of[:-1]
        codes, of = (codes[:-1] * 31 + codes[1:])[inner], of[1:][inner]
    bins = codes % BINS
    counts = np.bincount(of * BINS + bins, minlength=len(texts) * BINS).reshape(len(texts), BINS)
    most = int(lengths.max(initial=0))
    return lengths, counts.astype("uint8" if most < 2**8 else "uint16" if most < 2**16 else "uint32"), bins, of


def common_subsequences(left: tuple, right: tuple, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of texts (by number), the left one of 64 characters at most; characters of a bin count as equal.

    A bit a character of the left text; a step for each character of the right one (Hyyro).
    """
    (n, _, bins, of), (m, _, bins2, of2) = left, right
    first, first2 = np.cumsum(n) - n, np.cumsum(m) - m
    at = np.arange(len(bins)) - first[of]
    masks = np.zeros((len(n), BINS + 1), "uint64")
    short = at < 64
    np.bitwise_or.at(masks, (of[short], bins[short]), np.left_shift(np.uint64(1), at[short].astype("uint64")))
    places = np.full((len(m), int(m[np.unique(other)].max(initial=0))), BINS)
    at2 = np.arange(len(bins2)) - first2[of2]
    inside = at2 < places.shape[1]
    places[of2[inside], at2[inside]] = bins2[inside]
    rows = np.full(len(one), ~np.uint64(0))
    for step in range(places.shape[1]):
        u = rows & masks[one, places[other, step]]
        rows = (rows + u) | (rows - u)
    size = n[one].astype("uint64")
    low = np.where(size >= 64, ~np.uint64(0), np.left_shift(np.uint64(1), np.minimum(size, np.uint64(63))) - np.uint64(1))
    return np.bitwise_count(~rows & low).astype("int64")


def candidates(a: list[str], b: list[str], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of numbers of texts of ``a`` and ``b`` that may reach the ratio, a few at a time; all that do are among them."""
    a_order, b_order = np.argsort([len(x) for x in a], kind="stable"), np.argsort([len(x) for x in b], kind="stable")
    a, b = [a[i] for i in a_order], [b[i] for i in b_order]
    left, right = counted(a), counted(b)
    (n, counts, *_), (m, counts2, *_) = left, right
    used = np.flatnonzero(counts.any(axis=0) & counts2.any(axis=0))
    kind = np.promote_types(counts.dtype, counts2.dtype)
    mine, theirs = (np.ascontiguousarray(c[:, used].T.astype(kind)) for c in (counts, counts2))
    pairs, pairs2 = (counted(x, 2)[1].astype("int64") for x in (a, b)) if len(n) and n[-1] > 64 else (None, None)
    at = 0
    while at < len(n):
        size = int(n[at])
        end = min(int(np.searchsorted(n, size, "right")), at + STRIP)
        low, high = np.searchsorted(m, math.ceil(size * least / (2 - least) - 1e-9)), np.searchsorted(m, math.floor(size * (2 - least) / least + 1e-9), "right")
        shared = np.zeros((end - at, high - low), kind)
        for mine_of, theirs_of in zip(mine, theirs, strict=True):
            shared += np.minimum(mine_of[at:end, None], theirs_of[None, low:high])
        need = np.ceil(least * (size + m[low:high]) / 2 - 1e-9).astype("int64")
        one, other = np.nonzero(shared >= need.astype(kind, casting="unsafe"))
        need, one, other = need[other], one + at, other + low
        # what is left by the second bound, a bounded number at a time
        for k in range(0, len(one), 2**17):
            x, y, least_m = one[k : k + 2**17], other[k : k + 2**17], need[k : k + 2**17]
            if size <= 64:
                ok = common_subsequences(left, right, x, y) >= least_m
            else:
                ok = np.concatenate([np.minimum(pairs[x[i : i + 4096]], pairs2[y[i : i + 4096]]).sum(axis=1) >= (1.5 * least - 1) * (size + m[y[i : i + 4096]]) - 1 - 1e-9 for i in range(0, len(x), 4096)])
            yield a_order[x[ok]], b_order[y[ok]]
        at = end


def compared(batches: Iterator[pa.RecordBatch], keys: list[str], least: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks (keys, texts, texts2) to pairs of texts with their ratios."""
    for batch in batches:
        for row in range(batch.num_rows):
            a, b = batch["texts"][row].as_py(), batch["texts2"][row].as_py()
            for one, other in candidates(a, b, least):
                by = np.argsort(other, kind="stable")
                matcher, last, found = difflib.SequenceMatcher(None), -1, []
                for i, k in zip(one[by].tolist(), other[by].tolist(), strict=True):
                    if k != last:  # what the matcher knows of its second text serves all first ones
                        matcher.set_seq2(b[k])
                        last = k
                    matcher.set_seq1(a[i])
                    if (r := matcher.ratio()) >= least:
                        found.append((a[i], b[k], r))
                if found:
                    columns = [*(batch[c].take(pa.array([row] * len(found))) for c in keys), *map(pa.array, zip(*found, strict=True))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def by_blocks(sides: DataFrame, sizes: DataFrame, blocks: int, least: float, keys: list[str]) -> DataFrame:
    """All pairs of ``sides`` (side, keys, text, n) that reach the ratio. ``sizes`` has the number of blocks of either side by key, ``blocks`` the pairs of blocks of all keys.

    Both sides' blocks are repeated for the other side's, so that pairs of blocks are spread over tasks by all their numbers, whatever a key's share.
    """
    spark = sides.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, math.ceil(blocks / TASK_BLOCKS))
    met = sides.join(sizes, keys) if keys else sides.crossJoin(F.broadcast(sizes))

    def side(which: int, own: str, other: str, texts: str, names: tuple[str, str]) -> DataFrame:
        rows = met.filter(F.col("side") == which).groupBy(*keys, own, other, F.pmod(F.xxhash64("text"), own).alias(names[0])).agg(F.collect_list("text").alias(texts))
        rows = rows.withColumn(names[1], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return rows.select(*keys, "_l", "_r", texts).repartition(parts, *keys, "_l", "_r")

    pairs = side(0, "_blocks", "_blocks2", "texts", ("_l", "_r")).join(side(1, "_blocks2", "_blocks", "texts2", ("_r", "_l")), [*keys, "_l", "_r"]).drop("_l", "_r")
    out = T.StructType([*(sides.schema[k] for k in keys), T.StructField("text", T.StringType()), T.StructField("text2", T.StringType()), T.StructField("ratio", T.DoubleType())])
    schema = to_arrow_schema(out)
    return pairs.mapInArrow(lambda batches: compared(batches, keys, least, schema), out)


def similar(left: DataFrame, right: DataFrame, left_text: str, right_text: str, least: float = 0.85, keys: list[str] | None = None) -> DataFrame:
    """Distinct pairs of texts (keys, left_text, right_text, ratio) that agree on ``keys`` and reach the ratio. Null and empty texts match nothing."""
    if not 2 / 3 < least <= 1:
        raise ValueError("least must lie between 2/3 and 1")
    keys = keys or []
    texts = lambda rows, c: rows.filter(F.col(c) != "").select(*keys, F.col(c).alias("text")).distinct()
    sides = texts(left, left_text).withColumn("side", F.lit(0)).unionByName(texts(right, right_text).withColumn("side", F.lit(1))).dropna(subset=["text", *keys])
    sides = stored(sides.select("side", *keys, "text", F.length("text").alias("n")), "texts")
    number = lambda which: F.count(F.when(F.col("side") == which, 1))
    many = lambda which: F.ceil(F.greatest(number(which) / BLOCK, F.sum(F.when(F.col("side") == which, F.col("n"))) / BLOCK_CHARS))
    per = sides.groupBy(*keys).agg(number(0).alias("_n"), number(1).alias("_n2"), many(0).alias("_blocks"), many(1).alias("_blocks2")).filter("_n > 0 and _n2 > 0")
    whole = per.agg(F.sum(F.col("_n").cast("double") * F.col("_n2")).alias("pairs"), F.sum(F.col("_blocks") * F.col("_blocks2")).alias("blocks")).first()
    placed = by_pairs = None
    if (whole["pairs"] or 0) > BLOCK_PAIRS:
        placed = first_tokens(sides, least, keys)
        by_pairs = placed.groupBy(*keys, "token").agg((number(0).cast("double") * number(1)).alias("made")).agg(F.sum("made")).first()[0] or 0
    if placed is not None and by_pairs * PER_ROW < whole["pairs"]:
        near = by_tokens(placed, sides, least, keys)
        scored = near.withColumn("ratio", ratio(F.col("text"), F.col("text2"))).filter(F.col("ratio") >= least)
    else:
        scored = by_blocks(sides, per.select(*keys, "_blocks", "_blocks2"), whole["blocks"] or 0, least, keys)
    return scored.withColumnsRenamed({"text": left_text, "text2": right_text})


def first_tokens(sides: DataFrame, least: float, keys: list[str]) -> DataFrame:
    """The tokens of each text (side, keys, text, n) by which it may meet others, with all its tokens and the token's place among them."""
    sides = sides.withColumn("tokens", pairs_of(F.col("text")))
    each = sides.select("side", *keys, "text", "n", F.explode("tokens").alias("token"))
    often = stored(each.groupBy("token").agg(F.count("*").alias("often")), "token-counts")
    ranked = each.join(F.broadcast(often) if often.count() <= BROADCAST_ROWS else often.hint("merge"), "token")
    ordered = stored(ranked.groupBy("side", *keys, "text", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "token"))), lambda x: x["token"]).alias("tokens")), "ordered-texts")
    size, shortest = F.size("tokens"), F.ceil(F.col("n") * (least / (2 - least)) - 1e-9)
    prefix = size - F.greatest(shared_at_least(F.col("n"), shortest, least), F.lit(1)) + 1
    return ordered.select("side", *keys, "text", "n", "tokens", F.posexplode(F.slice("tokens", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int"))).alias("at", "token"))


def by_tokens(placed: DataFrame, sides: DataFrame, least: float, keys: list[str]) -> DataFrame:
    """Pairs (keys, text, text2) that share what texts of the ratio share."""
    one = placed.filter("side = 0").drop("side")
    other = placed.filter("side = 1").select(*keys, "token", F.col("text").alias("text2"), F.col("n").alias("n2"), F.col("tokens").alias("tokens2"), F.col("at").alias("at2"))
    need = shared_at_least(F.col("n"), F.col("n2"), least)
    lengths = (F.least("n", "n2") >= F.greatest("n", "n2") * (least / (2 - least)) - 1e-9)
    can_reach = F.least("at", "at2") + 1 + F.least(F.size("tokens") - F.col("at"), F.size("tokens2") - F.col("at2")) - 1 >= need
    met = one.join(other, [*keys, "token"]).filter(lengths & can_reach).select(*keys, "text", "text2", "n", "n2", "tokens", "tokens2").dropDuplicates([*keys, "text", "text2"])
    near = met.filter(F.size(F.array_intersect("tokens", "tokens2")) >= need).select(*keys, "text", "text2")
    # texts too short to have to share a pair of neighbours: their matching blocks are single characters, so they share a character
    short = sides.filter("side = 0").drop("side")
    few = sides.filter("side = 1").select(*keys, F.col("text").alias("text2"), F.col("n").alias("n2"))
    letters = lambda rows, c: rows.filter(F.length(c) * (2 / (2 - least)) <= 1 / (1.5 * least - 1) + 1e-6).withColumn("letter", F.explode(F.array_distinct(F.split(c, ""))))
    brief = letters(short, "text").join(letters(few, "text2"), [*keys, "letter"]).filter(lengths & (need <= 0)).select(*keys, "text", "text2")
    near = near.unionByName(brief)
    # equal texts need neither
    same = short.join(few.withColumnRenamed("text2", "text"), [*keys, "text"]).select(*keys, "text", F.col("text").alias("text2"))
    return near.unionByName(same).distinct()


def must_share(a: int, b: int, least: float) -> int:
    """``shared_at_least`` of two numbers."""
    return max(math.ceil((1.5 * least - 1) * (a + b) - 1 - 1e-9), 0)
