"""Near copies by word shingles: SimHash sketches find candidates, the texts' shingle sets decide.

Sketch: A-Z lower-cased, the distinct words ``[^\\x20\\x09-\\x0D]+``; each word's XXH64 is spread over WORDS 64-bit words, and a
bit is set if it is set in over half the words. An edit touches SHINGLE shingles but few of a text's words, so texts that
share 4 of 5 five-word shingles have sketches some 5 % of the bits apart, where those of the shingles themselves would be 15 %.

The sketch is embedded as in ``simhash``: bit counts of its two-bit segments, in unary. A grid cell is given by the counts
on AXES of the 128 axes, and one more for each doubling of the table beyond AXES_ROWS, so that a grid's cells grow in number as the rows do; there are BANDS grids on axes
drawn by a fixed seed, so that near copies share some cell with high probability. A cell of up to CELL members compares its pairs: the Manhattan distance of the embeddings, then the exact distance of
the sketches has to be within RADIUS, and then the sets of SHINGLE-word shingles have to have a Jaccard similarity of SIMILARITY.

A cell of over CELL is divided by more axes. Texts that share their words but not the order crowd a cell however many axes it has. So what MORE_AXES
don't divide gets a finer sketch, of the distinct ORDER-word shingles, and meets again in cells of the first axes and more and more axes of that one, drawn by grid, and at
the end in cells of all axes of both sketches. What is still crowded then has one embedding throughout, and is searched exactly by its shingle sets: the
Jaccard distance is a metric, so after all members of a cell have been compared with one of them, the leader, those linked with it can only be linked
with an unlinked one if their distances from the leader differ by no more than a link's. The others leave the cell with the leader, and so on until a cell has CELL members, whose pairs
are all compared, or all are linked with the leader.

The shingle test reads the candidates' texts. It is first made of each row's nearest candidate (ties by hash, so that no row is everyone's);
pairs whose ends are by then in one component need it no more.

The candidates are found by drawn grids, divided cells and a radius, so links can be missed: `near_pairs` and `candidates` find most, and leave families of near copies as few components.
The rest is found exactly (``complete``), by a set-overlap join of shingles between components. All texts' shingles stand in one order: the most frequent ones last, else
the longest first (long ones are seldom met by chance), then by hash. Frequencies are counted in all texts, of what repeats within a batch of them, and the OFTEN highest are sent to the workers; they only
decide the order, and every order finds the same links. Texts of enough similarity share a shingle among the first few of each (prefix filter). How many they share there bounds
how many they share at all; where that is enough the sets decide. Two bounds are looked at before a pair is made, as most texts that meet do so by chance: how many of a text's first
shingles any other text has among its own bounds what it shares with each (``reach``), and the texts' shingles hashed to PARITY bits, a bit for an odd number of them, differ in no more bits than
the sets do in shingles. Shingles of the same texts are one group, and where two texts have the same groups one after the other, a pair is made at the first and the last of these only. Where pairs would be over FULL times the rows, families are first joined through one text a shingle.
A shingle that isn't at the end of the order yet and whose texts of different components make over CROWD pairs goes there, and the texts that had it
among their first ones get more of their own instead, turn after turn; what then still has such shingles among its first ones is paired in full. So no link is lost between components, and
none is made that the texts don't bear out.

Defined cases: null, empty and blank texts are near to nothing. Rows are told apart by a key of their own, so ids may be
null or repeat; a null id counts after all others. Repeated rows are near copies of each other. Extra columns play no part. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictbefore.llm.common import BROADCAST_ROWS, bounded_batches, drop_rows, fresh, keyed, materialise, trim
from strictbefore.llm.simhash import LOWER, SEED, components, embedding, signed

SHINGLE, SIMILARITY = 5, 0.8
WORDS, RADIUS = 4, 40
BANDS, CELL = 32, 12
AXES, AXES_ROWS, ORDER = 12, 1 << 16, 3
#: Axes by which a crowded cell is divided more, and then axes of the finer sketch, one number after the other; at the end all of both.
MORE_AXES, FINER_AXES = (6,), (6, 16)
#: Pairs of a shingle's texts beyond which it goes to the end of the order, turns of that, and texts of a shingle that are paired at a time.
CROWD, TURNS, BLOCK = 500, 4, 256
#: Frequent shingles that stand last in the order from the start, and pairs a row up to which all are made without more ado.
OFTEN, FULL = 1 << 17, 8
#: Longs of a text's parity bits.
PARITY = 8
#: Words spread at a time.
STEP = 1 << 14
#: Odd multipliers of a 64-bit finaliser.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


NAMES, FINER = [f"s{k}" for k in range(WORDS)], [f"z{k}" for k in range(WORDS)]
ODD = [f"o{k}" for k in range(PARITY)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()  # bytes.split() splits at [\x20\x09-\x0D]


def shingles_of(text: str | None, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct XXH64 of a text's shingles, ascending, and the lengths of these; a text of fewer words is one shingle."""
    words = words_of(text)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes, first = np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)], "<u8"), return_index=True)
    return hashes, (np.array(ends, np.int64) - np.array(starts[: len(ends)], np.int64))[first]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, ascending."""
    return shingles_of(text, shingle)[0]


def parity(hashes: np.ndarray) -> np.ndarray:
    """PARITY signed 64-bit words: which of their bits an odd number of the hashes fall on. Those of two sets differ in as many bits as the sets do in hashes, or in fewer."""
    return np.packbits(np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1, bitorder="little").view("<i8")


def first_of(size: int, similarity: float) -> int:
    """How many first shingles of a text of ``size`` are compared: without them too few are left for a link."""
    return size - math.ceil(size * similarity - 1e-9) + 1


def spread(hashes: np.ndarray) -> np.ndarray | None:
    """WORDS signed 64-bit words: the bits set in over half the hashes, each spread over as many words; null without hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), STEP):
        z = hashes[at : at + STEP, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(MIX[2])
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[0])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[1])
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8).reshape(len(z), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8") if len(hashes) else None


def sketch(text: str | None) -> np.ndarray | None:
    """The sketch of a text's distinct words; null for a text without words."""
    digest = xxhash.xxh64_intdigest
    words = set(words_of(text))
    return spread(np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words)))


def order_sketch(text: str | None) -> np.ndarray | None:
    """The sketch of a text's distinct ORDER-word shingles."""
    return spread(shingle_hashes(text, ORDER)) if words_of(text) else None


def sketches(docs: DataFrame, row: str, id_col: str, text_col: str) -> DataFrame:
    """node, row, s0, s1, ...: nodes are longs in the order of ids, null ids last."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, s) for i, s in enumerate(sketch(x.as_py()) for x in batch.column(2)) if s is not None]
            kept = pa.array([i for i, _ in found], pa.int64())
            words = np.stack([s for _, s in found]) if found else np.zeros((0, WORDS), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), *[pa.array(words[:, k]) for k in range(WORDS)]], names=["row", "id", *names])
        trim()

    names = NAMES
    bounded_batches(docs.sparkSession)
    narrow = docs.select(docs[row].alias("row"), docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    made = materialise(narrow.mapInArrow(mapped, f"row {narrow.schema['row'].dataType.simpleString()}, id long, {', '.join(f'{n} long' for n in names)}"), "sketches")
    order = [F.col("id").isNull(), "id", "row"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = made.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialise(ordered.select(F.monotonically_increasing_id().alias("node"), "row", *names), "nodes")


def finer_sketches(texts: DataFrame) -> DataFrame:
    """node, z0, z1, ... of a table of nodes and texts."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array([order_sketch(x.as_py()) for x in batch.column(1)], np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(words[:, k]) for k in range(WORDS)]], names=["node", *FINER])
        trim()

    bounded_batches(texts.sparkSession)
    return materialise(texts.mapInArrow(mapped, f"node long, {', '.join(f'{n} long' for n in FINER)}"), "finer-sketches")


def grids(bands: int, axes: int, finer_axes: int = 0, seed: int = 0) -> Column:
    """Per grid its number and its masks over each of the sketch's words and of the finer one's, as one literal array; a grid of fewer axes has the first of them."""
    out = []
    for band in range(bands):
        fields = [F.lit(band).alias("band")]
        for kind, n in enumerate((axes, finer_axes)):
            masks = [0] * WORDS
            for axis in np.random.default_rng((seed, band, kind) if kind else (seed, band)).permutation(32 * WORDS)[:n].tolist():
                masks[axis // 32] |= 3 << (2 * (axis % 32))
            fields += [F.lit(signed(m)).cast("long").alias(f"{'mf'[kind]}{k}") for k, m in enumerate(masks)]
        out.append(F.struct(*fields))
    return F.array(*out)


def cell(grid: Column, finer: bool = False) -> Column:
    """The cell of embedding e0, e1, ..., and g0, g1, ... of the finer sketch, in a grid."""
    parts = [F.col(f"e{k}").bitwiseAND(grid[f"m{k}"]) for k in range(WORDS)]
    return F.xxhash64(grid["band"], *parts, *([F.col(f"g{k}").bitwiseAND(grid[f"f{k}"]) for k in range(WORDS)] if finer else []))


def candidates(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame] | None = None, bands: int = BANDS, most: int = CELL, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs a < b of nodes that share a cell and whose sketches are within ``radius``, by their distance; and the cells (cell, node) that no axis divides.

    ``texts_of`` gives the texts of some nodes, for the finer sketch.
    """
    points = nodes.select("node", *NAMES, *[embedding(F.col(n)).alias(f"e{k}") for k, n in enumerate(NAMES)])
    base = AXES + max(0, math.ceil(math.log2(max(nodes.count(), 1) / AXES_ROWS)))
    at = F.explode(F.transform(grids(bands, base), lambda g: F.struct(g["band"].alias("band"), cell(g).alias("cell"))))
    placed = points.select("node", *NAMES, at.alias("at")).select("node", *NAMES, "at.band", "at.cell")
    apart = lambda of: sum((F.bit_count(of(F.col(n)).bitwiseXOR(of(F.col(f"{n}_b")))) for n in NAMES), F.lit(0))
    near = (apart(embedding) <= radius) & (apart(lambda c: c) <= radius)
    found = None
    steps = [*[(base + n, 0) for n in MORE_AXES], *[(base, n) for n in FINER_AXES], (32 * WORDS, 32 * WORDS)]
    both = points
    while True:
        members = materialise(placed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "cells")
        held = placed.join(members.filter(F.col("n") <= most).select("cell"), "cell").select("cell", "node", *NAMES)
        other = held.select("cell", F.col("node").alias("b"), *[F.col(n).alias(f"{n}_b") for n in NAMES])
        pairs = held.join(other, (held["cell"] == other["cell"]) & (F.col("node") < F.col("b")) & near).select(F.col("node").alias("a"), "b", apart(lambda c: c).alias("distance"))
        found = pairs if found is None else found.unionByName(pairs)
        crowd = members.filter(F.col("n") > most)
        if not steps or not crowd.count():
            break
        axes, finer_axes = steps.pop(0)
        crowded = placed.join(crowd.select("cell"), "cell", "left_semi").select("node", "band")
        if finer_axes == FINER_AXES[0]:
            if texts_of is None:
                finer = nodes.select("node", *[F.col(n).alias(z) for n, z in zip(NAMES, FINER, strict=True)])
            else:
                finer = finer_sketches(texts_of(materialise(crowded.select("node").distinct(), "crowded-nodes")))
            both = materialise(points.join(finer.select("node", *[embedding(F.col(z)).alias(f"g{k}") for k, z in enumerate(FINER)]), "node"), "finer-points")
        own = crowded.join(both, "node").withColumn("grid", F.element_at(grids(bands, axes, finer_axes), F.col("band") + 1))
        placed = materialise(own.select("node", *NAMES, "band", cell(F.col("grid"), finer_axes > 0).alias("cell")), "crowded")
    # with all axes, a node's cells are the same in all grids: one stands for them
    same = placed.join(crowd.select("cell"), "cell", "left_semi").filter("band = 0").select("cell", "node")
    return found.distinct(), materialise(same, "undivided")


def near_pairs(nodes: DataFrame, bands: int = BANDS, most: int = CELL, radius: int = RADIUS) -> DataFrame:
    """The pairs that the sketches alone find."""
    return candidates(nodes, None, bands, most, radius)[0]


def peeled(cells: DataFrame, sets: DataFrame, similarity: float, most: int = CELL) -> tuple[DataFrame | None, DataFrame | None]:
    """Links (a, b) that connect whatever of a cell is linked, and pairs still to be tested: an exact search of cells (cell, node) of any size.

    A round compares a cell's members with its leader. It ends for a cell whose members are all linked with the leader; what stays are the
    unlinked members and those linked ones that may be near enough to them.
    """
    state, links, pairs = cells.withColumn("held", F.lit(False)), None, None
    while not state.isEmpty():
        about = materialise(state.groupBy("cell").agg(F.count("*").alias("n"), F.min(F.struct("held", "node")).alias("first")), "leaders")
        few = state.join(about.filter(F.col("n") <= most).select("cell"), "cell").select("cell", "node")
        more = few.select("cell", F.col("node").alias("a")).join(few.select("cell", F.col("node").alias("b")), "cell").filter("a < b").select("a", "b")
        pairs = more if pairs is None else pairs.unionByName(more)
        leaders = about.filter(F.col("n") > most).select("cell", F.col("first.node").alias("leader")).join(sets.toDF("leader", "x"), "leader")
        met = state.join(leaders, "cell").join(sets.toDF("node", "y"), "node")
        shared = F.size(F.array_intersect("x", "y"))
        apart = 1 - shared / (F.size("x") + F.size("y") - shared)
        seen = materialise(met.filter("node != leader").select("cell", "node", "leader", "held", apart.alias("apart")), "compared")
        linked = F.col("apart") <= 1 - similarity + 1e-12
        new = seen.filter(linked).select(F.col("leader").alias("a"), F.col("node").alias("b"))
        links = new if links is None else links.unionByName(new)
        nearest = seen.filter(~linked).groupBy("cell").agg(F.min("apart").alias("least"))
        state = materialise(seen.join(nearest, "cell").filter(~linked | (F.col("apart") >= F.col("least") - (1 - similarity) - 1e-9)).select("cell", "node", (F.col("held") | linked).alias("held")), "peeled")
    return links, pairs


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node, shingles (their hashes, distinct) of a table of nodes and texts."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(x.as_py(), shingle).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])
        trim()

    bounded_batches(texts.sparkSession)
    return materialise(texts.mapInArrow(mapped, "node long, shingles array<long>"), "shingle-sets")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the Jaccard similarity or more."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    every = F.size("x") + F.size("y")
    return both.withColumn("shared", shared).filter(F.col("shared") >= similarity * (every - F.col("shared"))).select("a", "b")


def often(texts: DataFrame, shingle: int, most: int = OFTEN) -> DataFrame:
    """shingle, n: frequent shingles of a column of texts, ``most`` at most; n: how many texts have it, of the batches in which more than one has."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.concatenate([shingle_hashes(x.as_py(), shingle) for x in batch.column(0)] or [np.zeros(0, "<u8")])
            found, counts = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[counts > 1].view(np.int64)), pa.array(counts[counts > 1])], names=["shingle", "n"])
        trim()

    bounded_batches(texts.sparkSession)
    found = materialise(texts.mapInArrow(mapped, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "repeated")
    least, held = 1001, 0
    for n, count in sorted(found.groupBy(F.least("n", F.lit(1000)).alias("n")).count().collect(), reverse=True):
        held += count
        if held > most and least < 1001:
            break
        least = n
    kept = found.filter(F.col("n") >= least)
    return materialise(kept.limit(most), "often") if held > most and least == 1000 else kept


def ordered_shingles(texts: DataFrame, key: str, shingle: int, similarity: float, whole: bool = False, last: DataFrame | None = None) -> DataFrame:
    """key, size, shingles, parity of a table (key, text) of texts with words: the first shingles in the order, or all; ``size`` counts and ``parity`` covers all.

    ``last`` (shingle, n): shingles at the end of the order, by n.
    """
    shipped = None
    if last is not None:
        table = last.select("shingle", "n").toArrow()
        known, weights = table["shingle"].to_numpy().view(np.uint64), table["n"].to_numpy()
        by_hash = np.argsort(known)
        shipped = texts.sparkSession.sparkContext.broadcast((known[by_hash], weights[by_hash])) if len(known) else None

    def late(hashes: np.ndarray) -> np.ndarray:
        if shipped is None:
            return np.zeros(len(hashes), np.int64)
        known, weights = shipped.value
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, weights[at], 0)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, lists, odd = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                hashes, lengths = shingles_of(text.as_py(), shingle)
                if len(hashes):
                    kept.append(i)
                    sizes.append(len(hashes))
                    odd.append(parity(hashes))
                    most = len(hashes) if whole else first_of(len(hashes), similarity)
                    lists.append(hashes[np.lexsort((hashes, -lengths, late(hashes)))[:most]].view(np.int64))
            columns = [pa.array(sizes, pa.int32()), pa.array(lists, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), *columns], names=[key, "size", "shingles", "parity"])
        trim()

    bounded_batches(texts.sparkSession)
    return texts.mapInArrow(mapped, f"{key} {texts.schema[key].dataType.simpleString()}, size int, shingles array<long>, parity array<long>")


def sent(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table.hint("merge")


def shared_by_texts(placed: DataFrame) -> DataFrame:
    """The rows of ``placed`` whose shingle more than one text has."""
    own = Window.partitionBy("shingle")
    seen = placed.select("shingle", "node", "size").withColumn("least", F.min("node").over(own)).withColumn("most", F.max("node").over(own)).filter("least < most")
    return materialise(seen.select("shingle", "node", "size"), "shared-shingles")


def reach(size: Column, met: Column, similarity: float) -> Column:
    """The size of the largest text that can be a link of one of ``size``, if of the two its first shingles end first in the order, and other texts have ``met`` of these among theirs.

    All that the other has of its first shingles are among the other's first ones then, so they share no more than ``met`` and what lies behind them.
    """
    return (met + F.ceil(size * similarity - 1e-9) - 1 + 1e-6) * ((1 + similarity) / similarity) - size


def between(shared: DataFrame, links: DataFrame) -> DataFrame:
    """shingle, node, size, reach, root, front, same: the rows of ``shared`` whose shingle is met in more than one of the links' components, and by a text within reach or whose reach they are in.

    Shingles of the same texts have one ``same``, a hash, and ``front``, the first of these.
    """
    roots = components(links)
    rooted = shared.select("shingle", "node", "size", "reach").join(sent(roots, roots.count()), "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = Window.partitionBy("shingle")
    bounds = {"least": F.min("root"), "most": F.max("root"), "smallest": F.min("size"), "furthest": F.max("reach"), "front": F.min("node"), "held": F.count("*"), "mark": F.bit_xor(F.xxhash64("node"))}
    seen = rooted.withColumns({name: c.over(own) for name, c in bounds.items()})
    seen = seen.filter((F.col("least") < F.col("most")) & ((F.col("smallest") <= F.col("reach")) | (F.col("size") <= F.col("furthest"))))
    return materialise(seen.select("shingle", "node", "size", "reach", "root", "front", F.xxhash64("front", "held", "mark").alias("same")), "between")


def grouped(shared: DataFrame, odd: DataFrame | None) -> DataFrame:
    """The rows of ``shared`` with shingles of the same texts made one: same, front, node, size, reach, root, w (shingles), upto (a running sum of w by node), before and after (the node's ``same`` on either side), and parity bits."""
    one = shared.groupBy("same", "front", "node").agg(F.count("*").alias("w"), *[F.first(c).alias(c) for c in ("size", "reach", "root")])
    along = Window.partitionBy("node").orderBy("front", "same")
    out = one.withColumns({"upto": F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, 0)), "before": F.lag("same").over(along), "after": F.lead("same").over(along)})
    return materialise(out if odd is None else out.join(odd.hint("merge"), "node"), "groups")


def pair_numbers(shared: DataFrame) -> DataFrame:
    """shingle, n, pairs: how many rows of ``shared`` have a shingle, and how many pairs of different components they make."""
    sizes = shared.groupBy("shingle", "root").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
    return materialise(sizes.select("shingle", "n", ((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs")), "shingle-sizes")


def enough(met: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs of rows (a, n, b, m, k) that can be links; k sums to the number of first shingles that texts a and b of n and m shingles share.

    Of the text whose first ones end first in the order, all else stands behind these; so beside the shared first ones, the texts share no more
    than what lies behind the first ones of the larger.
    """
    counted = met.groupBy("a", "b").agg(F.sum("k").alias("k"), F.first("n").alias("n"), F.first("m").alias("m"))
    behind = F.ceil(F.greatest("n", "m") * similarity - 1e-9) - 1
    return counted.filter(F.col("k") + behind >= F.ceil((F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-9)).select("a", "b")


def complete(placed: DataFrame, links: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingle: int, similarity: float, crowd: int = CROWD, turns: int = TURNS, ends: DataFrame | None = None, odd: DataFrame | None = None) -> DataFrame:
    """``links``, and links that join all components between which there is a link. ``placed``: node, size, shingle of every text's first shingles in the order that ends with ``ends``.

    ``odd``: every node's parity bits, o0, o1, ...
    """

    def tested(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "overlaps")
        asked = materialise(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "asked")
        return materialise(alike(pairs, shingle_sets(texts_of(asked), shingle), similarity), "rest-links")

    bits = [] if odd is None else ODD
    side = lambda node, size: [F.col("node").alias(node), F.col("size").alias(size), *[F.col(c).alias(f"{node}_{c}") for c in ("root", "reach", "before", "after", *bits)]]
    alike_sizes = (F.col("n") >= F.col("m") * similarity - 1e-9) & (F.col("m") >= F.col("n") * similarity - 1e-9)
    possible = (F.col("a_root") != F.col("b_root")) & alike_sizes & ((F.col("m") <= F.col("a_reach")) | (F.col("n") <= F.col("b_reach")))
    if bits:
        apart = sum((F.bit_count(F.col(f"a_{o}").bitwiseXOR(F.col(f"b_{o}"))) for o in bits), F.lit(0))
        possible &= apart <= F.col("n") + F.col("m") - 2 * F.ceil((F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-9)
    # a stretch of groups that both texts have one after the other is met at its ends only
    begins, ends_here = (F.coalesce(F.col(f"a_{c}") != F.col(f"b_{c}"), F.lit(True)) for c in ("before", "after"))
    counted = F.when(ends_here, F.col("upto")).otherwise(0) - F.when(begins, F.col("upto") - F.col("w")).otherwise(0)
    current, last = placed, None if ends is None else ends.select("shingle")
    for turn in range(turns + 1):
        seen = shared_by_texts(placed)
        # in later turns, what a text shares isn't all there
        met = F.col("size") if turn else F.count("*").over(Window.partitionBy("node"))
        shared = between(seen.withColumn("reach", reach(F.col("size"), met, similarity)), links)
        sizes = pair_numbers(shared)
        rows, made, most = sizes.agg(F.sum("n"), F.sum("pairs"), F.max("pairs")).first()
        if rows is None:
            break
        if made > FULL * rows:
            # first of all with a shingle's leader, one partner a text: that makes one component of most families
            groups = grouped(shared, odd)
            leaders = groups.filter("node = front").select("same", *side("a", "n"))
            led = groups.select("same", *side("b", "m"), F.col("w").alias("k")).join(leaders, "same").filter(possible)
            one = enough(led, similarity).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
            links = links.unionByName(tested(one))
            shared = between(shared, links)
            sizes = pair_numbers(shared)
        moved, staying = None, shared
        if most > crowd and turn < turns:
            heavy = sizes.filter(F.col("pairs") > crowd).select("shingle")
            heavy = materialise(heavy if last is None else heavy.join(last, "shingle", "left_anti"), "heavy")
            if not heavy.isEmpty():
                # texts that get other first shingles are compared by these, in the next turn
                moved = materialise(seen.join(heavy, "shingle", "left_semi").select("node").distinct(), "moved")
                staying = shared.join(moved, "node", "left_anti")
        staying = grouped(staying, odd)
        staying = staying.join(staying.groupBy("same").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "same")
        left = staying.select("same", "w", "upto", *side("a", "n"), F.pmod(F.xxhash64("node"), "blocks").alias("block"))
        right = staying.select("same", *side("b", "m"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        pairs = left.join(right.hint("merge"), ["same", "block"]).filter((F.col("a") < F.col("b")) & possible & (begins | ends_here)).withColumn("k", counted)
        links = links.unionByName(tested(enough(pairs, similarity)))
        if moved is None:
            break
        last = heavy if last is None else last.unionByName(heavy)
        each = ordered_shingles(texts_of(moved), "node", shingle, similarity, True, ends).select("node", "size", F.posexplode("shingles").alias("at", "shingle"))
        late = each.join(last.withColumn("late", F.lit(1)), "shingle", "left").withColumn("late", F.coalesce("late", F.lit(0)))
        rank = F.row_number().over(Window.partitionBy("node").orderBy("late", "at"))
        first = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
        new = materialise(late.withColumn("rank", rank).filter(F.col("rank") <= first).select("node", "size", "shingle"), "moved-shingles")
        current = current.join(moved, "node", "left_anti").unionByName(new)
        placed = current.join(new.select("shingle").distinct(), "shingle", "left_semi").select("node", "size", "shingle")
    return links


def near_copies(docs: DataFrame, row: str, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """row, node, root of every row with a near copy; a component's root is its row of smallest id. ``row`` is docs' key column."""
    nodes = sketches(docs, row, id_col, text_col)
    (node, own) = fresh(docs, "node", "own")

    def texts_of(some: DataFrame) -> DataFrame:
        asking = some.join(nodes.select("node", "row"), "node").select("node", "row").toDF(node, own)
        asking = F.broadcast(asking) if some.count() <= BROADCAST_ROWS else asking.hint("merge")
        return docs.join(asking, docs[row] == F.col(own)).select(F.col(node).alias("node"), docs[text_col].cast("string").alias("text"))

    found, cells = candidates(nodes, texts_of, radius=radius)
    pairs = materialise(found, "near-pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(cells.select("node")).distinct()
    asked = materialise(ends, "asked")
    sets = shingle_sets(texts_of(asked), shingle)
    same, few = peeled(cells, sets, similarity)
    nearest = pairs.groupBy("b").agg(F.min_by("a", F.struct("distance", F.xxhash64("a", "b"), "a")).alias("a")).select("a", "b")
    first = alike(nearest, sets, similarity)
    for more in (same, None if few is None else alike(few, sets, similarity)):
        first = first if more is None else first.unionByName(more)
    first = materialise(first, "first-links")
    roots = components(first)
    joined = pairs.select("a", "b").join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    # a node without a link is a component of its own
    apart = joined.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").join(nearest, ["a", "b"], "left_anti")
    links = first.unionByName(materialise(alike(apart, sets, similarity), "more-links"))
    named = nodes.select(F.col("row").alias(own), F.col("node").alias(node))
    texts = docs.select(docs[row].alias("row"), docs[text_col].cast("string").alias("text"))
    ends = often(texts.select("text"), shingle)
    firsts = ordered_shingles(texts, "row", shingle, similarity, last=ends).join(named.hint("merge"), F.col("row") == F.col(own)).select(F.col(node).alias("node"), "size", "shingles", "parity")
    firsts = materialise(firsts, "first-shingles")
    odd = firsts.select("node", *[F.get("parity", F.lit(k)).alias(o) for k, o in enumerate(ODD)])
    placed = firsts.select("node", "size", F.explode("shingles").alias("shingle"))
    links = complete(placed, links, texts_of, shingle, similarity, ends=ends, odd=odd)
    return components(links).join(nodes.select("node", "row"), "node").select("row", "node", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, of which each component of near copies keeps the one of smallest id."""
    (row,) = fresh(docs, "row")
    docs = keyed(docs, row)
    gone = materialise(near_copies(docs, row, id_col, text_col).filter("node != root").select("row"), "near-drops")
    return drop_rows(docs, row, gone, gone.count())
