"""SimHash near-duplicate components by a segment-popcount embedding.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, SHINGLE-word shingles with repeats, joined by a space (fewer words:
the whole sequence; none: fingerprint zero); a bit is set if it is set in over half the shingles' XXH64 (seed 42).

Links are pairs at RADIUS or fewer differing bits. Each fingerprint is mapped to the bit counts of its 32 two-bit
segments. Counts are held in unary in the segment's own two bits, so the Manhattan distance of two embeddings is the
popcount of an xor, and it is a lower bound of the fingerprints' distance. The embedding's axes form RADIUS + 2 groups;
a Manhattan distance of RADIUS or less leaves at least two groups without a difference. So there is a grid for every pair of
groups: its cells are of width 1 on these groups' axes, and of width RADIUS + 1 on one more, the sum of all other counts,
which differs by RADIUS at most. The ends of every link lie in one cell of some grid or in two neighbouring ones of
it: a point is joined with its cell and with the next. There the Manhattan bound and then the exact distance decide.

Documents enter the join as distinct fingerprints. A cell of over CELL of these doesn't compare its pairs: its
fingerprints are linked through midpoints instead. Two fingerprints within two bits have a common neighbour within one
bit of each, so every fingerprint names itself and its 64 neighbours, and each midpoint links those that name it to the
smallest. That is exact too and takes 65 rows a fingerprint.

Components come from alternating large-star and small-star rounds over the links, each round a written table.

Defined cases: null and empty texts have fingerprint zero and are linked like any other. Null ids take part and count
after every other id. Repeated rows give repeated rows. Extra columns play no part. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strictbefore.llm.common import bounded_batches, materialise

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Distinct fingerprints of a cell that are compared pair by pair: up to 65 a midpoint star would take more rows.
CELL = 65
#: Fingerprints of at least 1 / COMMON of all rows are joined by broadcast, COMMON rows at most.
COMMON = 1000
#: Shingles hashed at a time, so that memory doesn't grow with a text.
STEP = 1 << 16

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().translate(LOWER).split()  # bytes.split() splits at [\x20\x09-\x0D]
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = max(len(words) - shingle + 1, 1)
    ends = ends[min(shingle, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, last, STEP):
        cut = zip(starts[at : min(at + STEP, last)].tolist(), ends[at : min(at + STEP, last)].tolist(), strict=True)
        hashed = np.array([digest(joined[a:b], SEED) for a, b in cut], "<u8")
        ones += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """id, fp: one row per document, the fingerprint as a signed long."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(mapped, "id long, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the two-bit segments, in unary: 0 -> 00, 1 -> 01, 2 -> 11."""
    even = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(even), 1))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def cells(radius: int = RADIUS) -> list[int]:
    """The masks of the grids: every pair of radius + 2 groups of segments."""
    groups = [0] * (radius + 2)
    for segment in range(32):
        groups[segment % (radius + 2)] |= 3 << (2 * segment)
    return [signed(a | b) for a, b in combinations(groups, 2)]


def links(points: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Links a < b between distinct fingerprints ``points`` (fp): enough of them that every component is connected."""
    if radius > 2:
        raise ValueError("cells of many fingerprints are linked through midpoints, which reach two bits")
    grids = F.array(*[F.struct(F.lit(i).alias("grid"), F.col("emb").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(cells(radius))])
    placed = points.withColumn("emb", embedding(F.col("fp"))).select("fp", "emb", F.explode(grids).alias("at")).select("fp", "emb", "at.grid", "at.cell")
    counts = placed.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    counts = materialise(counts, "cells")
    few, many = counts.filter(F.col("n") <= cell).select("grid", "cell"), counts.filter(F.col("n") > cell).select("grid", "cell")
    rest = F.bit_count("emb") - F.bit_count("cell")
    held = placed.join(few, ["grid", "cell"]).withColumn("slab", F.floor(rest / (radius + 1)))
    other = held.select("grid", "cell", F.col("fp").alias("fp2"), F.col("emb").alias("emb2"), F.posexplode(F.array("slab", F.col("slab") - 1)).alias("next", "slab"))
    near = (F.bit_count(F.col("emb").bitwiseXOR(F.col("emb2"))) <= radius) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
    met = held.join(other, ["grid", "cell", "slab"]).filter(((F.col("next") == 1) | (F.col("fp") < F.col("fp2"))) & near)
    pairs = met.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b"))
    if radius == 0:
        return pairs
    crowded = placed.join(many, ["grid", "cell"], "left_semi").select("fp").distinct()
    flips = [signed(1 << i) for i in range(64)]
    named = crowded.select("fp", F.explode(F.array(F.lit(0).cast("long"), *map(F.lit, flips))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    centre = named.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("mid", "a")
    stars = named.join(centre, "mid").filter("a < fp").select("a", F.col("fp").alias("b"))
    if radius == 1:
        stars = stars.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 1)
    return pairs.unionByName(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node on a link (a, b); a component's root is its least node.

    Large-star and small-star in turns until nothing moves: rounds grow with the logarithm of a component, and no
    step gathers a component: a hot node's neighbours are only reduced to their minimum, then joined back.
    """
    pairs = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialise(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "star")
        # every node points to one other and no root points on: done when a round changes nothing
        state = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            found = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the smallest id that links reach)."""
    found = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    points = materialise(found.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "points")
    # ids rank the fingerprints; one that only rows without an id have ranks after all ids, by itself
    rank = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", "fp").alias("at"))
    order = points.select("fp", rank.alias("rank"))
    edges = links(points, radius, cell).join(order.toDF("a", "u"), "a").join(order.toDF("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    placed = order.join(components(edges).withColumnRenamed("node", "rank"), "rank").select(F.col("fp").alias("_fp"), F.when(~F.col("root.none"), F.col("root.at")).alias("_root"), F.lit(True).alias("_linked"))
    own = points.select(F.col("fp").alias("_fp"), F.col("id").alias("_own"))
    ids = own.join(placed, "_fp", "left").select("_fp", F.when(F.col("_linked"), F.col("_root")).otherwise(F.col("_own")).alias("component_id"))
    ids = materialise(ids, "component-ids")
    # no more than COMMON fingerprints stand for that share of all rows: they are sent to the rows, the rest meet by shuffle
    total = points.agg(F.sum("n")).first()[0] or 0
    common = points.filter(F.col("n") * COMMON >= total).filter("n > 1").select(F.col("fp").alias("_common"))
    often = F.broadcast(ids.join(F.broadcast(common), F.col("_fp") == F.col("_common"), "left_semi"))
    by_send = found.join(often, F.col("fp") == F.col("_fp"))
    by_shuffle = found.join(F.broadcast(common), F.col("fp") == F.col("_common"), "left_anti").join(ids.hint("merge"), F.col("fp") == F.col("_fp"))
    return by_send.unionByName(by_shuffle).select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
