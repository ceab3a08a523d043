"""Exact deduplication with a split for heavy hitters.

Texts are equal when they agree after every character of ``[\\x20\\x09-\\x0D]`` is deleted; the digest of that
normalised text stands for it from the first pass on. The rows of a digest that may be frequent never meet in a
shuffle: each task keeps Misra-Gries counters, the summed counters name at most ``counters + 1`` digests, their winners
are found by a map-side combined aggregate and broadcast. All other digests are shuffled in the ordinary way.

Defined cases: null and empty texts are one group. Of equal texts the row with the most code points stays, then the
smallest id, a null id last; of rows that repeat an id and a text exactly one is kept. Extra columns play no part.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictbefore.llm.common import drop_rows, fresh, keyed, materialise, without_white

#: Misra-Gries counters of each task; digests of over 2 / (COUNTERS + 1) of all rows are certain to be found.
COUNTERS = 1024


def misra_gries(keys: Iterator[bytes], counters: int) -> dict[bytes, int]:
    """Counters of a stream: each falls short of its key's true count by at most len(stream) / (counters + 1)."""
    kept: dict[bytes, int] = {}
    for key in keys:
        if key in kept:
            kept[key] += 1
        elif len(kept) < counters:
            kept[key] = 1
        else:
            kept = {k: n - 1 for k, n in kept.items() if n > 1}
    return kept


def digests(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    """The narrow table that everything else reads: row, id, digest, code points."""
    text = docs[text_col]
    return docs.select(
        row.alias("row"),
        docs[id_col].cast("long").alias("id"),
        F.sha2(without_white(text).cast("binary"), 256).alias("digest"),
        F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("points"),
    )


def frequent(narrow: DataFrame, counters: int) -> DataFrame:
    """At most ``counters + 1`` digests, among them each one of at least 2 / (counters + 1) of all rows.

    The counters of all tasks sum to the row count at most, so no more than counters + 1 sums can reach
    rows / (counters + 1); a digest's sum falls short of its count by that much at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0

        def stream():
            nonlocal rows
            for batch in batches:
                rows += batch.num_rows
                yield from batch.column(0).to_pylist()

        kept = misra_gries(stream(), counters)
        yield pa.RecordBatch.from_pydict(
            {"digest": [None, *kept], "n": [rows, *kept.values()]}, schema=pa.schema([("digest", pa.string()), ("n", pa.int64())])
        )

    summed = narrow.select("digest").mapInArrow(count, "digest string, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    summed = materialise(summed, "misra-gries")
    total = summed.filter("digest is null").select("n").first()
    return summed.filter("digest is not null").filter(F.col("n") * (counters + 1) >= (total[0] if total else 0)).select("digest")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    return decided(digests(docs, id_col, text_col, F.monotonically_increasing_id()), counters).drop("row")


def decided(narrow: DataFrame, counters: int) -> DataFrame:
    """decide() over the narrow table, with each row's key."""
    narrow = materialise(narrow, "digests")
    heavy = materialise(frequent(narrow, counters), "frequent")
    order = (F.desc("points"), F.asc_nulls_last("id"), F.asc("row"))
    best = F.min_by(F.struct("row", "id"), F.struct(-F.col("points"), F.col("id").isNull(), F.col("id"), F.col("row")))
    winners = (
        narrow.join(F.broadcast(heavy), "digest", "left_semi")
        .groupBy("digest")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
    )
    winners = F.broadcast(materialise(winners, "winners"))  # counters + 1 rows at most
    common = narrow.join(winners, "digest").select(
        "row", "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("digest").alias("text_sha256")
    )
    group = Window.partitionBy("digest")
    rare = (
        narrow.join(F.broadcast(heavy), "digest", "left_anti")
        .withColumn("place", F.row_number().over(group.orderBy(*order)))
        .withColumn("keep_id", F.first("id").over(group.orderBy(*order)))
        .withColumn("group_size", F.count("*").over(group))
        .select("row", "id", "keep_id", "group_size", (F.col("place") == 1).alias("kept"), F.col("digest").alias("text_sha256"))
    )
    return common.unionByName(rare)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows are named by a key of their own, so ids may be null or repeat."""
    (row,) = fresh(docs, "row")
    docs = keyed(docs, row)
    made = decided(digests(docs, id_col, text_col, docs[row]), counters)
    gone = materialise(made.filter(~F.col("kept")).select("row"), "exact-drops")
    return drop_rows(docs, row, gone, gone.count())
