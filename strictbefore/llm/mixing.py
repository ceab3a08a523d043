"""Mixing sources to target weights, in DataFrame operations only.

Each source's words, its documents by id, form one stream that is packed into blocks of BLOCK words; the last may be
shorter. The mix is a row of slots in output shards of SHARD_SLOTS. Which slots a source gets is a draw without
replacement from an urn that holds each source's takes: a keyed pseudorandom permutation of all slots. A shard's counts are
thus a multinomial draw conditioned on the sources' quotas (a multivariate hypergeometric one), so every target is met
and no document can pass the cap, which a free draw would miss by its standard deviation. A source's k-th take is the block at
``permutation(k mod blocks)`` under a permutation of its own, each pass over the blocks ending with the short one: every
block is used once before any is used again, and the last take stops within its block where the target is met. Slots
and blocks meet by index.

Permutations are swap-or-not shuffles: ROUNDS rounds, each of which swaps an index with its mirror image about a keyed
point or doesn't, as a keyed hash says of the pair. Each round is a bijection of any length. The hash is MD5, so that
reruns agree and SQL can recompute the mix.

Defined cases: a null text has size 0; a null source is a source of its own, the last; null ids sort first within
their source. Rows that repeat an id are separate documents and give separate rows; rows without an id or with a repeated one are
mixed like any other, as rows are told apart by a key of their own. Sources without words have target 0. An empty table
gives an empty result. Extra columns play no part. Windows over all sources see one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictbefore.llm.common import fresh, keyed, materialise

#: Words in a block, a training sequence's worth.
BLOCK = 1024
#: Slots in an output shard.
SHARD_SLOTS = 256
#: Rounds of a permutation; an index's place is close to uniform after log2(length) of them.
ROUNDS = 40
#: Weights of the sources in code point order, repeating; no source takes more than CAP times its words.
WEIGHTS = (5, 2, 1)
CAP = 3

WORD = r"[^\x20\x09-\x0D]+"


def shuffled(index: Column, length: Column, key: Column) -> Column:
    """A pseudorandom bijection of 0 .. length - 1 that ``key`` picks."""
    point = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", key, i)), 1, 12), 16, 10).cast("long")
    rounds = F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda i: F.struct(i.alias("round"), (point(i) % length).alias("point")))

    def step(at: Column, r: Column) -> Column:
        image = F.pmod(r["point"] - at, length)
        swaps = F.substring(F.md5(F.concat_ws(":", key, r["round"], F.greatest(at, image))), 1, 1) < "8"
        return F.when(swaps, image).otherwise(at)

    return F.aggregate(rounds, index.cast("long"), step)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: source, source_size, target. One row per source, so its windows see as many rows as there are sources.

    Sharing by weight with a cap is water filling: with the sources by cap / weight ascending, a prefix stands at its
    cap and the rest share what is left in proportion.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    at_least = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(below), F.lit(0))) / F.sum("weight").over(at_least)
    per = per.withColumn("_level", level.cast("double")).withColumn("_at", F.row_number().over(by_ratio))
    uncapped = F.col("_level") * F.col("weight") <= F.col("most")
    per = per.withColumn("_rest", F.min(F.when(uncapped, F.struct("_at", F.col("_level").alias("level")))).over(everything))
    share = F.col("_rest.level") * F.col("weight")
    target = F.when(F.col("_rest").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), share))
    return per.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, row: Column) -> DataFrame:
    """The narrow table of row keys, ids, sources and sizes."""
    return docs.select(
        row.alias("row"),
        docs[id_col].cast("long").alias("id"),
        docs[source_col].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def ranged(sizes: DataFrame, parts: int) -> DataFrame:
    """Each row's first word in its source's stream, by id, size and row key; a source's rows are summed range by range."""
    sizes = materialise(sizes, "sizes")  # ranges are found by a pass of their own, which is not to count words again
    split = materialise(sizes.repartitionByRange(parts, "id", "size", "row").withColumn("range", F.spark_partition_id()), "ranged")
    sums = split.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("_source"), F.col("range").alias("_range"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "range").orderBy(F.asc_nulls_first("id"), "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    local = split.withColumn("_local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = local.join(bases, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
    return joined.select("row", "id", "source", "size", (F.col("_base") + F.col("_local")).alias("first"))


def quotas(per_source: DataFrame, block: int) -> DataFrame:
    """Per source: its blocks, its takes, the first of its places in the urn of all takes, and the words of its last take."""
    size, blocks = F.col("source_size"), F.ceil(F.col("source_size") / block).cast("long")
    words = F.when(F.col("target") >= size * CAP, size * CAP).otherwise(F.round("target").cast("long"))
    out = per_source.withColumn("blocks", blocks).withColumn("words", words)
    some = size > 0
    rest = F.when(some, F.col("words") % size).otherwise(F.lit(0))
    # whole passes, then full blocks, then one that ends where the target is met
    last_pass = F.ceil(rest / block).cast("long")
    take = F.when(some, F.floor(F.col("words") / size) * F.col("blocks") + last_pass).otherwise(F.lit(0)).cast("long")
    last_words = F.when(last_pass > 0, rest - (last_pass - 1) * block).otherwise(F.lit(block)).cast("long")
    out = out.withColumn("take", take).withColumn("last_words", last_words)
    before = Window.orderBy(F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    return out.withColumn("start", F.coalesce(F.sum("take").over(before), F.lit(0))).withColumn("slots", F.sum("take").over(everything))


def slots(quota: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per slot of the mix: shard, slot, place of the source, pass, block and how many of the block's words it takes.

    Explodes by runs of takes first, so that no row makes more than a shard's; the runs are few bytes that stand for much work, so
    they are dealt to a fixed number of tasks.
    """
    parts = int(quota.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = quota.filter("take > 0").withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("take") - 1) / shard_slots)))).repartition(parts, "place", "run")
    in_run = F.sequence(F.col("run") * shard_slots, F.least((F.col("run") + 1) * shard_slots, F.col("take")) - 1)
    takes = runs.withColumn("k", F.explode(in_run)).withColumn("nth", F.col("k") % F.col("blocks"))
    slot = shuffled(F.col("start") + F.col("k"), F.col("slots"), F.lit("slots"))
    full = F.col("blocks") - 1
    at = F.when(F.col("nth") == full, full).otherwise(shuffled(F.col("nth"), full, F.concat(F.lit("blocks-"), F.col("place"))))
    return takes.withColumn("slot", slot).select(
        F.floor(F.col("slot") / shard_slots).alias("shard"),
        "slot",
        "place",
        F.floor(F.col("k") / F.col("blocks")).alias("pass"),
        at.alias("block"),
        F.when(F.col("k") == F.col("take") - 1, F.col("last_words")).otherwise(F.lit(block)).alias("limit"),
    )


def pieces(streams: DataFrame, quota: DataFrame, block: int = BLOCK) -> DataFrame:
    """What of each document lies in each block: row, id, size, place, block, and its begin and words in the block and offset in the document."""
    per = quota.select(F.col("source").alias("_source"), "place")
    placed = streams.filter("size > 0").join(per, F.col("source").eqNullSafe(F.col("_source")))
    last = F.floor((F.col("first") + F.col("size") - 1) / block)
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), last)))
    begin = F.greatest(F.col("first"), F.col("block") * block)
    end = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block)
    return cut.select("row", "id", "size", "place", "block", (begin - F.col("block") * block).alias("begin"), (begin - F.col("first")).alias("offset"), (end - begin).alias("words"))


def plan(sizes: DataFrame, block: int, shard_slots: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Streams, quotas and the pieces that each slot takes."""
    streams = materialise(ranged(sizes, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "streams")
    quota = materialise(quotas(targets(streams), block), "quotas")
    # both sides grow with the corpus, though Spark can't tell from a table of quotas: neither may be broadcast
    taken = pieces(streams, quota, block).hint("merge").join(slots(quota, block, shard_slots).hint("merge"), ["place", "block"])
    held = F.least(F.col("begin") + F.col("words"), F.col("limit")) - F.col("begin")
    return streams, quota, taken.withColumn("words", held).filter("words > 0")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, and shard and slot where its words first stand (null: nowhere)."""
    zero = F.lit(0).cast("long")
    row = F.struct(zero.alias("file"), zero.alias("check"), F.monotonically_increasing_id().alias("at"))
    streams, quota, taken = plan(sized(docs, id_col, text_col, source_col, row), block, shard_slots)
    used = taken.groupBy(F.col("row").alias("_row")).agg(F.sum("words").alias("taken"), F.min("shard").alias("shard"), F.min("slot").alias("slot"))
    per = quota.select(F.col("source").alias("_source"), "source_size", "target")
    out = streams.join(used.hint("merge"), F.col("row") == F.col("_row"), "left").join(per, F.col("source").eqNullSafe(F.col("_source")))
    return out.select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "shard", "slot")


def spans(runs: Column) -> Column:
    """Sorted pieces (offset, words, slot) of a document, the adjoining ones made one, which stands at its first piece's slot."""
    end = lambda i: F.get(runs, i)["offset"] + F.get(runs, i)["words"]
    places = F.sequence(F.lit(0), F.size(runs) - 1)
    firsts = F.filter(places, lambda i: (i == 0) | (F.get(runs, i)["offset"] != end(i - 1)))
    lasts = F.filter(places, lambda i: (i == F.size(runs) - 1) | (F.get(runs, i + 1)["offset"] != end(i)))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(F.get(runs, a)["offset"].alias("offset"), (end(b) - F.get(runs, a)["offset"]).alias("words"), F.get(runs, a)["slot"].alias("slot")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as documents in the order of its shards and slots, each shard in one partition.

    Per document, pass and run of adjoining blocks taken a row with its words, verbatim with the white space before
    them: no text is joined over a gap. A document that a pass takes whole keeps its text as it is; one that the mix
    doesn't take is gone.
    """
    names = docs.columns
    row, own, runs, whole, run, slot = fresh(docs, "row", "own", "runs", "whole", "run", "slot")
    docs = keyed(docs, row)
    _, _, taken = plan(sized(docs, id_col, text_col, source_col, docs[row]), block, shard_slots)
    per = taken.groupBy(F.col("row").alias(own), "pass").agg(
        F.array_sort(F.collect_list(F.struct("offset", "words", "slot"))).alias(runs), (F.sum("words") == F.first("size")).alias(whole)
    )
    joined = docs.join(per.drop("pass").hint("merge"), docs[row] == F.col(own))
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    stretch = lambda t, r: F.array_join(F.slice(t, (r["offset"] + 1).cast("int"), r["words"].cast("int")), "")
    # the one-element array binds the words, so that they are found once however many runs are cut from them
    cut = F.get(F.transform(F.array(found), lambda t: F.transform(spans(F.col(runs)), lambda r: F.struct(stretch(t, r).alias("text"), r["slot"].alias("slot")))), F.lit(0))
    texts = F.when(F.col(whole), F.array(F.struct(F.col(text_col).alias("text"), F.get(F.col(runs), F.lit(0))["slot"].alias("slot")))).otherwise(cut)
    out = joined.select(*[F.col(f"`{c}`") for c in names if c != text_col], F.explode(texts).alias(run))
    out = out.withColumn(text_col, F.col(f"{run}.text")).withColumn(slot, F.col(f"{run}.slot"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    shard = F.floor(F.col(slot) / shard_slots)
    return out.repartition(shard).sortWithinPartitions(slot).select(*[F.col(f"`{c}`") for c in names])
