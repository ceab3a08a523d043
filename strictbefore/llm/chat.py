"""Chat formatting over typed content parts, in DataFrame operations; only the check digests of very long conversations are folded in Arrow.

A message's content is an ordered array of parts ``struct<kind, text, ref, tokens>``. A visitor (``visit``) flattens
them: a text part becomes its escaped text, an image, audio or document part an ordered placeholder
``<image:0>``, numbered within the output row over all kinds, and the row records each attachment's placeholder, reference
and the tokens it expands to. The template marks a turn as ``<turn role>`` newline text ``</turn>`` newline.

Texts and roles are escaped reversibly: a backslash becomes ``\\b`` and a less-than sign ``\\l``. An escaped text then has
no less-than sign, so nothing in it can look like a mark of the template or a placeholder, and every backslash in it
begins an escape.

A conversation of more than CHUNK_TURNS turn numbers is laid out in consecutive rows (``chunk``) of so many, and a chunk with
more messages than that, as turns may repeat or be null, or with more than PART_CHARS characters, in consecutive parts
(``part``). Each row has the loss mask of its own text: spans (0-based start, length) in code points over ``formatted`` of what the model is to write.

Defined cases: null role, text and parts count as empty; a null turn comes first; equal turn numbers are ordered by role
and text, and repeated rows are turns of their own; a null conversation id is a conversation. Extra columns play no part. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strictbefore.llm.common import BROADCAST_ROWS, bounded_batches, materialise

#: Turn numbers laid out in one row.
CHUNK_TURNS = 256
#: Characters after which a row's messages go on in another row.
PART_CHARS = 1 << 20
#: Characters of a conversation that read_back() puts in one row to hash it.
ROW_CHARS = 1 << 25
#: Tokens that an attachment expands to when the part states none.
PART_TOKENS = {"image": 256, "audio": 128, "document": 512}
#: The role whose texts the loss covers.
LEARNT_ROLE = "assistant"

PART = "struct<kind:string,text:string,ref:string,tokens:int>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """The content of a message that is plain text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def visit(parts: Column, first: Column) -> Column:
    """The parts' flattened text and attachments; placeholders count on from ``first``."""
    start = F.struct(F.lit("").alias("text"), F.expr("cast(array() as array<struct<placeholder:int,kind:string,ref:string,tokens:int>>)").alias("attachments"))

    def tokens(part: Column) -> Column:
        found = F.lit(0)
        for kind, n in PART_TOKENS.items():
            found = F.when(part["kind"] == kind, n).otherwise(found)
        return F.coalesce(part["tokens"], found).cast("int")

    def step(acc: Column, part: Column) -> Column:
        place = (first + F.size(acc["attachments"])).cast("int")
        attached = part["kind"].isin(*PART_TOKENS)
        mark = F.concat(F.lit("<"), part["kind"], F.lit(":"), place.cast("string"), F.lit(">"))
        entry = F.struct(place.alias("placeholder"), part["kind"].alias("kind"), part["ref"].alias("ref"), tokens(part).alias("tokens"))
        return F.struct(
            F.concat(acc["text"], F.when(attached, mark).otherwise(escape(part["text"]))).alias("text"),
            F.when(attached, F.concat(acc["attachments"], F.array(entry))).otherwise(acc["attachments"]).alias("attachments"),
        )

    return F.aggregate(F.coalesce(parts, F.expr(f"cast(array() as array<{PART}>)")), start, step)


def format_parts(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, parts_col: str, chunk_turns: int = CHUNK_TURNS, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per conversation, chunk and part: conv, chunk, part, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    ``parts_col`` is an array of PART. Rows of one part meet in one group: chunk_turns messages at most, begun within
    part_chars characters. They are numbered by a sorted pass over the chunk, which may spill.
    """
    no_parts = F.expr(f"cast(array() as array<{PART}>)")
    rows = messages.select(
        messages[conv_col].alias("conv"),
        F.floor(messages[turn_col] / chunk_turns).alias("chunk"),
        F.struct(messages[turn_col].alias("turn"), F.coalesce(messages[role_col], F.lit("")).alias("role"), F.coalesce(messages[parts_col].cast(f"array<{PART}>"), no_parts).alias("parts")).alias("message"),
    )
    said = F.aggregate("message.parts", F.lit(0).cast("long"), lambda n, p: n + F.coalesce(F.char_length(p["text"]), F.lit(0)))
    order = Window.partitionBy("conv", "chunk").orderBy("message")
    before = F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # both terms never fall, so equal sums are equal terms
    part = F.floor((F.row_number().over(order) - 1) / chunk_turns) + F.floor(before / part_chars)
    numbered = rows.withColumn("chars", said + F.char_length("message.role")).withColumn("part", part)
    return lay_out(numbered.groupBy("conv", "chunk", "part").agg(F.array_sort(F.collect_list("message")).alias("messages")))


def lay_out(grouped: DataFrame) -> DataFrame:
    """From ordered messages to text, mask and attachments, in passes over the array; running lists are copied as they grow, which chunk_turns bounds."""
    kinds = F.transform("messages", lambda m: F.size(F.filter(m["parts"], lambda p: p["kind"].isin(*PART_TOKENS))))
    before = F.aggregate("_kinds", F.expr("cast(array(0) as array<int>)"), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    any_kind = F.exists("_kinds", lambda n: n > 0)
    firsts = F.when(any_kind, before).otherwise(F.array_repeat(F.lit(0), F.size("_kinds")))
    visited = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), visit(m["parts"], F.get("_firsts", i)).alias("seen")))
    head = lambda v: F.concat(F.lit("<turn "), escape(v["role"]), F.lit(">\n"))
    blocks = F.transform("_visited", lambda v: F.struct(head(v).alias("head"), v["seen"]["text"].alias("body"), (v["role"] == LEARNT_ROLE).alias("learnt")))
    formatted = F.array_join(F.transform("_blocks", lambda b: F.concat(b["head"], b["body"], F.lit("</turn>\n"))), "")
    # spans: the running length carries over; only the learnt turns add a span
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))

    def walk(acc: Column, b: Column) -> Column:
        start = acc["at"] + F.char_length(b["head"])
        length = F.char_length(b["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct((start + length + len("</turn>\n")).alias("at"), F.when(b["learnt"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    attachments = F.flatten(F.transform("_visited", lambda v, i: F.transform(v["seen"]["attachments"], lambda a: F.struct(i.alias("message"), a["placeholder"].alias("placeholder"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return (
        grouped.withColumn("_kinds", kinds)
        .withColumn("_firsts", firsts)
        .withColumn("_visited", visited)
        .withColumn("_blocks", blocks)
        .select(
            "conv",
            "chunk",
            "part",
            F.size("messages").cast("long").alias("n_turns"),
            formatted.alias("formatted"),
            F.aggregate("_blocks", nothing, walk)["spans"].alias("loss_spans"),
            attachments.alias("attachments"),
        )
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))
    )


def format_texts(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """format_parts() for messages whose content is one text each."""
    only = messages.select(messages[conv_col].alias("conv"), messages[turn_col].alias("turn"), messages[role_col].alias("role"), text_part(messages[text_col]).alias("parts"))
    return format_parts(only, "conv", "turn", "role", "parts", chunk_turns)


def turns_of(formatted: Column) -> Column:
    """The (role, text) turns of a formatted row, unescaped and without placeholders: the inverse of the template for text parts."""
    texts = F.regexp_replace(formatted, f"<({'|'.join(PART_TOKENS)}):[0-9]+>", "")  # an escaped text has no such mark
    blocks = F.filter(F.split(texts, "</turn>\n"), lambda b: b != "")

    def turn(block: Column) -> Column:
        end = F.instr(block, ">\n")
        return F.struct(unescape(F.substr(block, F.lit(len("<turn ") + 1), end - F.lit(len("<turn ") + 1))).alias("role"), unescape(F.substr(block, end + F.lit(2))).alias("text"))

    return F.transform(blocks, turn)


def digests(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches sorted by conversation, a row per conversation; only its running sums and hash states are held."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sums, begun = None, None, False

        def row() -> pa.RecordBatch:
            *counts, loss, turns_hash, loss_hash = sums
            values = (conv, *counts, loss, turns_hash.hexdigest(), loss_hash.hexdigest())
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for of, *counts, turns, loss in zip(*batch.columns, strict=True):
                of = of.as_py()
                if not begun or of != conv:
                    if begun:
                        yield row()
                    conv, sums, begun = of, [0] * (len(counts) + 1) + [hashlib.sha256(), hashlib.sha256()], True
                said = loss.as_py()
                for i, n in enumerate(counts):
                    sums[i] += n.as_py()
                sums[-3] += len(said)
                sums[-2].update(turns.as_py().encode())
                sums[-1].update(said.encode())
        if begun:
            yield row()

    return fold


def read_back(formatted: DataFrame, row_chars: int = ROW_CHARS) -> DataFrame:
    """What the output says per conversation: counts, and digests of all turns and of all text under the loss mask.

    DataFrame operations can only hash a text that is in one row, so conversations of up to ``row_chars`` characters are
    put in one. SHA-256 needs a longer one's text in order but not in one row: its rows are sorted in a partition, which may
    spill, and hashed as a stream in an Arrow function. That function only runs where there is such a conversation.
    """
    formatted = materialise(formatted, "chat")
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    said = F.array_join(F.transform(turns_of(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    counts = [F.col("n_turns"), F.char_length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("attachments"), F.col("expanded_tokens")]
    rows = formatted.select("conv", "chunk", "part", *counts, said.alias("turns"), F.array_join(masked, "").alias("loss"))
    order = ("n_turns", "formatted_chars", "attachments", "expanded_tokens")
    sizes = formatted.groupBy("conv").agg(F.sum(F.char_length("formatted").cast("long")).alias("chars")).filter(F.col("chars") > row_chars)
    long = materialise(sizes.select(F.col("conv").alias("long")), "long-conversations")
    n = long.count()
    if n:
        longs = F.broadcast(long) if n <= BROADCAST_ROWS else long.hint("merge")
        is_long = rows["conv"].eqNullSafe(longs["long"])
        apart, rows = rows.join(longs, is_long, "left_semi"), rows.join(longs, is_long, "left_anti")
    pieces = F.array_sort(F.collect_list(F.struct("chunk", "part", "turns", "loss")))
    short = rows.groupBy("conv").agg(*[F.sum(c).alias(c) for c in order], pieces.alias("pieces"))
    text = lambda of: F.array_join(F.transform("pieces", lambda p: p[of]), "")
    out = short.select(
        F.col("conv").alias("conv_id"), *order, F.char_length(text("loss")).cast("long").alias("loss_chars"), F.sha2(text("turns").cast("binary"), 256).alias("turns_sha256"), F.sha2(text("loss").cast("binary"), 256).alias("loss_sha256")
    )
    return out.unionByName(streamed(apart, order)) if n else out


def streamed(rows: DataFrame, counts: tuple[str, ...]) -> DataFrame:
    """read_back() of conversations of any length."""
    bounded_batches(rows.sparkSession)
    conv = rows.schema["conv"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(conv)), *[(c, pa.int64()) for c in (*counts, "loss_chars")], ("turns_sha256", pa.string()), ("loss_sha256", pa.string())])
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "chunk", "part").select("conv", *counts, "turns", "loss")
    return dealt.mapInArrow(digests(schema), f"conv_id {conv.simpleString()}, {', '.join(f'{c} long' for c in counts)}, loss_chars long, turns_sha256 string, loss_sha256 string")
