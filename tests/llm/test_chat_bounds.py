"""Conversations whose turns repeat or are null, or whose text is long: rows are bounded and digests unchanged."""

import hashlib

from strictbefore.llm import chat


def test_parts_are_bounded_and_digests_are_of_the_whole(spark):
    rows = [(1, None, "user", f"q{i % 7}<\\") for i in range(700)] + [(1, 3, "assistant", f"é{i}") for i in range(600)] + [(2, i, "assistant", "x" * 40) for i in range(30)] + [(None, 1, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    formatted = chat.format_texts(frame)
    got = formatted.collect()
    assert max(r["n_turns"] for r in got) <= chat.CHUNK_TURNS and sum(r["n_turns"] for r in got) == len(rows)
    assert len({(r["conv"], r["chunk"], r["part"]) for r in got}) == len(got) == 3 + 3 + 1 + 1
    texts = frame.select("conv_id", "turn", "role", chat.text_part(frame.text).alias("parts"))
    short = chat.format_parts(texts, "conv_id", "turn", "role", "parts", part_chars=100)
    assert max(len(r["formatted"]) for r in short.filter("conv = 2").collect()) <= 3 * (40 + len("<turn assistant>\n</turn>\n"))
    for laid, limit in ((formatted, chat.ROW_CHARS), (formatted, 1000), (short, 0), (short, 1 << 20)):
        back = {r["conv_id"]: r for r in chat.read_back(laid, limit).collect()}
        assert len(back) == 3
        for conv in back:
            own = sorted([(-1 if t is None else t, r, x or "") for c, t, r, x in rows if c == conv])
            loss = "".join(x for _, r, x in own if r == "assistant")
            assert back[conv]["n_turns"] == len(own) and back[conv]["loss_chars"] == len(loss)
            assert back[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
            assert back[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_only_a_long_conversation_leaves_the_data_frame(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b" * 90)], "conv_id long, turn long, role string, text string")
    plan = lambda limit: chat.read_back(chat.format_texts(frame), limit)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan(chat.ROW_CHARS) and "MapInArrow" in plan(80)
