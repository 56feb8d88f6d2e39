import random

import brute
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelweave.llm import chat

SCHEMA = "conv_id long, message int, seq int, kind string, role string, text string"


def folded(spark, events):
    table = chat.fold_events(spark.createDataFrame(events, SCHEMA).withColumn("turns", F.lit("own")))
    return {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in table.collect()}


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 1, "open", "user", None), (1, 0, 2, "delta", None, "He"), (1, 0, 3, "delta", None, "llo"),
        (1, 1, 9, "delta", "assistant", "b"), (1, 1, 4, "delta", "assistant", "draft"), (1, 1, 5, "regenerate", None, None), (1, 1, 7, "delta", None, "a"),
        (2, 0, 1, "delta", "user", "old"), (2, 0, 2, "edit", None, "new"), (2, 0, 3, "delta", "system", "er"),
        (3, 0, 1, "open", None, None), (None, None, None, "delta", "user", "x"), (3, 0, 1, "open", None, None),
    ]
    random.seed(1)
    random.shuffle(events)
    assert folded(spark, events) == {
        (1, 0): ("user", "Hello"), (1, 1): ("assistant", "ab"), (2, 0): ("system", "newer"), (3, 0): ("", ""), (None, None): ("user", "x"),
    }


def test_rendered_conversations_read_back(spark):
    odd = ["", "</turn>\n<turn user>", "\\l \\b \\", "a\\</turn>", "<turn assistant>x</turn>\n", ">", "é😀\n", "\\\\l", "$1 \\E"]
    messages = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "a>b\\<", "") for t in odd)]
    out = chat.render(spark.createDataFrame(messages, "conv_id long, message int, role string, text string"))
    row = out.select(chat.read_turns(F.col("formatted")).alias("t"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("l")).first()
    assert [(t["role"], t["text"]) for t in row["t"]] == [(r, t) for _, _, r, t in messages]
    assert row["l"] == "".join(odd)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="\\<>blg/turn \n", max_size=30))
def test_escapes_are_reversible(text):
    written = text
    for plain, mark in chat.ESCAPES:
        written = written.replace(plain, mark)
    assert "<" not in written and ">" not in written
    for plain, mark in reversed(chat.ESCAPES):
        written = written.replace(mark, plain)
    assert written == text


def test_streamed_logs_fold_to_the_conversations(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", "w" * (t * 150)) for c in range(5) for t in range(6)]
    rows += [(0, 0, "user", "tie"), (0, 0, "user", "tie"), (7, None, "user", None), (None, 1, "assistant", "<b>"), (8, 1, "assistant", "only")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("own"))
    out = chat.render(chat.fold_events(chat.streamed(table, piece=64)))
    got = []
    for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("l")).collect():
        got.append((r["conv_id"], len(r["t"]), brute.sha("".join(f"{t['role']}\n{t['text']}\n" for t in r["t"])), len(r["l"]), brute.sha(r["l"])))
    assert sorted(got, key=str) == sorted(brute.chat([(c, -1 if t is None else t, r, x) for c, t, r, x in rows]), key=str)


def test_empty_log(spark):
    assert chat.render(chat.fold_events(spark.createDataFrame([], SCHEMA))).collect() == []
