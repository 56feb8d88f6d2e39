"""Chat logs to training text: fold event logs into messages, render them, read them back.

A log has one row per event: conv_id, message (which message of the conversation), seq (any
sortable value that orders the events of a message), kind, role and text. Kinds: ``delta``
appends its text, ``edit`` puts its text in place of all before it, ``regenerate`` drops all
before it. Other kinds add nothing, but their message exists. Messages follow each other by ``message``.

A message has the role of its last event that has one; NULL text is empty, a NULL role is the
empty role. Events that are equal in every column are one event. Conversations without events
do not exist, so an empty log gives an empty table.

The template is ``<turn role>text</turn>`` and a line end for each message. In roles and texts
a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g``, so no mark of the
template can occur in them, and the way back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import let

END = "</turn>\n"
#: The characters that texts may not hold as they are, with what stands for them; undone in reverse.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """One row per message: conv_id, message, role, text.

    The last edit or regeneration is found first, with an aggregate that merges before the
    shuffle; only events from there on are gathered, so drafts never meet in one task.
    """
    key = ["conv_id", "message"]
    log = events.select(*key, "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    resets = F.col("kind").isin("edit", "regenerate")
    at = F.struct("seq")  # a NULL seq comes first
    last = log.groupBy(*key).agg(F.max(F.when(resets, at)).alias("__from"), F.max_by("role", F.when(F.col("role").isNotNull(), at)).alias("role"))
    last = last.withColumnsRenamed({c: f"__{c}" for c in key})
    same = log["conv_id"].eqNullSafe(last["__conv_id"]) & log["message"].eqNullSafe(last["__message"])
    live = F.col("__from").isNull() | (at > F.col("__from")) | ((at == F.col("__from")) & (F.col("kind") == "edit"))
    adds = F.col("kind").isin("delta", "edit") & live
    parts = log.drop("role").join(last, same).groupBy(*key, "role").agg(
        F.sort_array(F.collect_list(F.when(adds, F.struct("seq", "text")))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return parts.select(*key, F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, ``formatted``, and ``loss``, the (start, end) places of the texts of role ``learn``.

    Places count characters of ``formatted``, from 0, the end left out. A message of no text has an empty span.
    """
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "role", "text"))).alias("turns"))
    written = F.transform(
        "turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">")).alias("head"), escape(t["text"]).alias("body"))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def place(a: Column, t: Column) -> Column:
        begin = a["at"] + F.char_length(t["head"])
        end = begin + F.char_length(t["body"])
        span = F.when(t["role"] == learn, F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + len(END)).alias("at"), F.concat(a["spans"], span).alias("spans"))

    out = turns.withColumn(
        "__out",
        let(
            written,
            lambda w: F.struct(
                F.array_join(F.transform(w, lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
                F.aggregate(w, start, place, lambda a: a["spans"]).alias("loss"),
            ),
        ),
    )
    return out.select("conv_id", "__out.formatted", "__out.loss")


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a rendered conversation, unescaped."""
    pieces = F.split(formatted, END)
    whole = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def parse(piece: Column) -> Column:
        head = F.substring_index(piece, ">", 1)
        role, text = F.substr(head, F.lit(len("<turn ") + 1)), F.substr(piece, F.char_length(head) + 2)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(whole, parse)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def streamed(conversations: DataFrame, piece: int = 200) -> DataFrame:
    """An event log that replays finished conversations (conv_id, turn, role, text) as a client would send them.

    Each turn opens, streams a draft that is regenerated (assistant) or edited away (others),
    and then streams its text in pieces. Turns follow each other by turn, role, text; rows that
    are equal in all of these are turns of their own.
    """
    from pyspark.sql import Window

    body = F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id", "turn").orderBy("role", body)
    rows = conversations.select("conv_id", "turn", "role", body.alias("text"), F.row_number().over(order).alias("ordinal"))
    rows = rows.withColumn("message", F.struct("turn", "ordinal"))
    count = F.ceil(F.char_length("text") / piece).cast("int")
    none = F.lit(None).cast("string")
    draft = F.reverse(F.substr("text", F.lit(1), F.lit(piece)))
    said = F.col("role") == "assistant"

    def event(seq: Column, kind: Column, role: Column, text: Column) -> Column:
        return F.struct(seq.cast("int").alias("seq"), kind.alias("kind"), role.alias("role"), text.alias("text"))

    opening = F.array(
        event(F.lit(0), F.lit("open"), F.col("role"), none),
        event(F.lit(1), F.lit("delta"), none, draft),
        event(F.lit(2), F.when(said, F.lit("regenerate")).otherwise(F.lit("edit")), none, F.lit("")),
    )
    pieces = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    deltas = F.transform(pieces, lambda i: event(i + 3, F.lit("delta"), none, F.substr(F.col("text"), i * piece + 1, F.lit(piece))))
    log = rows.select("conv_id", "message", F.explode(F.concat(opening, deltas)).alias("e"))
    return log.select("conv_id", "message", "e.*")
