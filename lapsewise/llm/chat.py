"""Chat formatting from event logs, with DataFrame functions only.

An event is (conv_id, seq, message, kind, role, text). Kinds: `message` opens a message with a
text, `delta` appends to it, `edit` replaces its text, `regenerate` starts its text anew. An edit
or a regeneration also drops the messages that began after the message and before the event, as
they answered a text that is gone. Folding keeps, per message, what follows its last text-setting
event; rendering puts the final messages of a conversation into one string.

A turn is rendered as `### role`, line end, text, line end, `</turn>`, line end. Backslashes, `#`
and `<` inside texts and roles are escaped (`\\b`, `\\h`, `\\l`; a line end in a role `\\n`), so that
no text can look like a mark and reading back is exact. A conversation is one string by
definition, so its size is bounded by Spark's value limit; nothing else is gathered in one row.

Defined results: a null text is empty, a null role is the empty role, a null conv_id is a
conversation of its own; equal rows are separate turns; ties in the turn number are ordered by
role and text; unknown kinds count as deltas; an empty log gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BEGIN, END = "### ", "</turn>\n"
ASSISTANT = "assistant"
SETS_TEXT = ("message", "edit", "regenerate")
REWINDS = ("edit", "regenerate")


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _replace(_replace(_replace(text, "\\", "\\b"), "#", "\\h"), "<", "\\l")


def unescape(text: Column) -> Column:
    return _replace(_replace(_replace(text, "\\l", "<"), "\\h", "#"), "\\b", "\\")


def escape_role(role: Column) -> Column:
    return _replace(escape(role), "\n", "\\n")


def unescape_role(role: Column) -> Column:
    return unescape(_replace(role, "\\n", "\n"))


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A log with one complete message per row of (conv_id, turn, role, text)."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select(
        "conv_id", F.row_number().over(order).cast("bigint").alias("seq"), F.lit("message").alias("kind"), "role", "text"
    ).withColumn("message", F.col("seq"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, first (its first seq), role, text."""
    sets = F.col("kind").isin(*SETS_TEXT)
    messages = events.groupBy("conv_id", "message").agg(
        F.min("seq").alias("first"),
        F.max(F.when(sets, F.col("seq"))).alias("_set"),
        F.max(F.when(F.col("kind").isin(*REWINDS), F.col("seq"))).alias("_rewound"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.sort_array(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))).alias("_log"),
    )
    last = F.filter("_log", lambda e: F.col("_set").isNull() | (e["seq"] >= F.col("_set")))
    folded = messages.withColumn("text", F.concat_ws("", F.transform(last, lambda e: e["text"])))
    before = W.partitionBy("conv_id").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    gone = F.coalesce(F.max("_rewound").over(before) > F.col("first"), F.lit(False))
    return folded.withColumn("_gone", gone).filter(~F.col("_gone")).select("conv_id", "message", "first", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans of the assistant's texts).

    A span is (turn from 0, start within the turn's block, length), in code points.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(BEGIN), escape_role(role), F.lit("\n"))
    text = escape(F.coalesce(F.col("text"), F.lit("")))
    turns = messages.select(
        "conv_id", "first", F.concat(head, text, F.lit("\n" + END)).alias("block"),
        (role == ASSISTANT).alias("learnt"), F.length(head).alias("start"), F.length(text).alias("length"),
    )
    grouped = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("first", "block", "learnt", "start", "length"))).alias("_turns")
    )
    numbered = F.transform("_turns", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"), t["learnt"].alias("learnt")))
    spans = F.transform(
        F.filter(numbered, lambda t: t["learnt"]),
        lambda t: F.struct(t["turn"].alias("turn"), t["start"].alias("start"), t["length"].alias("length")),
    )
    return grouped.select(
        "conv_id", F.concat_ws("", F.transform("_turns", lambda t: t["block"])).alias("formatted"), spans.alias("loss")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learnt texts from the formatted string alone: adds `turns` (role, text) and `learnt` (texts)."""
    blocks = F.filter(F.split("formatted", END), lambda b: b != "")
    line = lambda b: F.instr(b, "\n")
    turns = F.transform("_blocks", lambda b: F.struct(
        unescape_role(F.substring(b, F.lit(len(BEGIN) + 1), line(b) - len(BEGIN) - 1)).alias("role"),
        unescape(F.substring(b, line(b) + 1, F.length(b) - line(b) - 1)).alias("text"),
    ))
    learnt = F.transform("loss", lambda s: unescape(F.substring(F.get("_blocks", s["turn"]), s["start"] + 1, s["length"])))
    return formatted.withColumn("_blocks", blocks).withColumns({"turns": turns, "learnt": learnt}).drop("_blocks")


def digests(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learnt = F.concat_ws("", "learnt")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("bigint").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def format_turns(turns: DataFrame) -> DataFrame:
    return render(fold(events_of_turns(turns)))
