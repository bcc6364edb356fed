"""Prefix-target expansion of conversations into chat training examples.

Every assistant turn becomes an example: all turns before it are context, only its own text is
trainable. All examples of a conversation are prefixes of one formatted stream, so the stream is stored
once, as one segment per turn with its place, and an example holds the end of its context and
the span of its target. Output grows with the turns, also for a conversation with a third of all rows;
``render`` writes examples out in full.

The template marks a turn as ``[INST]role[/INST]text</s>``. In roles and texts the characters that can
begin a control string are escaped (``~`` as ``~0``, ``<`` as ``~1``, ``[`` as ``~2``), so no text can
form one, and ``unescape`` gives the text back. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stintworks.llm.common import text_of
from stintworks.workspace import materialize

OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"
TARGET_ROLE = "assistant"
# Turns of one conversation that share a window task.
BLOCK = 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    out = F.replace(out, F.lit("<"), F.lit("~1"))
    return F.replace(out, F.lit("["), F.lit("~2"))


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("~2"), F.lit("["))
    out = F.replace(out, F.lit("~1"), F.lit("<"))
    return F.replace(out, F.lit("~0"), F.lit("~"))


def segments(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """The formatted stream: ``conv_id, turn_no, formatted, start, text_start, text_end, end, target``.

    One row per input row; places count code points in the conversation's stream. Turns go by ``turn``
    (NULL last), then role and text. NULL role or text counts as empty, a NULL conversation is one
    conversation. Places come from sums over blocks of turns and sums over the blocks, so no task
    holds a whole conversation unless most of its rows repeat one turn number.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        text_of(role_col).alias("role"),
        text_of(text_col).alias("text"),
    )
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE)))
    rows = rows.withColumn("body", escape(F.col("text"))).withColumn("formatted", F.concat("head", "body", F.lit(CLOSE)))
    rows = rows.withColumn("chars", F.char_length("formatted").cast("long")).withColumn("block", F.floor(F.col("turn") / block))
    blocks = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    earlier = W.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("__conv"),
        F.col("block").alias("__block"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before"),
    )
    here = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumn("at", F.row_number().over(here) - 1).withColumn(
        "before", F.coalesce(F.sum("chars").over(here.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    joined = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("block").eqNullSafe(F.col("__block")))
    start = F.col("before") + F.col("chars_before")
    text_start = start + F.char_length("head")
    return joined.select(
        "conv_id",
        (F.col("at") + F.col("n_before")).cast("long").alias("turn_no"),
        "formatted",
        start.cast("long").alias("start"),
        text_start.cast("long").alias("text_start"),
        (text_start + F.char_length("body")).cast("long").alias("text_end"),
        (start + F.col("chars")).cast("long").alias("end"),
        (F.col("role") == TARGET_ROLE).alias("target"),
    )


def expand(stream: DataFrame) -> DataFrame:
    """One example per assistant turn: ``conv_id, turn_no, context_end, loss_start, loss_end, end``.

    The example is the stream up to ``end``; ``context_end`` closes the turns before the reply, and only
    ``loss_start`` to ``loss_end`` is trainable. A conversation without a reply has no example.
    """
    return stream.filter("target").select(
        "conv_id", "turn_no", F.col("start").alias("context_end"), F.col("text_start").alias("loss_start"), F.col("text_end").alias("loss_end"), "end"
    )


def streams(stream: DataFrame) -> DataFrame:
    """``conv_id, formatted``: the segments of each conversation put together, as a trainer reads them."""
    ordered = F.array_sort(F.collect_list(F.struct("turn_no", "formatted")))
    return stream.groupBy("conv_id").agg(ordered.alias("s")).select("conv_id", F.array_join(F.col("s.formatted"), "").alias("formatted"))


def render(examples: DataFrame, stream: DataFrame) -> DataFrame:
    """Examples written out in full: ``conv_id, turn_no, prompt, reply``.

    The prompt is the whole context and the head of the reply. Output is as long as all prefixes together.
    """
    whole = streams(stream).withColumnRenamed("conv_id", "__conv")
    both = examples.join(whole, F.col("conv_id").eqNullSafe(F.col("__conv")))
    return both.select(
        "conv_id",
        "turn_no",
        F.substring("formatted", F.lit(1), F.col("loss_start").cast("int")).alias("prompt"),
        F.substring("formatted", (F.col("loss_start") + 1).cast("int"), (F.col("end") - F.col("loss_start")).cast("int")).alias("reply"),
    )


def format_chats(turns: DataFrame, **columns) -> tuple[DataFrame, DataFrame]:
    """Store the stream of all conversations and give (segments, examples)."""
    stream = materialize(segments(turns, **columns), "chat-segments")
    return stream, expand(stream)


def read_back(stream: DataFrame, examples: DataFrame) -> DataFrame:
    """Digests of what the output holds, per conversation, from the formatted text alone.

    Turns are found by the control strings; the text under the loss mask by the spans of the examples.
    """
    marks = examples.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "loss_start", "loss_end"))).alias("spans"))
    both = streams(stream).alias("s").join(marks.alias("m"), F.col("s.conv_id").eqNullSafe(F.col("m.conv_id")), "left").select("s.conv_id", "formatted", "spans")
    pieces = F.filter(F.split("formatted", r"\[INST\]"), lambda p: p != "")
    halves = F.transform(pieces, lambda p: F.split(p, r"\[/INST\]", 2))
    turns = F.transform(
        halves,
        lambda h: F.concat(unescape(h[0]), F.lit("\n"), unescape(F.substring_index(h[1], CLOSE, 1)), F.lit("\n")),
    )
    masked = F.transform(
        F.coalesce("spans", F.array()),
        lambda x: unescape(F.substring(F.col("formatted"), (x["loss_start"] + 1).cast("int"), (x["loss_end"] - x["loss_start"]).cast("int"))),
    )
    return both.select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
