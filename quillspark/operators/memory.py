"""Conversation memory over (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

HEADING = "\n\nRecent conversation:\n"


def _messages(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("role").isin("user", "assistant"))


def history_pairs(turns: DataFrame) -> DataFrame:
    """Question and answer by position: messages 2i and 2i + 1; an odd last
    message has no pair."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = _messages(turns).withColumn("i", at)
    pairs = rows.groupBy("conv_id", F.floor(F.col("i") / 2).cast("int").alias("pair")).agg(
        F.max(F.when(F.col("i") % 2 == 0, F.col("text"))).alias("question"),
        F.max(F.when(F.col("i") % 2 == 1, F.col("text"))).alias("answer"),
        F.count("*").alias("n"),
    )
    return pairs.where("n = 2").drop("n")


#: Messages of a conversation that a task takes together.
BLOCK = 1_000


def message_line() -> Column:
    return F.concat(F.when(F.col("role") == "user", "Human: ").otherwise("Assistant: "), T.text_of("text"))


def numbered_messages(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Messages with their place ``i`` in the conversation, from 0, by turn (a
    null turn is first) and text.  A long conversation is numbered in stretches of
    turns, so that no task has to take it whole."""
    rows = _messages(turns).withColumn("_stretch", F.floor(F.col("turn") / block))
    before = Window.partitionBy("conv_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "_stretch").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("conv_id").alias("_conv"), F.col("_stretch").alias("_at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("conv_id", "_stretch").orderBy("turn", "text")) - 1
    joined = rows.withColumn("i", own).join(counts, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_stretch").eqNullSafe(F.col("_at")))
    return joined.withColumn("i", F.col("i") + F.col("_before")).drop("_stretch", "_conv", "_at", "_before")


def memory_by_turn(turns: DataFrame, last: int = 4, block: int = BLOCK) -> DataFrame:
    """conv_id, turn, text, memory of every user message: the prompt text of the
    up to ``last`` messages before it, empty before the first.  Conversations are
    divided into blocks that overlap by ``last`` messages."""
    part, late = F.floor(F.col("i") / block), F.col("i") % block >= block - last
    rows = numbered_messages(turns, block).withColumn("_own", part)
    rows = rows.withColumn("_part", F.explode(F.when(late, F.array(part, part + 1)).otherwise(F.array(part))))
    frame = Window.partitionBy("conv_id", "_part").orderBy("i").rowsBetween(-last, -1)
    lines = F.collect_list(message_line()).over(frame)
    rows = rows.withColumn("_lines", lines).where((F.col("_part") == F.col("_own")) & (F.col("role") == "user"))
    memory = F.when(F.size("_lines") == 0, "").otherwise(F.concat(F.lit(HEADING), F.array_join("_lines", "\n")))
    return rows.select("conv_id", "turn", "text", memory.alias("memory"))


def recent_memory(turns: DataFrame, last: int = 4) -> DataFrame:
    """The last messages of each conversation, as prompt text."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    line = F.concat(F.when(F.col("role") == "user", "Human: ").otherwise("Assistant: "), F.col("text"))
    rows = _messages(turns).withColumn("n", at).where(F.col("n") <= last).select("conv_id", "turn", line.alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return rows.groupBy("conv_id").agg(F.concat(F.lit(HEADING), F.array_join(ordered, "\n")).alias("memory"))


def clear_memory(turns: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """Turns without those of the given conversations, or none at all."""
    return turns.limit(0) if conv_ids is None else turns.join(conv_ids.select("conv_id"), "conv_id", "left_anti")
