"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For every participant of a conversation, the whole dialogue is rendered with that
speaker as assistant and the others as named users; the loss mask covers what the
assistant says, its end marker included. A rendered dialogue is returned as its
segments, one row per participant and turn, with the place of each in the dialogue's
text (code points) and the span to train on. Concatenating ``segment`` by ``position``
gives the text, so no task ever holds a whole conversation, however long it is.

Places are prefix sums in two levels: within blocks of ``BLOCK`` turns, then over the
blocks of a dialogue.

Defined results: turns are ordered by turn (null first), speaker and text, so ties and
repeated rows have fixed places; a null text is empty; a null role is the speaker
``unknown``, who is no participant; ``system`` turns keep their role and are no
participant either, so a conversation of only such turns has no rows; a null conv_id is
a conversation of its own; markers inside texts and shown names are broken by a space, and line breaks in shown names are spaces; very long
texts are whole segments; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusewright.functions.storage import materialize

BLOCK = 64
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, NOBODY = "system", "unknown"


def _broken(text: Column) -> Column:
    """No markers but those of the format."""
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def _header(role: Column, name: Column) -> Column:
    return F.concat(F.lit(START), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))


def rotate_perspectives(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, participant, position, turn, role, name, segment, start, stop, mask_start, mask_stop (null: not trained on)."""
    text = _broken(F.coalesce("text", F.lit("")))
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(NOBODY)).alias("speaker"), text.alias("text"))
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-1)))
    speakers = turns.filter(~F.col("speaker").isin(SYSTEM, NOBODY)).select(F.col("conv_id").alias("p_conv"), F.col("speaker").alias("participant")).distinct()
    # written first, so that a hot conversation's side of the join can be split at run time
    rotated = turns.join(materialize(speakers, "speakers"), F.col("conv_id").eqNullSafe(F.col("p_conv"))).drop("p_conv")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("participant"), "assistant").otherwise("user")
    rotated = rotated.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    header = _header(F.col("role"), F.translate(_broken(F.col("name")), "\r\n", "  "))
    rotated = rotated.withColumn("head", F.length(header)).withColumn("segment", F.concat(header, F.col("text"), F.lit(END + "\n")))
    rotated = rotated.withColumn("size", F.length("segment").cast("long"))

    dialogue = [F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("d_conv"), F.col("conv_id").isNull().alias("d_null")]
    rotated = rotated.select("*", *dialogue)
    key = ["d_conv", "d_null", "participant", "block"]
    before = Window.partitionBy(*key).orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    within = rotated.withColumns({"in_block": F.coalesce(F.sum("size").over(before), F.lit(0)), "at": F.count("size").over(before)})
    over = Window.partitionBy(*key[:-1]).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rotated.groupBy(*key).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    starts = totals.select(*key, F.coalesce(F.sum("s").over(over), F.lit(0)).alias("block_start"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("block_at"))
    start = F.col("block_start") + F.col("in_block")
    trained = F.col("role") == "assistant"
    return within.join(starts, key).select(
        "conv_id", "participant", (F.col("block_at") + F.col("at")).alias("position"), "turn", "role", "name", "segment",
        start.alias("start"), (start + F.col("size")).alias("stop"),
        F.when(trained, start + F.col("head")).alias("mask_start"), F.when(trained, start + F.col("size") - 1).alias("mask_stop"),
    )
