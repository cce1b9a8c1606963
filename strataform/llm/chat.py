"""Chat formatting by perspective rotation.

For each participant the dialogue is rendered with that speaker as the assistant and all others as named
users. The rendering comes in segments, one for each turn, with their character offsets in the whole: a
dialogue of any length is never gathered in one place, and ``string_agg`` over turns gives its text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.llm.common import partitions, written

END = "<|end|>\n"


def safe(text: Column) -> Column:
    """No marker can be forged: all begin with ``<|``."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def safe_name(name: Column) -> Column:
    """Nor can a name end its header."""
    out = F.replace(safe(name), F.lit("|>"), F.lit("|\\>"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def rotate(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    system_roles: Sequence[str] = ("system",),
) -> DataFrame:
    """``conv_id, perspective, turn, nth, speaks_as, segment, seg_start, seg_end, mask_start, mask_end``.

    A mask covers what the model is to learn, text and end mark of the assistant's turns; other segments have
    null masks. System roles stay system and get no perspective. A null role is the participant "unknown", and
    one with that name is the same participant. A null text is empty, a null turn comes first, and rows without a
    conversation form one together. Turns of the same number are ordered by role and the MD5 of the text, and ``nth``
    tells them apart; repeated rows stay. A dialogue of system turns only has no perspective and no rows. ``<|`` in names and
    texts becomes ``<\\|``; in names ``|>`` becomes ``|\\>``, and line breaks ``\\n`` and ``\\r``.
    """
    turns = df.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    # Blocks are ranges of the turns in order, from sampled splitters: a long dialogue, or one of many turns of the
    # same number, has several. Turns alike in all are dealt by where they come from. Numbers and offsets are summed
    # within blocks, and over the blocks of a dialogue: no window spans it.
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    turns = turns.withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("dealt", F.spark_partition_id())
    ranges = turns.repartitionByRange(partitions(df.sparkSession), F.asc_nulls_first("conv_id"), *order, "dealt")
    turns = written(ranges.withColumn("block", F.spark_partition_id()).drop("dealt"), "turns")
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    system = F.col("role").isin(*system_roles) if system_roles else F.lit(False)
    speakers = turns.where(~system).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    views = turns.withColumn("nth", F.row_number().over(inside)).join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = F.col("role") == F.col("perspective")
    head = F.when(system, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), safe_name(F.col("role")), F.lit("|>\n")))
    views = views.withColumn("head", head).withColumn("segment", F.concat("head", safe(F.col("text")), F.lit(END)))
    views = views.withColumn("n", F.char_length("segment").cast("long"))
    run = Window.partitionBy("conv_id", "perspective", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = views.groupBy("conv_id", "perspective", "block").agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("rows"))
    blocks = blocks.select(
        F.col("conv_id").alias("of"),
        F.col("perspective").alias("by"),
        F.col("block").alias("at"),
        F.coalesce(F.sum("chars").over(whole), F.lit(0)).alias("chars"),
        F.coalesce(F.sum("rows").over(whole), F.lit(0)).alias("rows"),
    )
    views = views.withColumn("seg_end", F.sum("n").over(run))
    placed = views.join(blocks, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("perspective") == F.col("by")) & (F.col("block") == F.col("at")))
    end = F.col("seg_end") + F.col("chars")
    start = end - F.col("n")
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        (F.col("nth") + F.col("rows") - 1).cast("long").alias("nth"),
        F.when(system, "system").when(own, "assistant").otherwise("user").alias("speaks_as"),
        "segment",
        start.alias("seg_start"),
        end.alias("seg_end"),
        F.when(own & ~system, start + F.char_length("head")).alias("mask_start"),
        F.when(own & ~system, end - 1).alias("mask_end"),
    )
