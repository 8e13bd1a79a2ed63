"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue the dialogue is rendered with that participant as the assistant and
the others as named users; only the assistant's words and the end mark after them are to be learned.
A rendering is a row per turn with its place, so that a dialogue of any length is never gathered in a
task; the rows of a rendering in order of ``start``, put together, are its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import running_sums

#: Marks of the template. In captured text ``<|`` is written ``< |``, so that no text makes a mark.
ASSISTANT, USER, END = "<|assistant|>\n", "<|user|>", "<|end|>\n"
#: Name of participants whose role is null.
NOBODY = "unknown"
#: Ranges of turn numbers between whose bounds a dialogue's turns are counted.
PARTS = 256


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, turn, name, role, start, length, mask_start, mask_end, segment.

    start and length count code points in the rendering; mask_start to mask_end (end excluded) is to be
    learned, null for users' turns. Turns stand by number, nulls last, ties by name and text; repeated
    rows are turns of their own. Null names are ``unknown``, null texts empty, a null conversation is
    one; texts of any length are handled row by row. Extra columns are left out, whatever their names; an empty table
    gives no rows. Places come from running sums over ranges of turn numbers that hold about equally many turns, so that
    a dialogue with a third of all rows is spread over many tasks, outliers among the numbers or not. Turns of a
    dialogue with one and the same number, or none, meet in one task. Participants and bounds are joined to turns by
    inner joins, whose large keys adaptive execution splits.
    """
    clean = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    t = turns.select(F.col(conversation).alias("_conv"), F.col(turn).cast("long").alias("_turn"), F.coalesce(F.col(speaker).cast("string"), F.lit(NOBODY)).alias("_name"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    people = t.select("_conv", F.col("_name").alias("_own")).distinct()
    # bounds between which about equally many turns lie; a turn's place is its bounds' number and its part of the way between them
    shares = F.array(*[F.lit(i / PARTS) for i in range(PARTS + 1)])
    spans = t.groupBy("_conv").agg(F.coalesce(F.min("_turn"), F.lit(0)).alias("_low"), F.coalesce(F.max("_turn"), F.lit(0)).alias("_high"), F.percentile_approx("_turn", shares, F.lit(1000)).alias("_bounds"))
    spans = spans.withColumn("_bounds", F.array_distinct(F.coalesce("_bounds", F.array(F.lit(0).cast("long")))))
    a, s, p = t.alias("a"), spans.alias("s"), people.alias("p")
    placed = a.join(s, F.col("a._conv").eqNullSafe(F.col("s._conv"))).select("a.*", F.col("_high"), F.col("_low"), F.col("_bounds"))
    b = placed.alias("b")
    rows = b.join(p, F.col("b._conv").eqNullSafe(F.col("p._conv"))).select("b.*", F.col("p._own").alias("_own"))
    order = F.coalesce("_turn", F.col("_high") + 1)
    mine = F.col("_own") == F.col("_name")
    # the bounds are distinct and rise from the smallest turn on; nulls come after the largest
    step = F.size(F.filter("_bounds", lambda x: x <= order))
    low, high = F.get("_bounds", step - 1), F.get("_bounds", step)
    place = (step - 1 + F.coalesce((order - low).cast("double") / (high - low), F.when(order > F.col("_high"), F.lit(0.75)).otherwise(F.lit(0.0)))) / F.size("_bounds")
    head = F.when(mine, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), clean(F.col("_name")), F.lit(": ")))
    rows = rows.select(
        "_conv", "_own", "_turn", "_name", mine.alias("_mine"), order.alias("_order"), place.alias("_place"),
        F.length(head).cast("long").alias("_head"), F.concat(head, clean(F.col("_text")), F.lit(END)).alias("segment"),
    ).withColumn("_length", F.length("segment").cast("long"))
    out = running_sums(rows, ["_conv", "_own"], "_place", ["_length"], ties=["_order", "_name", "segment"])
    start = F.col("before__length")
    return out.select(
        F.col("_conv").alias("conv_id"), F.col("_own").alias("perspective"), F.col("_turn").alias("turn"), F.col("_name").alias("name"), F.when(F.col("_mine"), "assistant").otherwise("user").alias("role"),
        start.cast("long").alias("start"), F.col("_length").alias("length"), F.when(F.col("_mine"), start + F.col("_head")).cast("long").alias("mask_start"),
        F.when(F.col("_mine"), start + F.col("_length") - 1).cast("long").alias("mask_end"), "segment",
    )
