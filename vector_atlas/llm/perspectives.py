"""Chat formatting from every participant's point of view.

For each participant of a conversation the whole dialogue is rendered with that speaker as the
assistant and all others as named users; system turns stay system turns. Masks mark the characters
the assistant wrote, the ones to train on. A rendered dialogue is one value, so a task holds the
conversations it renders one at a time; a caller who wants shorter texts asks for parts of ``block`` turn
numbers. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    """Text that cannot close or open a turn."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: str = "system", block: int | None = None) -> DataFrame:
    """One row per conversation and participant: ``conv_col, perspective, n_turns, rendered, masks``; with
    ``block``, one per part of that many turn numbers as well (``part``; null numbers form one with a null).

    ``masks`` are character ranges [start, end) of ``rendered``. Turns are ordered by number (null first),
    then role, then text. A null role is the participant ``unknown``,
    a null text is empty; a null conversation id is a conversation of its own. Repeated rows are
    rendered as often as they occur. A conversation of system turns only has no participant.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), _plain(F.col(text_col)).alias("text"),
    ).withColumn("part", F.lit(0) if block is None else F.floor(F.col("turn") / block).cast("long"))
    spoken = rows.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = rows.where(F.col("role") != system).select(F.col("conv").alias("c"), F.col("role").alias("perspective")).distinct()
    seen = spoken.join(speakers, F.col("conv").eqNullSafe(F.col("c"))).drop("c")

    def head(t):
        name = F.when(t["role"] == F.col("perspective"), "assistant").when(t["role"] == system, system)
        return F.concat(F.lit(OPEN), F.coalesce(name, F.concat(F.lit("user name="), _plain(t["role"]))), F.lit("\n"))

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["text"].alias("body"), (t["role"] == F.col("perspective")).alias("own")))
    tail = F.lit(CLOSE + "\n")
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], tail)), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("masks"))

    def add(state, p):
        a = state["at"] + F.length(p["head"])
        b = a + F.length(p["body"])
        masks = F.when(p["own"], F.array_append(state["masks"], F.struct(a.alias("start"), b.alias("end")))).otherwise(state["masks"])
        return F.struct((b + len(CLOSE) + 1).alias("at"), masks.alias("masks"))

    seen = seen.withColumn("pieces", pieces)
    part = [] if block is None else ["part"]
    return seen.select(
        F.col("conv").alias(conv_col), "perspective", *part, F.size("pieces").cast("long").alias("n_turns"), whole.alias("rendered"),
        F.aggregate("pieces", start, add, lambda s: s["masks"]).alias("masks"),
    )
