"""Numbered placeholders and session bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.text import normal_value
from veil.operators.blocks import row_numbers, running
from veil.session import cut, shuffled


def number_placeholders(items: DataFrame, session: str = "conv_id", turn: str = "turn",
                        start: str = "start", width: int = 1_000_000) -> DataFrame:
    """Same value, same number within a session and category, by first appearance.

    Equal values collapse in a pre-aggregated group first, so the ranking sees each value once.
    Adds ``number``.
    """
    # Findings are small beside the texts they come from: written once, the texts are read once.
    keyed = cut(items.withColumn("__n", normal_value(F.col("value"))))
    first = keyed.groupBy(session, "cat", "__n").agg(
        F.min(F.struct(F.col(turn).alias("t"), F.col(start).alias("s"))).alias("f")
    ).select(session, "cat", "__n", F.col("f.t").alias("__t"), F.col("f.s").alias("__s"))
    ranked = row_numbers(first, [session, "cat"], "__t", "number", width=width, ties=("__s", "__n"))
    return keyed.join(shuffled(ranked.select(session, "cat", "__n", "number")),
                      [session, "cat", "__n"]).drop("__n")


def attach_once(turns: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Mark the one turn of each session that carries the screen context (the first)."""
    first = turns.groupBy(session).agg(F.min(turn).alias(turn)).withColumn("with_screen", F.lit(True))
    return turns.join(shuffled(first), [session, turn], "left").withColumn(
        "with_screen", F.coalesce("with_screen", F.lit(False)))


def session_epoch(turns: DataFrame, is_reset, session: str = "conv_id", turn: str = "turn",
                  width: int = 1_000_000) -> DataFrame:
    """Count of resets up to and including each turn: memory starts afresh with each epoch."""
    flag = F.when(is_reset, 1).otherwise(0).cast("long")
    out = running(turns, [session], turn, flag, "__e", width=width)
    return out.withColumn("epoch", F.coalesce("__e", F.lit(0)) + flag).drop("__e")


def drop_unanswered(turns: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Remove a user turn that nothing follows (the send failed)."""
    last = turns.groupBy(session).agg(F.max(F.struct(turn, "role")).alias("l"))
    lost = last.filter(F.col("l.role") == "user").select(session, F.col(f"l.{turn}").alias(turn))
    return turns.join(lost, [session, turn], "left_anti")


def last_user_turn(turns: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    users = turns.filter(F.col("role") == "user")
    last = users.groupBy(session).agg(F.max(F.struct(turn, "text")).alias("l"))
    return last.select(session, F.col(f"l.{turn}").alias(turn), F.col("l.text").alias("text"))
