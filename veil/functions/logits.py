"""Scores of a token classifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def winning_label(logits: Column) -> Column:
    """Index of the first largest logit."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def winning_score(logits: Column) -> Column:
    """Softmax probability of the winning label."""
    top = F.array_max(logits).cast("double")
    return 1 / F.aggregate(logits, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top))
