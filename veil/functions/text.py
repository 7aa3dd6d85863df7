"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.schema import PLACEHOLDER


def collapse_ws(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip(c: Column) -> Column:
    """Both ends trimmed of any white space, line ends included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def alnum_lower(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def normal_value(c: Column) -> Column:
    """The key under which equal values share a number: lower case, single spaces."""
    return F.lower(collapse_ws(c))


def phrase_placeholder(c: Column) -> Column:
    """`QR code` to `[QR_CODE]`."""
    return F.concat(F.lit("["), F.replace(F.upper(c), F.lit(" "), F.lit("_")), F.lit("]"))


def placeholder_class(c: Column) -> Column:
    """Drop the number of a placeholder; every secret description becomes `[SECRET]`."""
    bare = F.regexp_replace(c, r"_[0-9]+\]$", "]")
    return F.when(bare.startswith("[SECRET:"), F.lit("[SECRET]")).otherwise(bare)


def placeholder_tokens(c: Column) -> Column:
    """Placeholder tokens of a text, all of them, in order."""
    return F.regexp_extract_all(c, F.lit(PLACEHOLDER), F.lit(0))


def cut_text(c: Column, max_chars: int) -> Column:
    """Keep ``max_chars`` characters and say so when something was cut."""
    return F.when(F.length(c) > max_chars,
                  F.concat(F.substring(c, 1, max_chars), F.lit("\n… truncated"))).otherwise(c)
