"""Grids: rows of string cells keyed by file; the header is row 0."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.operators.blocks import first_rows, ordered_text, row_numbers
from veil.operators.rules import Rule, column_words
from veil.schema import HIDDEN


def clean_cells(rows: DataFrame) -> DataFrame:
    """Null cells become empty, rows without any text are dropped."""
    cells = F.transform("cells", lambda c: F.coalesce(c, F.lit("")))
    return rows.withColumn("cells", cells).filter(F.exists("cells", lambda c: c.rlike(r"\S")))


def cap_sheet(rows: DataFrame, keys: tuple[str, ...] = ("file_id", "sheet"),
              n: int | None = None) -> DataFrame:
    """The first ``n`` rows of each sheet (all by default), with its true row count as ``total``."""
    rows = clean_cells(rows)
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    kept = rows if n is None else first_rows(rows, list(keys), ["row_idx"], n)
    return kept.join(total, list(keys))


def grid_to_text(capped: DataFrame, file: str = "file_id") -> DataFrame:
    """Sheets of a file as text: a header line, cells by `` | ``, rows by newline.

    Input comes from :func:`cap_sheet`, which counts the rows of a sheet.
    """
    line = capped.withColumn("text", F.array_join("cells", " | "))
    sheets = line.groupBy(file, "sheet", "total").agg(F.array_sort(F.collect_list(
        F.struct("row_idx", "text"))).alias("__r"))
    head = F.concat(F.lit("--- sheet: "), "sheet", F.lit(" ("), "total", F.lit(" rows) ---\n"))
    texts = sheets.select(file, "sheet", F.concat(head, F.array_join("__r.text", "\n")).alias("text"))
    numbered = row_numbers(texts.withColumn("__o", F.lit(0)), [file], "__o", "no", ties=("sheet",))
    return ordered_text(numbered, [file], "no", "text", "\n\n")


def is_column(header: Column, words: list[str]) -> Column:
    """Does a header cell (or one of its words) name one of the columns, typos allowed?"""
    whole = F.regexp_replace(F.lower(header), "[^a-z0-9]", "")
    parts = F.regexp_extract_all(F.lower(header), F.lit("[a-z0-9]+"), F.lit(0))
    forms = F.concat(F.array(whole), parts)
    hit = F.lit(False)
    def near(word: str):
        cap = 0 if len(word) < 4 else 1 if len(word) <= 5 else 2
        return lambda form: F.levenshtein(form, F.lit(word), cap) >= 0

    for w in words:
        hit = hit | F.exists(forms, near(w))
    return hit


def resolve_columns(rows: DataFrame, rules: Iterable[Rule], file: str = "file_id") -> DataFrame:
    """Hidden column numbers (0-based) of each file, from ``colname`` and ``colindex`` rules."""
    rules = list(rules)
    words = column_words(rules)
    fixed = [int(r.value) - 1 for r in rules if r.kind == "colindex"]
    named = F.filter(F.transform("cells", lambda c, i: F.when(
        is_column(c, words), i)), lambda i: i.isNotNull())
    index = F.array(*[F.lit(i) for i in fixed]).cast("array<int>")
    return rows.filter(F.col("row_idx") == 0).select(
        file, F.array_sort(F.array_distinct(F.concat(named, index))).alias("hidden_cols"))


def _row_tests(rules: list[Rule]) -> Column:
    """Row rules as a test of ``rn`` (1-based data row) and ``data_rows``."""
    test = F.lit(False)
    for r in rules:
        if r.kind == "row":
            test = test | (F.col("rn") == int(r.value))
        elif r.kind == "rowset":
            lo, hi = (int(x) for x in r.value.split("-"))
            test = test | F.col("rn").between(lo, hi)
        elif r.kind == "firstrows":
            test = test | (F.col("rn") <= int(r.value))
        elif r.kind == "lastrows":
            test = test | (F.col("rn") > F.col("data_rows") - int(r.value))
    return test & (F.col("row_idx") > 0)


def apply_grid_rules(rows: DataFrame, rules: Iterable[Rule], file: str = "file_id", dense: bool = False) -> DataFrame:
    """Hide cells by column, row and value rules; adds ``hidden`` (cells hidden in the row).

    Runs before any detector: a rule can remove what would otherwise be scanned. Row numbers are
    only worked out when a row rule asks for them. ``dense``: ``row_idx`` runs from 0 without gaps in every file,
    so it is the row number, and column numbers need no look at the header.
    """
    rules = list(rules)
    out = rows
    if any(r.kind in ("row", "rowset", "firstrows", "lastrows") for r in rules):
        out = out.withColumn("rn", F.col("row_idx")) if dense else row_numbers(
            out, [file], "row_idx", "rn").withColumn("rn", F.col("rn") - 1)
        if any(r.kind == "lastrows" for r in rules):
            size = rows.groupBy(file).agg((F.count(F.lit(1)) - 1).alias("data_rows"))
            out = out.join(size, file)
        out = out.withColumn("__row", _row_tests(rules)).drop("rn", "data_rows")
    else:
        out = out.withColumn("__row", F.lit(False))
    if dense and not column_words(rules):
        fixed = [F.lit(int(r.value) - 1) for r in rules if r.kind == "colindex"]
        out = out.withColumn("__cols", F.array(*fixed).cast("array<int>"))
    elif any(r.kind in ("colname", "colindex") for r in rules):
        out = out.join(resolve_columns(rows, rules, file), file, "left").withColumn(
            "__cols", F.coalesce("hidden_cols", F.array().cast("array<int>"))).drop("hidden_cols")
    else:
        out = out.withColumn("__cols", F.array().cast("array<int>"))
    terms = [r.value.lower() for r in rules if r.kind == "term"]

    def is_hidden(cell: Column, i: Column) -> Column:
        hide = F.col("__row") | (F.array_contains("__cols", i) & (F.col("row_idx") > 0))
        for t in terms:
            hide = hide | (F.lower(cell).contains(t) & (F.col("row_idx") > 0))
        return hide

    marks = F.transform("cells", lambda c, i: F.struct(c.alias("c"), is_hidden(c, i).alias("h")))
    out = out.withColumn("__m", marks)
    return (out.withColumn("cells", F.transform("__m", lambda m: F.when(
        m["h"], F.lit(HIDDEN)).otherwise(m["c"])))
        .withColumn("hidden", F.size(F.filter("__m", lambda m: m["h"])))
        .drop("__m", "__row", "__cols"))


def hidden_counts(applied: DataFrame, file: str = "file_id") -> DataFrame:
    """Cells hidden by the rules, per file."""
    return applied.groupBy(file).agg(F.sum("hidden").cast("long").alias("count"))
