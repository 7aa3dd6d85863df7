"""Tables rebuilt from the geometry of text boxes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veil.operators.blocks import running
from veil.operators.grid import apply_grid_rules
from veil.operators.regions import split_by_size
from veil.operators.rules import Rule
from veil.session import cut, shuffled


def bands(regions: DataFrame, image: str, lo: str, hi: str, name: str,
          width: float = 100_000.0) -> DataFrame:
    """Number the bands of one axis: a new band starts beyond everything that came before.

    Regions with the same lower edge collapse to one interval before anything is ordered. Gives
    one row per (image, lower edge).
    """
    edges = cut(regions.groupBy(image, lo).agg(F.max(hi).alias("__hi")))
    seen = running(edges, [image], lo, F.col("__hi"), "__seen", fold="max", width=width)
    flag = F.when(F.col("__seen").isNull() | (F.col(lo) > F.col("__seen")), 1).otherwise(0)
    marked = cut(seen.select(image, lo, flag.cast("long").alias("__new")))
    count = running(marked, [image], lo, F.col("__new"), "__n", width=width)
    return count.select(image, lo, (F.coalesce("__n", F.lit(0)) + F.col("__new") - 1)
                        .cast("int").alias(name))


def _place_small(regions: DataFrame, image: str) -> DataFrame:
    """Both axes by windows inside the image: one shuffle, one sort an axis."""
    out = regions
    for lo, hi, name in (("y0", "y1", "row"), ("x0", "x1", "col")):
        order = Window.partitionBy(image).orderBy(lo, hi)
        seen = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
        new = F.when(F.col("__seen").isNull() | (F.col(lo) > F.col("__seen")), 1).otherwise(0)
        out = out.withColumn("__seen", seen).withColumn("__new", new)
        out = out.withColumn(name, (F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    return out.drop("__seen", "__new")


def place_cells(regions: DataFrame, image: str = "image_id", small: int = 10_000) -> DataFrame:
    """Add ``row`` and ``col`` to each region.

    Images of up to ``small`` regions are placed by windows; what reads the result by image needs no further shuffle.
    Larger ones, which a window would sort in one task, go by :func:`bands` in blocks, with the same result.
    """
    less, more = split_by_size(regions, [image], small)
    out = _place_small(less, image)
    return out if more is None else out.unionByName(_place_large(more, image))


def _place_large(regions: DataFrame, image: str) -> DataFrame:
    rows, cols = bands(regions, image, "y0", "y1", "row"), bands(regions, image, "x0", "x1", "col")
    return cut(regions.join(rows, [image, "y0"]).join(cols, [image, "x0"]))


def table_shape(placed: DataFrame, image: str = "image_id") -> DataFrame:
    """Columns, rows and confidence (regions alone in their cell / all regions)."""
    cells = placed.groupBy(image, "row", "col").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy(image).agg(
        (F.max("col") + 1).alias("columns"), (F.max("row") + 1).alias("row_count"),
        (F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / F.sum("n")).alias("confidence"))


def rebuild_table(placed: DataFrame, shape: DataFrame, image: str = "image_id",
                  least: float = 0.5) -> DataFrame:
    """Rows of cells of every table that is clear enough; texts of a shared cell are joined."""
    sure = shape.filter(F.col("confidence") >= least).select(image, "columns")
    cell = placed.groupBy(image, "row", "col").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("region_id", "text"))), lambda r: r["text"]), " ").alias("t"))
    lines = cell.groupBy(image, "row").agg(F.map_from_entries(F.collect_list(
        F.struct("col", "t"))).alias("m"))
    row = F.transform(F.sequence(F.lit(0), F.col("columns") - 1),
                      lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    return lines.join(sure, image).select(F.col(image).alias("file_id"),
                                          F.col("row").alias("row_idx"), row.alias("cells"))


def _lines(placed: DataFrame, image: str, carry: tuple[str, ...]) -> DataFrame:
    """Rows of tables: texts and regions by column, and what the shape of the table is counted from."""
    cell = placed.groupBy(image, "row", "col").agg(
        F.array_sort(F.collect_list(F.struct("region_id", "text", *carry))).alias("b"))
    text = F.array_join(F.transform("b", lambda r: r["text"]), " ")
    return cell.groupBy(image, "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", text.alias("t")))).alias("m"),
        F.collect_list(F.struct("col", "b")).alias("regions"), F.max("col").alias("__last"),
        F.sum(F.when(F.size("b") == 1, 1).otherwise(0)).alias("__alone"), F.sum(F.size("b")).alias("__all"))


def rebuild_tables(regions: DataFrame, image: str = "image_id", least: float = 0.5, carry: tuple[str, ...] = (),
                   small: int = 10_000) -> DataFrame:
    """:func:`place_cells`, :func:`table_shape` and :func:`rebuild_table` in one pass over the regions.

    Every step groups by the image and more, so there is one shuffle; the shape is a window over the rows of an image,
    for images of more than ``small`` regions a join. Adds ``regions``: per column those of the cell, with ``carry``.
    """
    less, more = split_by_size(regions.filter(F.col(image).isNotNull()), [image], small)
    whole = Window.partitionBy(image)
    lines = _lines(_place_small(less, image), image, carry)
    lines = lines.select("*", (F.max("__last").over(whole) + 1).alias("columns"),
                         (F.sum("__alone").over(whole) / F.sum("__all").over(whole)).alias("__sure"))
    if more is not None:
        large = cut(_lines(_place_large(more, image), image, carry))
        shape = large.groupBy(image).agg((F.max("__last") + 1).alias("columns"),
                                         (F.sum("__alone") / F.sum("__all")).alias("__sure"))
        lines = lines.unionByName(large.join(shuffled(shape), image))
    row = F.transform(F.sequence(F.lit(0), F.col("columns") - 1),
                      lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    return lines.filter(F.col("__sure") >= least).select(
        F.col(image).alias("file_id"), F.col("row").alias("row_idx"), row.alias("cells"), "regions")


def cover_tables(regions: DataFrame, rules: Iterable[Rule], image: str = "image_id", least: float = 0.5,
                 small: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """:func:`apply_rules_to_table` on the tables of :func:`rebuild_tables`: rows carry their regions, so that the
    boxes to cover need no join. The columns of ``regions`` have to be sortable."""
    carry = tuple(c for c in regions.columns if c not in (image, "region_id", "text"))
    applied = apply_grid_rules(rebuild_tables(regions, image, least, carry, small), rules, dense=True)
    hidden = F.filter("regions", lambda r: F.get("cells", r["col"]) == "[HIDDEN]")
    cells = applied.select(F.col("file_id").alias(image), F.col("row_idx").alias("row"), F.inline(hidden))
    boxes = cells.select(image, "row", "col", F.inline("b")).select(
        image, "row", "col", *[c for c in regions.columns if c != image], F.lit("[HIDDEN]").alias("ph"))
    return applied.drop("regions"), boxes


def apply_rules_to_table(placed: DataFrame, table: DataFrame, rules: Iterable[Rule],
                         image: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """Grid rules on a rebuilt table: the rows after the rules, and the boxes to cover."""
    applied = apply_grid_rules(table, rules)
    hidden = applied.select(
        F.col("file_id").alias(image), F.col("row_idx").alias("row"),
        F.posexplode("cells").alias("col", "cell")).filter(F.col("cell") == "[HIDDEN]").drop("cell")
    boxes = placed.join(hidden, [image, "row", "col"], "left_semi").withColumn(
        "ph", F.lit("[HIDDEN]"))
    return applied, boxes
