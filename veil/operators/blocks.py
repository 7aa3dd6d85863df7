"""Running totals that survive a hot key.

A plain ordered window sends a whole key to one task. Here the order axis is cut into blocks of
fixed width: a window runs inside each (key, block), block totals are pre-aggregated before their
shuffle, and only those totals - one row per block - meet per key. Blocks come from the order
value itself, so a lost task recomputes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.session import shuffled

FOLDS = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest)}


def running(df: DataFrame, keys: list[str], order: str, value: Column, out: str, *,
            fold: str = "sum", width: float = 100_000, ties: tuple[str, ...] = ()) -> DataFrame:
    """Fold of ``value`` over all earlier rows of the key (exclusive); null on the first row.

    Rows are ordered by ``order`` then ``ties``, which together must be unique within a key.
    """
    agg, both = FOLDS[fold]
    rows = df.withColumn("__b", F.floor(F.col(order) / width)).withColumn("__v", value)
    before = (Window.partitionBy(*keys, "__b").orderBy(order, *ties)
              .rowsBetween(Window.unboundedPreceding, -1))
    earlier = (Window.partitionBy(*keys).orderBy("__b")
               .rowsBetween(Window.unboundedPreceding, -1))
    inner = rows.withColumn("__in", agg("__v").over(before))
    totals = (rows.groupBy(*keys, "__b").agg(agg("__v").alias("__tot"))
              .select(*keys, "__b", agg("__tot").over(earlier).alias("__pre")))
    joined = inner.join(shuffled(totals), [*keys, "__b"])
    pre, own = F.col("__pre"), F.col("__in")
    merged = F.when(pre.isNull(), own).when(own.isNull(), pre).otherwise(both(pre, own))
    return joined.withColumn(out, merged).drop("__b", "__v", "__in", "__pre")


def row_numbers(df: DataFrame, keys: list[str], order: str, out: str = "rn", *,
                width: float = 100_000, ties: tuple[str, ...] = ()) -> DataFrame:
    """1-based row number within the key."""
    counted = running(df, keys, order, F.lit(1).cast("long"), out, width=width, ties=ties)
    return counted.withColumn(out, F.coalesce(out, F.lit(0)) + 1)


def first_rows(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key. Catalyst limits each task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def part_of(order: str, per_part: int) -> Column:
    """The part of :func:`ordered_text` that a row is in."""
    return F.floor(F.col(order) / per_part).cast("int")


def ordered_text(df: DataFrame, keys: list[str], order: str, text: str, sep: str, *,
                 per_part: int = 10_000) -> DataFrame:
    """Rows of a key joined in order, one text per ``per_part`` order values.

    Ordinary keys give one part (``part_no`` 0). A huge one is split into several, so no task has
    to hold it whole and nothing is cut off.
    """
    got = df.groupBy(*keys, part_of(order, per_part).alias("part_no")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))
                     ).alias("__p"))
    return got.select(*keys, "part_no", F.array_join(F.col("__p.t"), sep).alias(text))
