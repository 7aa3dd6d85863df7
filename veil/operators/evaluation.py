"""Predicted spans against planted ones: which values were found whole, in part, under another name, or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OUTCOMES = ("caught", "wide", "wrong_category", "cut_short", "missed", "false_alarm")

# Truth and predicted spans of one island that overlap, best pair first: equal spans, then the same category,
# then the longest overlap, then by place.
_PAIRS = """array_sort(flatten(transform(truth, (a, i) -> filter(transform(found, (b, j) -> named_struct(
  'exact', if(a.start = b.start AND a.end = b.end, 0, 1), 'cat', if(a.cat <=> b.cat, 0, 1),
  'gap', greatest(a.start, b.start) - least(a.end, b.end), 'i', i, 'j', j)), p -> p.gap < 0))))"""
# Each span is in one pair at most.
_CHOSEN = f"""aggregate({_PAIRS}, named_struct('i', cast(array() AS array<int>), 'j', cast(array() AS array<int>)),
  (z, p) -> if(array_contains(z.i, p.i) OR array_contains(z.j, p.j), z,
    named_struct('i', concat(z.i, array(p.i)), 'j', concat(z.j, array(p.j)))))"""
_OUTCOME = """CASE WHEN b IS NULL THEN 'missed' WHEN b.start > a.start OR b.end < a.end THEN 'cut_short'
  WHEN NOT (a.cat <=> b.cat) THEN 'wrong_category' WHEN b.start = a.start AND b.end = a.end THEN 'caught' ELSE 'wide' END"""


def span_outcomes(predicted: DataFrame, truth: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per planted span (keys, start, end, cat, outcome), and one per predicted span left over.

    Both sides have ``keys``, ``start``, ``end``, ``cat``. Spans are paired one to one where they overlap:
    equal spans first, then those of one category, then by the longest overlap. Outcomes of a planted span:
    ``caught`` (equal, same category), ``wide`` (covered, with more), ``wrong_category`` (covered),
    ``cut_short`` (a part stays visible, whatever the category), ``missed``. A predicted span without a partner is a
    ``false_alarm`` with its own category.

    Both sides meet in one shuffle on ``keys``, without a join: spans in order of their start fall into
    islands of overlapping spans, and each island is paired in its own row. Repeated rows count once; spans
    with a null key or bound, and empty ones, are left out; a null category is a category.
    """
    def side(df: DataFrame, planted: bool) -> DataFrame:
        return (df.select(*keys, F.col("start").cast("int"), F.col("end").cast("int"), "cat").dropna(
            subset=[*keys, "start", "end"]).filter("end > start").distinct().withColumn("__planted", F.lit(planted)))

    rows = side(predicted, False).unionByName(side(truth, True))
    order = Window.partitionBy(*keys).orderBy("start", "end", "__planted", "cat")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("__new", (reach.isNull() | (F.col("start") >= reach)).cast("int"))
    islands = opened.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct("start", "end", "cat")
    packed = islands.groupBy(*keys, "__island").agg(
        F.array_sort(F.collect_list(F.when(F.col("__planted"), span))).alias("truth"),
        F.array_sort(F.collect_list(F.when(~F.col("__planted"), span))).alias("found"))
    chosen = packed.withColumn("chosen", F.expr(_CHOSEN))
    partner = "if(array_contains(chosen.i, i), found[chosen.j[array_position(chosen.i, i) - 1]], NULL)"
    planted = (f"transform(truth, (a, i) -> element_at(transform(array({partner}), b -> named_struct("
               f"'start', a.start, 'end', a.end, 'cat', a.cat, 'outcome', {_OUTCOME})), 1))")
    alarms = ("transform(filter(transform(found, (b, j) -> named_struct('b', b, 'j', j)), x -> NOT array_contains("
              "chosen.j, x.j)), x -> named_struct('start', x.b.start, 'end', x.b.end, 'cat', x.b.cat, 'outcome', 'false_alarm'))")
    return chosen.select(*keys, F.inline(F.expr(f"concat({planted}, {alarms})")))


def span_scores(outcomes: DataFrame) -> DataFrame:
    """Per category: positives, each outcome's count, recall (caught or wide) and precision (of all predicted)."""
    n = {o: F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES}
    counted = outcomes.groupBy("cat").agg(F.count_if(F.col("outcome") != "false_alarm").alias("positives"), *n.values())
    good = F.col("caught") + F.col("wide")
    given = good + F.col("wrong_category") + F.col("cut_short") + F.col("false_alarm")
    share = lambda whole: F.when(whole > 0, good / whole)
    return counted.select("*", share(F.col("positives")).alias("recall"), share(given).alias("precision"))
