"""Near duplicates by tiles and table bands: large groups give what small ones give."""

import random

import pytest

from tests.conftest import DATA
from veil.operators import regions, tables
from veil.operators.rules import Rule
from veil.plans.tables import derived

FIELDS = "image_id long, region_id int, x0 double, y0 double, x1 double, y1 double, text string"


def fold(rows, tol, edges):
    """The greedy fold, with a grid so that 100,000 points are quick."""
    kept, grid = set(), {}
    for r in sorted(rows, key=lambda r: r[1]):
        p = r[2:2 + edges]
        cell = (int(p[0] // tol), int(p[1] // tol))
        around = [q for a in (-1, 0, 1) for b in (-1, 0, 1) for q in grid.get((cell[0] + a, cell[1] + b), ())]
        if not any(all(abs(u - v) < tol for u, v in zip(p, q, strict=True)) for q in around):
            grid.setdefault(cell, []).append(p)
            kept.add(r[1])
    return kept


@pytest.mark.parametrize("edges, spread", [(2, 2000), (2, 90), (4, 300)])
def test_tiles_equal_the_fold(spark, edges, spread):
    rnd = random.Random(edges * spread)
    rows = [(1, i, rnd.uniform(-spread, spread), rnd.uniform(0, spread), rnd.uniform(0, 40), rnd.uniform(0, 40), "t")
            for i in range(3000)]
    rows += [(1, 5000 + i, *rows[7][2:]) for i in range(500)]  # exact copies
    df = spark.createDataFrame(rows, FIELDS).repartition(5)
    names = ["x0", "y0", "x1", "y1"][:edges]
    got = regions.dedupe_points(df, ["image_id"], "region_id", names, 12.0, small=10)
    assert {r["region_id"] for r in got.collect()} == fold(rows, 12.0, edges)


def test_one_cluster_of_a_hundred_thousand_points(spark):
    # A chain in reading order: whether a point stays depends on the one before it, over all tiles.
    rows = [(1, i, 5.0 * (i % 800), 7.0 * (i // 800), 0.0, 0.0, "t") for i in range(100_000)]
    df = spark.createDataFrame(rows, FIELDS).repartition(4)
    got = regions.dedupe_points(df, ["image_id"], "region_id", ["x0", "y0"], 6.0)
    assert {r["region_id"] for r in got.select("region_id").collect()} == fold(rows, 6.0, 2)


def test_null_keys_and_small_groups(spark):
    rows = [(None, 1, 0.0, 0.0, 0.0, 0.0, "a"), (None, 2, 1.0, 1.0, 0.0, 0.0, "b"), (1, 3, 1.0, 1.0, 0.0, 0.0, "c"),
            (1, 4, None, None, None, None, "d")]
    df = spark.createDataFrame(rows, FIELDS)
    for small in (0, 100):
        got = regions.dedupe_points(df, ["image_id"], "region_id", ["x0", "y0"], 6.0, small=small)
        assert {r["region_id"] for r in got.collect()} == {1, 3, 4}
    assert regions.dedupe_points(df.limit(0), ["image_id"], "region_id", ["x0", "y0"], 6.0).collect() == []


def test_large_images_are_placed_like_small_ones(spark):
    rnd = random.Random(9)
    rows = [(m, i, *(lambda x, y: (x, y, x + rnd.randrange(40), y + rnd.randrange(9)))(
        float(rnd.randrange(400)), float(rnd.randrange(3000))), "t") for m in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, FIELDS)
    key = lambda d: sorted((r["image_id"], r["region_id"], r["row"], r["col"]) for r in d.collect())
    assert key(tables.place_cells(df)) == key(tables.place_cells(df, small=10))


def test_a_table_needs_one_shuffle(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0, "t")], FIELDS).repartition(3)
    shape = tables.table_shape(tables.place_cells(df))
    plan = shape._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(image_id") == 1 and shape.count() == 1


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(")


def test_tables_in_one_pass_equal_the_steps(spark):
    rnd = random.Random(4)
    rows = [(m, i, *(lambda x, y: (x, y, x + rnd.randrange(9), y + rnd.randrange(9)))(
        float(rnd.randrange(12) * 10), float(rnd.randrange(30) * 10)), rnd.choice(["a", "b", None, "[HIDDEN]"]))
        for m in (None, *range(6)) for i in range(20 * (m or 1))]
    df = spark.createDataFrame(rows, FIELDS).repartition(3)
    rules = [Rule("colindex", "2"), Rule("row", "1"), Rule("lastrows", "2"), Rule("term", "b")]
    key = lambda d, *names: sorted((tuple(r[n] for n in names) for r in d.collect()), key=repr)
    for least, small in ((0.0, 10_000), (0.5, 50)):
        placed = tables.place_cells(df)
        grid = tables.rebuild_table(placed, tables.table_shape(placed), least=least)
        applied, boxes = tables.apply_rules_to_table(placed, grid, rules)
        got, cover = tables.cover_tables(df, rules, least=least, small=small)
        assert cover.columns == boxes.columns and key(cover, *cover.columns) == key(boxes, *boxes.columns)
        names = ("file_id", "row_idx", "cells", "hidden")
        assert key(got, *names) == key(applied, *names)


def test_boxes_are_dealt_out_once(spark):
    boxes = derived(spark, DATA, "boxes")
    assert boxes.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    _, cover = tables.cover_tables(boxes, [Rule("colindex", "2"), Rule("row", "1")])
    assert exchanges(cover) == 1 and exchanges(tables.rebuild_tables(boxes)) == 1
    assert exchanges(tables.table_shape(tables.place_cells(boxes))) == 1
    assert exchanges(regions.dedupe_regions(boxes)) == 1


def test_regions_without_a_position_stay(spark):
    rows = [(1, i, None, None, None, None, "t") for i in range(5)] + [(1, 9 + i, 1.0, 1.0, 2.0, 2.0, "t") for i in range(5)]
    df = spark.createDataFrame(rows, FIELDS)
    for small in (0, 3, 100):
        got = regions.dedupe_points(df, ["image_id"], "region_id", ["x0", "y0"], 12.0, small=small)
        assert sorted(r["region_id"] for r in got.collect()) == [0, 1, 2, 3, 4, 9]
