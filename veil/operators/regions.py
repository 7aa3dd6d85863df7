"""Text regions and boxes of pictures and screens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.boxes import cover_anchor, usable
from veil.functions.text import alnum_lower, strip
from veil.operators.blocks import ordered_text, part_of, running
from veil.session import cut


def clean_regions(regions: DataFrame) -> DataFrame:
    """Strip sequence marks, trim, drop empty regions."""
    text = strip(F.regexp_replace("text", "</?s>", ""))
    return regions.withColumn("text", text).filter(F.col("text") != "")


def drop_tiny(rects: DataFrame, side: float = 2.0) -> DataFrame:
    return rects.filter((F.col("width") >= side) & (F.col("height") >= side))


def usable_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes that are neither degenerate nor nearly the whole image (image_w, image_h)."""
    return boxes.filter(usable(F.col("box"), F.col("image_w") * F.col("image_h")))


#: Groups of up to so many rows are folded in one row; larger ones go by tiles, with the same result.
SMALL = 256


def split_by_size(rows: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of up to ``most`` rows, and those of larger groups (None where there are none)."""
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).drop("__n")
    if not large.limit(1).count():
        return rows, None
    held = cut(large)
    same = lambda how: rows.alias("r").join(held.alias("h"), [F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys], how)
    return same("left_anti").select("r.*"), same("left_semi").select("r.*")


def _fold_small(rows: DataFrame, keys: list[str], order: str, edges: list[str], tol: float) -> DataFrame:
    """The fold inside one row per group; the only shuffle is the one by key."""
    point = F.struct(F.col(order).alias("__o"), F.struct(*edges).cast(
        f"struct<{','.join(f'{e}:double' for e in edges)}>").alias("__e"), F.struct("*").alias("__r"))
    groups = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(point), lambda p, q: F.when(
        p["__o"] < q["__o"], -1).when(p["__o"] > q["__o"], 1).otherwise(0)).alias("__p"))
    none = F.array().cast(groups.schema["__p"].dataType)

    def step(kept: Column, p: Column) -> Column:
        def near(k: Column) -> Column:
            test = F.abs(k["__e"][edges[0]] - p["__e"][edges[0]]) < tol
            for e in edges[1:]:
                test = test & (F.abs(k["__e"][e] - p["__e"][e]) < tol)
            return test

        return F.when(F.exists(kept, near), kept).otherwise(F.concat(kept, F.array(p)))

    return groups.select(F.explode(F.aggregate("__p", none, step)).alias("__p")).select("__p.__r.*")


def _fold_tile(edges: list[str], tol: float):
    """One tile in the order of its points; what depends on a point that only another tile can decide waits."""
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("__o", kind="stable").reset_index(drop=True)
        at = tile[edges].to_numpy(dtype=float)
        cell = np.floor(at[:, :2] / tol).astype(np.int64).tolist()
        own, kept, out = tile["__own"].to_numpy(), tile["__kept"].to_numpy(), []
        # Per cell of width ``tol``: kept points (one at most in two dimensions) and undecided ones.
        sure: dict[tuple[int, int], list[int]] = {}
        open_: dict[tuple[int, int], list[int]] = {}

        def near(grid: dict, i: int) -> bool:
            x, y = cell[i]
            return any((np.abs(at[j] - at[i]) < tol).all() for a in (x - 1, x, x + 1) for b in (y - 1, y, y + 1)
                       for j in grid.get((a, b), ()))

        for i in range(len(tile)):
            if kept[i]:
                sure.setdefault(tuple(cell[i]), []).append(i)
            elif near(sure, i):
                continue  # dropped
            elif own[i] and not near(open_, i):
                kept[i] = True
                sure.setdefault(tuple(cell[i]), []).append(i)
            else:
                open_.setdefault(tuple(cell[i]), []).append(i)
            if own[i]:
                out.append(i)
        return tile.assign(__kept=kept).iloc[out].drop(columns=["__tx", "__ty", "__own"])

    return run


def _fold_tiles(rows: DataFrame, keys: list[str], order: str, edges: list[str], tol: float, cells: int = 64) -> DataFrame:
    """The fold for groups of any size: tiles of ``cells`` cells of width ``tol``, to a fixed point.

    Exact copies collapse first. A tile also sees the points within ``tol`` of its borders. In each round it keeps
    and drops what no undecided point of another tile can change; the earliest undecided point of all is
    always decided, and what is dropped leaves the table. Each round is written.
    """
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    group = list(names.values())
    points = (rows.groupBy(*[F.col(k).cast("string").alias(n) for k, n in names.items()],
                           *[F.col(e).cast("double").alias(e) for e in edges])
              .agg(F.min(F.col(order).cast("long")).alias("__o")).withColumn("__kept", F.lit(False)))
    points = cut(points)
    tile = lambda e, d: F.floor((F.col(e) + d) / (tol * cells)).cast("long")
    around = lambda e: F.array_distinct(F.array(tile(e, -tol), tile(e, 0), tile(e, tol)))
    while points.filter(~F.col("__kept")).limit(1).count():
        shared = (points.withColumn("__tx", F.explode(around(edges[0]))).withColumn("__ty", F.explode(around(edges[1])))
                  .withColumn("__own", (F.col("__tx") == tile(edges[0], 0)) & (F.col("__ty") == tile(edges[1], 0))))
        points = cut(shared.groupBy(*group, "__tx", "__ty").applyInPandas(_fold_tile(edges, tol), points.schema))
    wanted = points.select(*group, "__o")
    on = [F.col(k).cast("string").eqNullSafe(F.col(n)) for k, n in names.items()]
    return rows.join(wanted, [*on, F.col(order).cast("long") == F.col("__o")], "left_semi")


def dedupe_points(rows: DataFrame, keys: list[str], order: str, edges: list[str],
                  tol: float, small: int = SMALL) -> DataFrame:
    """Drop a row if a row **kept** before it lies within ``tol`` on every edge.

    ``order`` is a whole number, unique in a group. The fold depends on it, but only between neighbours: groups of
    up to ``small`` rows are folded in place, larger ones by tiles over many tasks. Rows without a position are
    always kept.
    """
    less, more = split_by_size(rows, keys, small)
    # In the fold a row without a position is near to none.
    out = _fold_small(less, keys, order, edges, tol)
    if more is None:
        return out
    located = F.col(edges[0]).isNotNull()
    return out.unionByName(_fold_tiles(more.filter(located), keys, order, edges, tol)).unionByName(more.filter(~located))


def dedupe_rects(findings: DataFrame, page: str = "page_id", order: str = "ord") -> DataFrame:
    """Near-duplicate findings of a page: same spot within 6 px in left and top."""
    return dedupe_points(findings, [page], order, ["left_px", "top_px"], 6.0)


def dedupe_regions(regions: DataFrame, image: str = "image_id", order: str = "region_id") -> DataFrame:
    """The same text read twice by overlapping tiles: box origins within 12 px."""
    return dedupe_points(regions, [image, "text"], order, ["x0", "y0"], 12.0)


def dedupe_boxes(boxes: DataFrame, image: str = "image_id", order: str = "region_id") -> DataFrame:
    """Boxes found twice: all four edges within 12 px."""
    return dedupe_points(boxes, [image], order, ["x0", "y0", "x1", "y1"], 12.0)


def region_offsets(regions: DataFrame, image: str = "image_id", order: str = "region_id",
                   width: int = 100_000, per_part: int = 10_000) -> DataFrame:
    """Place of each region in the texts of :func:`join_regions`: add ``part_no``, ``start`` and ``end``."""
    size = (F.length("text") + 1).cast("long")
    parts = regions.withColumn("part_no", part_of(order, per_part))
    out = running(parts, [image, "part_no"], order, size, "start", width=width)
    return (out.withColumn("start", F.coalesce("start", F.lit(0)))
            .withColumn("end", F.col("start") + F.length("text")))


def join_regions(regions: DataFrame, image: str = "image_id", order: str = "region_id",
                 per_part: int = 10_000) -> DataFrame:
    """One newline-ended text per picture and part."""
    lines = regions.select(image, order, F.concat("text", F.lit("\n")).alias("text"))
    return ordered_text(lines, [image], order, "text", "", per_part=per_part)


def spans_to_regions(spans: DataFrame, regions: DataFrame, image: str = "image_id",
                     bucket: int = 256) -> DataFrame:
    """Every region a span touches. Offsets are those of one part if both sides have a ``part_no``.

    Both sides are cut into offset buckets, so the join key is (picture, bucket) and a picture
    with many regions is spread over many tasks; a pair is emitted in its first common bucket only.
    """
    if ("part_no" in spans.columns) != ("part_no" in regions.columns):
        raise ValueError("only one side has a part_no: its offsets are those of a part")
    keys = [image, "part_no"] if "part_no" in spans.columns else [image]

    def bucketed(df: DataFrame) -> DataFrame:
        lo, hi = F.floor(F.col("start") / bucket), F.floor(F.greatest(
            F.col("end") - 1, F.col("start")) / bucket)
        return df.withColumn("__lo", lo).withColumn("__b", F.explode(F.sequence(lo, hi)))

    s = bucketed(spans).select(*keys, "__b", F.col("__lo").alias("__slo"), F.col("start").alias("span_start"),
                          F.col("end").alias("span_end"),
                          *[c for c in spans.columns if c not in (*keys, "start", "end")])
    r = bucketed(regions)
    touch = (F.col("span_start") < F.col("end")) & (F.col("span_end") > F.col("start"))
    return (s.join(r, [*keys, "__b"]).filter(touch & (
        F.col("__b") == F.greatest("__slo", "__lo"))).drop("__b", "__slo", "__lo"))


def map_boxes(boxes: DataFrame, frames: DataFrame, image: str = "image_id") -> DataFrame:
    """Boxes in page space: picture pixels are scaled into the picture's place on the page,
    screenshot pixels divided by the pixel ratio and moved by what was scrolled since."""
    b = boxes.join(frames, image)
    sx = F.col("rect_width") / F.coalesce(F.nullif("natural_width", F.lit(0)), "rect_width")
    sy = F.col("rect_height") / F.coalesce(F.nullif("natural_height", F.lit(0)), "rect_height")
    pic, dpr = F.col("space") == "image", F.coalesce(F.nullif("dpr", F.lit(0)), F.lit(1.0))
    pick = lambda a, c: F.when(pic, a).otherwise(c)
    return b.select(*boxes.columns, "space",
                    pick(F.col("rect_left") + F.col("x0") * sx, F.col("x0") / dpr + F.col("scroll_dx")).alias("left"),
                    pick(F.col("rect_top") + F.col("y0") * sy, F.col("y0") / dpr + F.col("scroll_dy")).alias("top"),
                    pick((F.col("x1") - F.col("x0")) * sx, (F.col("x1") - F.col("x0")) / dpr).alias("width"),
                    pick((F.col("y1") - F.col("y0")) * sy, (F.col("y1") - F.col("y0")) / dpr).alias("height"))


def anchor_boxes(regions: DataFrame, qualifiers: list[str]) -> DataFrame:
    """Covers for regions that read as a rule's qualifier, up to two typos.

    Qualifiers are settings, so each is one test on the row: no join.
    """
    want = {}
    for q in qualifiers:
        word = "".join(ch for ch in q.lower() if ch.isascii() and ch.isalnum())
        if len(word) >= 3:
            want[q] = (word, 2 if len(word) >= 6 else 1)
    got = alnum_lower(F.col("text"))
    hits = [F.when((got != "") & (F.levenshtein(got, F.lit(w), cap) >= 0), F.lit(q))
            for q, (w, cap) in want.items()]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return regions.select("*", F.explode(found).alias("qualifier")).withColumn(
        "box", cover_anchor(F.array("x0", "y0", "x1", "y1")))


def first_success(results: DataFrame, keys: tuple[str, ...] = ("image_id", "target")) -> DataFrame:
    """Results of the first wording that found anything; later wordings are ignored."""
    best = results.groupBy(*keys).agg(F.min("priority").alias("priority"))
    return results.join(best, [*keys, "priority"], "left_semi")


def covered_note(boxes: DataFrame, image: str = "image_id") -> DataFrame:
    """`COVERED IN THE PICTURE: …`, placeholders sorted."""
    names = boxes.groupBy(image).agg(F.array_sort(F.collect_set("ph")).alias("p"))
    return names.select(image, F.concat(F.lit("\nCOVERED IN THE PICTURE: "),
                                        F.array_join("p", ", ")).alias("note"))
