"""Box arithmetic. A box is ``array<double>`` of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quad_to_box(quad: Column) -> Column:
    """Eight numbers x,y,x,y,… to the enclosing box."""
    xs = F.filter(quad, lambda v, i: i % 2 == 0)
    ys = F.filter(quad, lambda v, i: i % 2 == 1)
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def shift_box(box: Column, dx: Column, dy: Column) -> Column:
    """A box of a tile in the coordinates of the whole image."""
    return F.array(box[0] + dx, box[1] + dy, box[2] + dx, box[3] + dy)


def area(box: Column) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def overlaps(a: Column, b: Column) -> Column:
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def cover_anchor(box: Column) -> Column:
    """A printed name with the emblem above it: grown up by its own width and padded."""
    pad = F.greatest(F.lit(4.0), (box[3] - box[1]) * 0.4)
    return F.array(box[0] - pad, F.greatest(F.lit(0.0), box[1] - (box[2] - box[0])),
                   box[2] + pad, box[3] + pad)


def usable(box: Column, image_area: Column) -> Column:
    """Not degenerate and not nearly the whole picture."""
    return (box[2] > box[0]) & (box[3] > box[1]) & (area(box) < F.lit(0.85) * image_area)


def loc_boxes(text: Column, width: Column, height: Column) -> Column:
    """`label<loc_a><loc_b><loc_c><loc_d>…` to ``array<struct<label,box>>``.

    Locations are thousandths of the image side, read at the middle of their bin. A box without
    its own label takes the one before it.
    """
    clean = F.regexp_replace(text, "</?s>|<pad>", "")
    piece = r"([^<]*)((?:<loc_[0-9]+>){4})"
    labels = F.transform(F.regexp_extract_all(clean, F.lit(piece), F.lit(1)), lambda s: F.trim(s))
    locs = F.regexp_extract_all(clean, F.lit(piece), F.lit(2))
    side = lambda k: F.when(k % 2 == 0, width).otherwise(height)

    def box(s: Column) -> Column:
        return F.transform(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)),
                           lambda v, k: (v.cast("double") + 0.5) / 1000 * side(k))

    filled = F.aggregate(labels, F.array().cast("array<string>"), lambda acc, v: F.concat(
        acc, F.array(F.coalesce(F.nullif(v, F.lit("")), F.try_element_at(acc, F.lit(-1)),
                                F.lit("")))))
    return F.zip_with(filled, locs, lambda v, s: F.struct(v.alias("label"), box(s).alias("box")))


def tile_grid(width: Column, height: Column, side: int = 820, most: int = 3) -> Column:
    """Tiles of an image, row by row: ``array<struct<r,c,x0,y0,w,h>>``; at most most x most."""
    n = lambda s: F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(s / side).cast("int")))
    cols, rows = n(width), n(height)
    w, h = width / cols, height / rows
    return F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(
        F.sequence(F.lit(0), cols - 1), lambda c: F.struct(
            r.alias("r"), c.alias("c"), (c * w).alias("x0"), (r * h).alias("y0"),
            w.alias("w"), h.alias("h")))))
