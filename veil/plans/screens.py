"""Queries over grids, boxes, page elements, web pages and document pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions.boxes import loc_boxes, overlaps, quad_to_box, shift_box, tile_grid
from veil.functions.urls import page_url
from veil.operators import elements as el
from veil.operators import grid, pages, regions, tables
from veil.operators.rules import Rule
from veil.plans import duck
from veil.plans.registry import query
from veil.plans.tables import derived, table, with_derived
from veil.sources import files

G, B, E = with_derived("grid"), with_derived("boxes"), with_derived("elements")


def rows(spark, sf):
    return derived(spark, sf, "grid").select("file_id", "row_idx", F.array("c0", "c1", "c2", "c3").alias("cells"))


def flat(df):
    return df.select("file_id", "row_idx", F.array_join("cells", "|").alias("line"))


def hide(*cells: str) -> str:
    """SQL of a row with some of its cells hidden: pairs of cell and condition."""
    return " || '|' || ".join(f"CASE WHEN row_idx > 0 AND ({c}) THEN '[HIDDEN]' ELSE c{i} END" for i, c in enumerate(cells))


@query("r1_hide_columns", f"{G} SELECT file_id, row_idx, {hide('false', 'false', 'true', 'true')} AS line FROM grid")
def _(spark, sf):
    return flat(grid.apply_grid_rules(rows(spark, sf), [Rule("colname", "money"), Rule("colname", "phone")]))


@query("r2_hide_column_index", f"{G} SELECT file_id, row_idx, {hide('false', 'true', 'false', 'false')} AS line FROM grid")
def _(spark, sf):
    return flat(grid.apply_grid_rules(rows(spark, sf), [Rule("colindex", "2")]))


RN = "row_number() OVER (PARTITION BY file_id ORDER BY row_idx) - 1"


def by_row(test: str) -> str:
    return (f"{G} SELECT file_id, row_idx, {hide(test, test, test, test)} AS line FROM (SELECT *, {RN} AS rn, "
            "count(*) OVER (PARTITION BY file_id) - 1 AS n FROM grid)")


@query("r3_hide_rows", by_row("rn BETWEEN 2 AND 5 OR rn = 9"))
def _(spark, sf):
    return flat(grid.apply_grid_rules(rows(spark, sf), [Rule("rowset", "2-5"), Rule("row", "9")]))


@query("r4_hide_edge_rows", by_row("rn <= 2 OR rn > n - 3"))
def _(spark, sf):
    return flat(grid.apply_grid_rules(rows(spark, sf), [Rule("firstrows", "2"), Rule("lastrows", "3")]))


@query("r5_hide_terms", f"{G} SELECT file_id, row_idx, c0 || '|' || CASE WHEN contains(lower(c1), 'machin') THEN '[HIDDEN]' ELSE c1 END "
       "|| '|' || c2 || '|' || c3 AS line FROM grid")
def _(spark, sf):
    return flat(grid.apply_grid_rules(rows(spark, sf), [Rule("term", "Machin")]))


@query("r6_hidden_counts", f"{G} SELECT file_id, CAST(sum(CASE WHEN row_idx = 0 THEN 0 WHEN rn = 1 THEN 4 ELSE 1 END) AS BIGINT) AS count "
       f"FROM (SELECT *, {RN} AS rn FROM grid) GROUP BY file_id")
def _(spark, sf):
    return grid.hidden_counts(grid.apply_grid_rules(rows(spark, sf), [Rule("colname", "Amuont"), Rule("row", "1")]))


@query("c7_resolve_columns", f"{G} SELECT file_id, '0,2,3' AS hidden FROM grid WHERE row_idx = 0")
def _(spark, sf):
    wanted = [Rule("colname", "salary"), Rule("colname", "phone"), Rule("colname", "custmer")]
    found = grid.resolve_columns(rows(spark, sf), wanted)
    return found.select("file_id", F.array_join(F.transform("hidden_cols", lambda i: i.cast("string")), ",").alias("hidden"))


SHEETS = with_derived("sheets")


def capped(spark, sf):
    cells = derived(spark, sf, "sheets").select("file_id", "sheet", "row_idx", F.array("c0", "c1", "c2").alias("cells"))
    return grid.cap_sheet(cells, n=500)


@query("a3_cap_sheet", f"{SHEETS} SELECT file_id, sheet, row_idx, total, c0 || '|' || coalesce(c1, '') || '|' || c2 AS line FROM (SELECT *, "
       "row_number() OVER w AS rn, count(*) OVER (PARTITION BY file_id, sheet) AS total FROM sheets WINDOW w AS "
       "(PARTITION BY file_id, sheet ORDER BY row_idx)) WHERE rn <= 500")
def _(spark, sf):
    return capped(spark, sf).select("file_id", "sheet", "row_idx", "total", F.array_join("cells", "|").alias("line"))


@query("a4_grid_to_text", f"""{SHEETS}, s AS (SELECT file_id, sheet, '--- sheet: ' || sheet || ' (' || max(total) || ' rows) ---' || chr(10)
    || string_agg(c0 || ' | ' || coalesce(c1, '') || ' | ' || c2, chr(10) ORDER BY row_idx) AS t FROM (SELECT *, row_number() OVER w AS rn,
    count(*) OVER (PARTITION BY file_id, sheet) AS total FROM sheets WINDOW w AS (PARTITION BY file_id, sheet ORDER BY row_idx))
    WHERE rn <= 500 GROUP BY file_id, sheet)
  SELECT file_id, CAST(0 AS INT) AS part_no, string_agg(t, chr(10) || chr(10) ORDER BY sheet) AS text FROM s GROUP BY file_id""")
def _(spark, sf):
    return grid.grid_to_text(capped(spark, sf))


def pdf(spark, sf):
    return derived(spark, sf, "pdf").select("file_id", "page_no", F.split("words", " ").alias("items"))


PDF = with_derived("pdf") + r", p AS (SELECT file_id, page_no, trim(regexp_replace(words, '\s+', ' ', 'g')) AS t FROM pdf)"


@query("a5_assemble_pages", f"{PDF} SELECT file_id, CAST(0 AS INT) AS part_no, string_agg('--- page ' || page_no || ' ---' || chr(10) || t, "
       "chr(10) || chr(10) ORDER BY page_no) AS text FROM p GROUP BY file_id")
def _(spark, sf):
    return files.assemble_pages(pdf(spark, sf))


@query("a6_flag_scanned", f"{PDF}, f AS (SELECT file_id FROM p GROUP BY file_id HAVING sum(length(t)) < 24 * count(*)) "
       "SELECT file_id, page_no FROM p JOIN f USING (file_id) WHERE page_no <= 6")
def _(spark, sf):
    p = pdf(spark, sf)
    return files.pages_to_read(p, files.flag_scanned(p), max_pages=6).select("file_id", "page_no")


SHOWN = "display <> 'none' AND visibility <> 'hidden' AND opacity <> 0 AND width <> 0 AND height <> 0 AND top_px + height > 0 AND top_px < 300"


@query("b1_visible", f"{E} SELECT page_id, el_id FROM elements WHERE {SHOWN}")
def _(spark, sf):
    return el.visible(derived(spark, sf, "elements"), height=300.0).select("page_id", "el_id")


@query("b2_field_label", f"{E} SELECT page_id, el_id, coalesce(nullif(aria_label, ''), nullif(placeholder, ''), nullif(name, ''), "
       "nullif(type, ''), 'field') AS label FROM elements")
def _(spark, sf):
    none = F.lit(None).cast("string")
    label = el.field_label(aria=F.col("aria_label"), label_for=none, wrapping=none, placeholder=F.col("placeholder"),
                           name=F.col("name"), type_=F.col("type"))
    return derived(spark, sf, "elements").select("page_id", "el_id", label.alias("label"))


@query("b3_classify_fields", f"{E} SELECT page_id, el_id, CASE WHEN type = 'password' THEN '[PASSWORD]' WHEN autocomplete LIKE 'cc-%' "
       "THEN '[SENSITIVE]' END AS ph, CASE WHEN type <> 'password' AND autocomplete NOT LIKE 'cc-%' THEN value END AS value FROM elements")
def _(spark, sf):
    return el.classify_fields(derived(spark, sf, "elements")).select("page_id", "el_id", "ph", "value")


SCANNED = """CASE WHEN type = 'password' THEN '[PASSWORD]' WHEN autocomplete LIKE 'cc-%' THEN '[SENSITIVE]'
  WHEN value LIKE '%@%' THEN '[EMAIL]' WHEN value = '' THEN '(empty)' ELSE substr(value, 1, 80) END"""


@query("b4_scan_fields", f"{E} SELECT page_id, el_id, {SCANNED} AS shown, type = 'password' OR autocomplete LIKE 'cc-%' "
       "OR value LIKE '%@%' AS masked FROM elements")
def _(spark, sf):
    return el.scan_fields(el.classify_fields(derived(spark, sf, "elements"))).select("page_id", "el_id", "shown", "masked")


@query("g26_field_cuts", f"{E} SELECT page_id, string_agg({SCANNED}, ' / ' ORDER BY el_id) AS shown FROM elements GROUP BY page_id")
def _(spark, sf):
    fields = el.scan_fields(el.classify_fields(derived(spark, sf, "elements")))
    got = fields.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("el_id", "shown"))).alias("f"))
    return got.select("page_id", F.array_join("f.shown", " / ").alias("shown"))


def boxes(spark, sf):
    return derived(spark, sf, "boxes")


RECTS = "SELECT image_id, region_id, x0 AS left_px, y0 AS top_px, CASE WHEN region_id % 5 = 0 THEN 1.0 ELSE x1 - x0 END AS width, y1 - y0 AS height FROM boxes"


@query("b8_drop_tiny", f"{B} SELECT image_id, region_id FROM ({RECTS}) WHERE width >= 2 AND height >= 2")
def _(spark, sf):
    rects = spark.sql(RECTS.replace("FROM boxes", "FROM {boxes}"), boxes=boxes(spark, sf))
    return regions.drop_tiny(rects).select("image_id", "region_id")


@query("b9_usable_boxes", f"{B} SELECT image_id, region_id FROM boxes WHERE (CASE WHEN region_id % 3 = 0 THEN 960.0 ELSE x1 END) - x0 > 0 AND "
       "((CASE WHEN region_id % 3 = 0 THEN 960.0 ELSE x1 END) - x0) * (y1 - y0) < 0.85 * 900.0 * 26.0")
def _(spark, sf):
    b = boxes(spark, sf).withColumn("box", F.array("x0", "y0", F.when(F.col("region_id") % 3 == 0, 960.0).otherwise(F.col("x1")), "y1"))
    return regions.usable_boxes(b.withColumn("image_w", F.lit(900.0)).withColumn("image_h", F.lit(26.0))).select("image_id", "region_id")


@query("b10_clean_regions", f"{B} SELECT image_id, region_id, text FROM boxes WHERE region_id % 4 <> 1")
def _(spark, sf):
    raw = boxes(spark, sf).withColumn("text", F.when(F.col("region_id") % 4 == 1, "</s> ").otherwise(
        F.concat(F.lit("<s> "), "text", F.lit(" </s>"))))
    return regions.clean_regions(raw).select("image_id", "region_id", "text")


JOINED = f"""{B}, j AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY image_id ORDER BY region_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM boxes)"""


@query("e12_region_offsets", f"{JOINED} SELECT image_id, region_id, s AS start, s + length(text) AS \"end\" FROM j")
def _(spark, sf):
    return regions.region_offsets(boxes(spark, sf)).select("image_id", "region_id", "start", "end")


@query("e12_join_regions", f"{B} SELECT image_id, CAST(0 AS INT) AS part_no, string_agg(text || chr(10), '' ORDER BY region_id) AS text FROM boxes GROUP BY image_id")
def _(spark, sf):
    return regions.join_regions(boxes(spark, sf))


@query("c2_spans_to_regions", f"""{JOINED}, sp AS (SELECT image_id, s + 1 AS a, s + length(text) + 3 AS b FROM j WHERE region_id % 4 = 0)
  , r AS MATERIALIZED (SELECT image_id, region_id, s, length(text) AS n FROM j),
  p AS MATERIALIZED (SELECT image_id, region_id, a, b, s, n FROM sp JOIN r USING (image_id))
  SELECT image_id, region_id, a AS span_start FROM p WHERE a < s + n AND b > s""")
def _(spark, sf):
    placed = regions.region_offsets(boxes(spark, sf)).select("image_id", "part_no", "region_id", "start", "end")
    spans = placed.filter("region_id % 4 = 0").select("image_id", "part_no", (F.col("start") + 1).alias("start"), (F.col("end") + 3).alias("end"))
    return regions.spans_to_regions(spans, placed).select("image_id", "region_id", "span_start")


FRAMES = """SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 2 = 0 THEN 'image' ELSE 'device' END AS space,
  CAST(10 AS DOUBLE) AS rect_left, CAST(20 AS DOUBLE) AS rect_top, CAST(400 AS DOUBLE) AS rect_width, CAST(300 AS DOUBLE) AS rect_height,
  CAST(800 AS DOUBLE) AS natural_width, CAST(600 AS DOUBLE) AS natural_height, CAST(2 AS DOUBLE) AS dpr,
  CAST(0 AS DOUBLE) AS scroll_dx, CAST(o_orderkey % 50 AS DOUBLE) AS scroll_dy FROM {orders}"""


@query("c3_map_boxes", f"""{B} SELECT image_id, region_id, CASE WHEN image_id % 2 = 0 THEN 10 + x0 * 0.5 ELSE x0 / 2 END AS left,
  CASE WHEN image_id % 2 = 0 THEN 20 + y0 * 0.5 ELSE y0 / 2 + image_id % 50 END AS top, (x1 - x0) / 2 AS width, (y1 - y0) / 2 AS height
  FROM boxes JOIN orders ON image_id = o_orderkey""")
def _(spark, sf):
    from veil.plans.tables import derive

    placed = regions.map_boxes(boxes(spark, sf), derive(spark, sf, FRAMES, "orders"))
    return placed.select("image_id", "region_id", "left", "top", "width", "height")


@query("c4_anchor_boxes", f"""{B}, w AS (SELECT image_id, region_id, x0, y0, x1, y1, CASE WHEN text = 'N' THEN 'AADHAR' WHEN text = 'O' THEN 'Aadhaar!' ELSE text END AS text FROM boxes)
  SELECT image_id, region_id, x0 - 9.6 AS left, greatest(0, y0 - (x1 - x0)) AS top, x1 + 9.6 AS "right", y1 + 9.6 AS bottom FROM w
  WHERE levenshtein(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 'aadhaar') <= 2""")
def _(spark, sf):
    marks = boxes(spark, sf).withColumn("text", F.when(F.col("text") == "N", "AADHAR").when(
        F.col("text") == "O", "Aadhaar!").otherwise(F.col("text")))
    b = F.col("box")
    return regions.anchor_boxes(marks, ["aadhaar"]).select("image_id", "region_id", b[0].alias("left"), b[1].alias("top"),
                                                           b[2].alias("right"), b[3].alias("bottom"))


@query("d4_covered_note", f"{B} SELECT image_id, chr(10) || 'COVERED IN THE PICTURE: ' || string_agg(DISTINCT '[' || upper(text) || ']', ', ' ORDER BY '[' || upper(text) || ']') AS note "
       "FROM boxes GROUP BY image_id")
def _(spark, sf):
    named = boxes(spark, sf).withColumn("ph", F.concat(F.lit("["), F.upper("text"), F.lit("]")))
    return regions.covered_note(named)


MEDIA = "SELECT image_id AS page_id, region_id AS el_id, (x1 - x0) * (1 + region_id % 5) AS width, (y1 - y0) * (10 + region_id % 25) AS height FROM boxes"


def media(spark, sf):
    return spark.sql(MEDIA.replace("FROM boxes", "FROM {boxes}"), boxes=boxes(spark, sf))


@query("d7_biggest_media", f"""{B} SELECT page_id, el_id, area, area > 1280.0 * 720.0 * 0.35 AS dominant FROM (SELECT page_id, el_id, width * height AS area,
  row_number() OVER (PARTITION BY page_id ORDER BY width * height DESC, el_id) AS rn FROM ({MEDIA}) WHERE width * height >= 40000) WHERE rn = 1""")
def _(spark, sf):
    return pages.biggest_media(media(spark, sf))


@query("f2_top_picture", f"{B} SELECT page_id, max(width * height) AS area FROM ({MEDIA}) WHERE width * height >= 40000 GROUP BY page_id")
def _(spark, sf):
    return pages.biggest_media(media(spark, sf)).select("page_id", "area")


@query("d8_first_success", f"""{B}, r AS (SELECT image_id, region_id % 2 AS target, region_id, CAST(x0 AS INT) % 7 AS priority FROM boxes)
  SELECT image_id, target, region_id, priority FROM r QUALIFY priority = min(priority) OVER (PARTITION BY image_id, target)""")
def _(spark, sf):
    found = boxes(spark, sf).selectExpr("image_id", "region_id % 2 AS target", "region_id", "CAST(x0 AS INT) % 7 AS priority")
    return regions.first_success(found)


def fold_sql(source: str, keys: str, order: str, edges: tuple[str, ...], tol: float) -> str:
    """Greedy removal of near duplicates, kept rows listed again."""
    cols = ", ".join(f"{e} := {e}" for e in (order, *edges))
    near = " AND ".join(f"abs(z.{e} - i.{e}) < {tol}" for e in edges)
    typed = f"[]::STRUCT({order} INTEGER, " + ", ".join(f"{e} DOUBLE" for e in edges) + ")[]"
    return (f"SELECT {keys}, unnest(k).{order} AS {order} FROM (SELECT {keys}, list_reduce(list(struct_pack({cols}) ORDER BY {order}), "
            f"lambda k, i: CASE WHEN len(list_filter(k, lambda z: {near})) > 0 THEN k ELSE list_append(k, i) END, {typed}) AS k "
            f"FROM ({source}) GROUP BY {keys})")


# Findings squeezed together so that neighbours collide: rows 8 px and columns 5 px apart.
NEAR = "SELECT image_id AS page_id, region_id AS ord, x0 % 45 AS left_px, y0 / 5 AS top_px FROM boxes"


@query("e6_dedupe_rects", f"{B} {fold_sql(NEAR, 'page_id', 'ord', ('left_px', 'top_px'), 6)}")
def _(spark, sf):
    near = spark.sql(NEAR.replace("FROM boxes", "FROM {boxes}"), boxes=boxes(spark, sf))
    return regions.dedupe_rects(near).select("page_id", "ord")


@query("e7_dedupe_regions", f"{B} {fold_sql('SELECT image_id, text, region_id, x0 % 30 AS x0, y0 / 4 AS y0 FROM boxes', 'image_id, text', 'region_id', ('x0', 'y0'), 12)}")
def _(spark, sf):
    near = boxes(spark, sf).select("image_id", "text", "region_id", (F.col("x0") % 30).alias("x0"), (F.col("y0") / 4).alias("y0"))
    return regions.dedupe_regions(near).select("image_id", "text", "region_id")


@query("e7_dedupe_boxes", f"{B} {fold_sql('SELECT image_id, region_id, x0 % 30 AS x0, y0 / 4 AS y0, x1 % 50 AS x1, y1 / 4 AS y1 FROM boxes', 'image_id', 'region_id', ('x0', 'y0', 'x1', 'y1'), 12)}")
def _(spark, sf):
    near = boxes(spark, sf).select("image_id", "region_id", (F.col("x0") % 30).alias("x0"), (F.col("y0") / 4).alias("y0"),
                                   (F.col("x1") % 50).alias("x1"), (F.col("y1") / 4).alias("y1"))
    return regions.dedupe_boxes(near).select("image_id", "region_id")


PLACED = f"""{B}, f AS (SELECT *,
    CASE WHEN y0 > coalesce(max(y1) OVER (PARTITION BY image_id ORDER BY y0, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS nr,
    CASE WHEN x0 > coalesce(max(x1) OVER (PARTITION BY image_id ORDER BY x0, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS nc FROM boxes),
  placed AS (SELECT *, CAST(sum(nr) OVER (PARTITION BY image_id ORDER BY y0, region_id) - 1 AS INT) AS row,
    CAST(sum(nc) OVER (PARTITION BY image_id ORDER BY x0, region_id) - 1 AS INT) AS col FROM f)"""


@query("e4_table_shape", f"""{PLACED}, c AS (SELECT image_id, row, col, count(*) AS n FROM placed GROUP BY ALL)
  SELECT image_id, CAST(max(col) + 1 AS INT) AS columns, CAST(max(row) + 1 AS INT) AS row_count,
    sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n) AS confidence FROM c GROUP BY image_id""")
def _(spark, sf):
    return tables.table_shape(tables.place_cells(boxes(spark, sf)))


@query("e4_rebuild_table", f"{PLACED} SELECT image_id AS file_id, row AS row_idx, string_agg(text, '|' ORDER BY col) AS line FROM placed GROUP BY ALL")
def _(spark, sf):
    return flat(tables.rebuild_tables(boxes(spark, sf)))


@query("r7_table_rules", f"{PLACED} SELECT image_id, region_id, '[HIDDEN]' AS ph FROM placed WHERE row > 0 AND (col = 1 OR row = 1)")
def _(spark, sf):
    _, cover = tables.cover_tables(boxes(spark, sf), [Rule("colindex", "2"), Rule("row", "1")])
    return cover.select("image_id", "region_id", "ph")


@query("f4_union_boxes", f"""{PLACED} SELECT layer, count(*) AS n FROM (SELECT 'rule' AS layer FROM placed WHERE row > 0 AND col = 1
  UNION ALL SELECT 'text' FROM boxes) GROUP BY layer""")
def _(spark, sf):
    _, cover = tables.cover_tables(boxes(spark, sf), [Rule("colindex", "2")])
    text = boxes(spark, sf).withColumn("layer", F.lit("text"))
    both = cover.withColumn("layer", F.lit("rule")).unionByName(text, allowMissingColumns=True)
    return both.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query("g20_box_math", f"""{B} SELECT image_id, region_id, x0 + 100 AS left, y0 + 50 AS top, (x1 - x0) * (y1 - y0) AS area,
  x0 < 300 AND 250 < x1 AND y0 < 90 AND 40 < y1 AS hit, round((region_id % 1000 + 0.5) / 1000 * 640, 6) AS loc_x FROM boxes""")
def _(spark, sf):
    quad = F.array("x1", "y0", "x1", "y1", "x0", "y1", "x0", "y0")
    box = quad_to_box(quad)
    moved = shift_box(box, F.lit(100.0), F.lit(50.0))
    loc = F.concat(F.lit("seal"), F.repeat(F.concat(F.lit("<loc_"), F.col("region_id") % 1000, F.lit(">")), F.lit(4)), F.lit("</s>"))
    return boxes(spark, sf).select(
        "image_id", "region_id", moved[0].alias("left"), moved[1].alias("top"), ((box[2] - box[0]) * (box[3] - box[1])).alias("area"),
        overlaps(box, F.array(*[F.lit(float(v)) for v in (250, 40, 300, 90)])).alias("hit"),
        F.round(loc_boxes(loc, F.lit(640.0), F.lit(480.0))[0]["box"][0], 6).alias("loc_x"))


SIZES = "SELECT o_orderkey, CAST(200 + o_custkey % 3000 AS DOUBLE) AS w, CAST(100 + o_orderkey % 2500 AS DOUBLE) AS h FROM orders"


@query("g21_tile_grid", f"""WITH s AS (SELECT *, least(3, greatest(1, ceil(w / 820))) AS nc, least(3, greatest(1, ceil(h / 820))) AS nr FROM ({SIZES}))
  SELECT o_orderkey, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(c * w / nc, 4) AS x0, round(r * h / nr, 4) AS y0 FROM s
  CROSS JOIN range(3) a(r) CROSS JOIN range(3) b(c) WHERE r < nr AND c < nc""")
def _(spark, sf):
    sizes = spark.sql(SIZES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))
    return sizes.select("o_orderkey", F.inline(tile_grid(F.col("w"), F.col("h")))).select(
        "o_orderkey", "r", "c", F.round("x0", 4).alias("x0"), F.round("y0", 4).alias("y0"))


# Pages in the checking dialect.
NODES = r"""WITH b AS (SELECT page_id, url, regexp_replace(html, '(?s)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'g') AS h FROM pages),
  b2 AS (SELECT *, regexp_replace(h, '(?s)<head[^>]*>.*?</head>', '', 'g') AS body FROM b)"""


# The character references that the given pages hold; the ampersand goes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def plain(c: str) -> str:
    for entity, char in ENTITIES:
        c = f"replace({c}, {duck.q(entity)}, {duck.q(char)})"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def inner(pattern: str) -> str:
    body = plain("regexp_replace(x, '<[^>]*>', '', 'g')")
    return f"list_transform(regexp_extract_all(body, '{pattern}', 1), lambda x: {body})"


PARTS = f"""{NODES}, parts AS (SELECT page_id, url, {plain("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
  list_filter({inner('(?is)<h[1-3][^>]*>(.*?)</h[1-3]>')}, lambda x: x <> '') AS headings,
  {inner('(?is)<(?:a [^>]*href|button)[^>]*>(.*?)</(?:a|button)>')} AS actions,
  list_filter(list_transform(string_split_regex(body, '<[^>]*>'), lambda x: {plain('x')}), lambda x: x <> '') AS nodes FROM b2)"""


@query("a8_scan_pages", f"""{PARTS} SELECT page_id, title, array_to_string(headings, '|') AS headings, array_to_string(actions, '|') AS actions,
  CAST(len(nodes) AS INT) AS n_nodes, CAST(list_sum(list_transform(nodes, lambda x: length(x))) AS BIGINT) AS chars FROM parts""")
def _(spark, sf):
    scanned = pages.scan_pages(table(spark, sf, "pages"))
    chars = F.aggregate("nodes", F.lit(0).cast("long"), lambda a, t: a + F.length(t))
    return scanned.select("page_id", "title", F.array_join("headings", "|").alias("headings"),
                          F.array_join("actions", "|").alias("actions"), F.size("nodes").alias("n_nodes"), chars.alias("chars"))


@query("a9_reject_internal_urls", "SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^(chrome|edge|about|chrome-extension|devtools):')")
def _(spark, sf):
    return pages.reject_internal_urls(table(spark, sf, "pages"))[0].select("page_id", "url")


PAGE_URL = r"regexp_replace(url, '[?#].*$', '')"


@query("g13_page_url", f"SELECT page_id, {PAGE_URL} AS url FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", page_url(F.col("url")).alias("url"))


def outline_sql(nodes: str) -> str:
    return (f"array_to_string((list_reduce(list_filter({nodes}, lambda x: length(x) >= 2), lambda z, x: CASE WHEN z.n > 1800 THEN z ELSE "
            "{'n': CAST(z.n + length(x) AS BIGINT), 'o': list_append(z.o, x)} END, {'n': CAST(0 AS BIGINT), 'o': []::VARCHAR[]})).o, ' | ')")


@query("e2_outline", f"{PARTS} SELECT page_id, {outline_sql('nodes')} AS text FROM parts")
def _(spark, sf):
    return pages.scan_pages(table(spark, sf, "pages")).select("page_id", pages.outline(F.col("nodes"), limit=1800).alias("text"))


REDACTED = f"""{PARTS}, src AS (SELECT page_id, array_to_string(nodes, chr(10)) AS text FROM parts),
  hsrc AS (SELECT page_id, array_to_string(headings[1:12], chr(10)) AS text FROM parts),
  ni AS ({duck.items('src', 'page_id', accounts=False)}), nk AS ({duck.kept('ni', 'page_id')}),
  hi AS ({duck.items('hsrc', 'page_id', accounts=False)}), hk AS ({duck.kept('hi', 'page_id')}),
  ctx AS (SELECT p.page_id, {PAGE_URL} AS url, title, coalesce({duck.rebuilt('hsrc.text', 'hk.k')}, hsrc.text) AS headings,
    list_reduce(list_filter(actions, lambda x: x <> '' AND length(x) < 60), lambda a, x: CASE WHEN list_contains(a, x) THEN a ELSE list_append(a, x) END, []::VARCHAR[])[1:25] AS actions,
    {outline_sql(f"string_split(coalesce({duck.rebuilt('src.text', 'nk.k')}, src.text), chr(10))")} AS text
    FROM parts p JOIN src USING (page_id) JOIN hsrc USING (page_id) LEFT JOIN nk USING (page_id) LEFT JOIN hk USING (page_id))"""


def context(spark, sf):
    return pages.page_context(pages.scan_pages(table(spark, sf, "pages")), headings=12, actions=25, limit=1800)


@query("b5_page_context", f"{REDACTED} SELECT page_id, url, title, headings, array_to_string(actions, '|') AS actions, text FROM ctx")
def _(spark, sf):
    return context(spark, sf).select("page_id", "url", "title", F.array_join("headings", "\n").alias("headings"),
                                     F.array_join("actions", "|").alias("actions"), "text")


@query("b6_context_text", f"""{REDACTED} SELECT page_id, 'PAGE: ' || title || chr(10) || 'URL: ' || url || CASE WHEN headings <> '' THEN chr(10)
  || 'HEADINGS: ' || replace(headings, chr(10), ' / ') ELSE '' END || CASE WHEN len(actions) > 0 THEN chr(10) || 'CONTROLS: '
  || array_to_string(actions, ' | ') ELSE '' END || CASE WHEN text <> '' THEN chr(10) || 'VISIBLE TEXT: ' || text ELSE '' END AS context FROM ctx""")
def _(spark, sf):
    ctx = context(spark, sf)
    return ctx.select("page_id", pages.context_text(ctx).alias("context"))


@query("b11_needs_ocr", f"""{PARTS} SELECT page_id, length(regexp_replace({outline_sql('nodes')}, '\\s+', '', 'g')) < 120
  OR page_id % 10 = 0 AS needs_ocr FROM parts""")
def _(spark, sf):
    scanned = pages.scan_pages(table(spark, sf, "pages"))
    ctx = scanned.select("page_id", pages.outline(F.col("nodes"), limit=1800).alias("text"), (F.col("page_id") % 10 == 0).alias("dominant"))
    return pages.needs_ocr(ctx, dominant="dominant").select("page_id", "needs_ocr")
