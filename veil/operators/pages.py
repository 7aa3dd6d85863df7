"""Web pages: scan of the HTML, the outline, and the context that describes a page.

Everything about a page comes from its own row, so no step shuffles.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.text import collapse_ws
from veil.functions.urls import is_internal, page_url
from veil.operators.gate import redact_text

UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|\z)"
HEAD = r"(?is)<head[^>]*>.*?</head>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HEADING = r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"
ACTION = r"(?is)<(?:a [^>]*href|button)[^>]*>(.*?)</(?:a|button)>"
TAG = "<[^>]*>"

ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def unescape(c: Column) -> Column:
    """Character references to characters, each once (``&amp;lt;`` is ``&lt;``); unknown ones stay. A
    no-break space is a space."""
    named = F.create_map(*[F.lit(x) for n, k in name2codepoint.items() for x in (n, k)])

    def char(e: Column) -> Column:
        body = F.substring(e, 2, 33)
        number = F.when(body.rlike("^#[xX]"), F.conv(F.regexp_extract(body, "([0-9a-fA-F]+);", 1), 16, 10).cast("int")).when(
            body.startswith("#"), F.regexp_extract(body, "#([0-9]+)", 1).cast("int")).when(
            body == "apos;", 39).otherwise(F.try_element_at(named, F.substring_index(body, ";", 1)))
        known = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        made = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(number == 160, " ").when(known, made).otherwise(e)

    found = F.transform(F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0)), char)
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.zip_with(
        F.split(c, ENTITY, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(c)


def _inner_texts(c: Column, pattern: str) -> Column:
    plain = lambda s: collapse_ws(unescape(F.regexp_replace(s, TAG, "")))
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), plain)


def scan_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``title``, ``headings``, ``actions`` and ``nodes`` (visible text nodes of the body)."""
    out = pages.withColumn("__h", F.regexp_replace(html, UNSEEN, "")).withColumn(
        "__b", F.regexp_replace("__h", HEAD, ""))
    nodes = F.transform(F.split("__b", TAG), lambda n: collapse_ws(unescape(n)))
    title = F.regexp_extract("__h", TITLE, 1)
    return (out.withColumn("title", collapse_ws(unescape(title)))
            .withColumn("headings", F.filter(_inner_texts(F.col("__b"), HEADING), lambda t: t != ""))
            .withColumn("actions", _inner_texts(F.col("__b"), ACTION))
            .withColumn("nodes", F.filter(nodes, lambda t: t != ""))
            .drop("__h", "__b", html))


def reject_internal_urls(pages: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Ordinary pages, and the browser-internal ones that are refused."""
    return pages.filter(~is_internal(F.col(url))), pages.filter(is_internal(F.col(url)))


def outline(nodes: Column, limit: int | None = None) -> Column:
    """Text nodes, all or until the running length exceeds ``limit``; the crossing node is kept."""
    nodes = F.filter(nodes, lambda t: F.length(t) >= 2)
    if limit is None:
        return F.array_join(nodes, " | ")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    step = lambda z, t: F.when(z["n"] > limit, z).otherwise(F.struct(
        (z["n"] + F.length(t)).alias("n"), F.concat(z["out"], F.array(t)).alias("out")))
    kept = F.aggregate(nodes, start, step, lambda z: z["out"])
    return F.array_join(kept, " | ")


def page_context(scanned: DataFrame, url: str = "url", *, headings: int | None = None,
                 actions: int | None = None, limit: int | None = None) -> DataFrame:
    """URL without query, title, redacted headings, actions, redacted outline: whole, or cut to the numbers given.

    Nodes are redacted as one text, a line each: no core pattern crosses a line.
    """
    first = lambda c, n: c if n is None else F.slice(c, 1, n)
    short = F.filter("actions", lambda t: (t != "") & (F.length(t) < 60))
    return (scanned.withColumn("__n", F.array_join("nodes", "\n"))
            .withColumn("__h", F.array_join(first(F.col("headings"), headings), "\n"))
            .withColumn("__n", redact_text("__n")).withColumn("__h", redact_text("__h"))
            .withColumn("url", page_url(F.col(url)))
            .withColumn("headings", F.filter(F.split("__h", "\n"), lambda t: t != ""))
            .withColumn("actions", first(F.array_distinct(short), actions))
            .withColumn("text", outline(F.split("__n", "\n"), limit))
            .drop("nodes", "__n", "__h"))


def context_text(context: DataFrame, *, fields: str | None = None,
                 picture: str | None = None) -> Column:
    """The page description as lines. ``fields`` is an array of label, value, masked."""
    part = lambda head, body, full: F.when(full, F.concat(F.lit(head), body))
    lines = [F.concat(F.lit("PAGE: "), F.coalesce("title", F.lit(""))),
             F.concat(F.lit("URL: "), F.coalesce("url", F.lit(""))),
             part("HEADINGS: ", F.array_join("headings", " / "), F.size("headings") > 0)]
    if fields:
        one = F.transform(fields, lambda f: F.concat(
            F.lit("  - "), f["label"], F.lit(": "), f["value"],
            F.when(f["masked"], "   <- removed on device").otherwise("")))
        lines.append(part("FIELDS:\n", F.array_join(one, "\n"), F.size(fields) > 0))
    lines += [part("CONTROLS: ", F.array_join("actions", " | "), F.size("actions") > 0),
              part("VISIBLE TEXT: ", F.col("text"), F.col("text") != "")]
    if picture:
        lines.append(part("TEXT READ FROM THE SCREEN IMAGE:\n", F.array_join(picture, "\n"),
                          F.size(picture) > 0))
    return F.concat_ws("\n", *lines)


def needs_ocr(context: DataFrame, *, dominant: str | None = None, visual_rules: int = 0,
              enabled: bool = True) -> DataFrame:
    """Mark pages whose picture has to be read: little text, a dominant picture, or a visual rule."""
    sparse = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")) < 120
    big = F.coalesce(F.col(dominant), F.lit(False)) if dominant else F.lit(False)
    wanted = F.lit(enabled) & (sparse | big | F.lit(visual_rules > 0))
    return context.withColumn("needs_ocr", wanted)


def biggest_media(media: DataFrame, view_width: float = 1280.0, view_height: float = 720.0,
                  page: str = "page_id") -> DataFrame:
    """The largest picture of each page from 40,000 square pixels up; the first one wins a tie."""
    area = F.col("width") * F.col("height")
    best = media.withColumn("area", area).filter(F.col("area") >= 40_000).groupBy(page).agg(
        F.min(F.struct((-F.col("area")).alias("a"), F.col("el_id"))).alias("m"))
    return best.select(page, F.col("m.el_id").alias("el_id"), (-F.col("m.a")).alias("area"),
                       (-F.col("m.a") > view_width * view_height * 0.35).alias("dominant"))


def paint_terms(items: DataFrame, page: str = "page_id", most: int | None = None) -> DataFrame:
    """Terms a page can cover itself: shown categories, addresses in pieces, all or the first ``most``."""
    from veil.operators.blocks import first_rows
    from veil.schema import PAINTABLE

    pieces = F.when(F.col("cat") == "ADDRESS", F.split("match", r"\s*[,\n]\s*")).otherwise(
        F.array("match"))
    terms = (items.filter(F.col("cat").isin(*PAINTABLE))
             .select(page, "start", "ph", F.posexplode(pieces).alias("piece", "term"))
             .withColumn("term", F.trim("term")).filter(F.length("term") >= 2))
    return terms if most is None else first_rows(terms, [page], ["start", "piece", "ph"], most)
