"""Main text of web pages: page markup, and the difference to pages at the nearest URLs.

Lines inside ``article`` or ``main`` are the author's own: two articles may quote the same license or
passage, also at the same place, so there only the markup decides. Pages with open text (outside of such
marks, and not excluded by the markup) are sorted by host and URL path over the whole table (a range
exchange, so that a large host is spread over many tasks) and compared with the nearest pages before and
after them on their host: the lines of a longest common subsequence are what the site's template put
there, and the open ones are deleted. Pages without open text have nothing to lose or to tell; they skip the
exchange.

A copy is no page of the same template. Two pages are copies if they share more than half of their text
and what they do not share is alike too (or one of them has nothing else). Consecutive copies form a run,
and the pages of a run are compared with the last page before it and the first one after it. Runs at the
borders of a range partition are settled afterwards, from the first and last pages of all partitions, so
the text of a page does not depend on the partitions.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from veil.llm.store import keep, table

#: Elements that begin a new block of text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split())
#: Elements whose text is not shown or not the article's.
SKIPPED = frozenset("aside button datalist dialog fieldset footer form head header iframe input label menu "
                    "nav noscript object option select svg template textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new block of the same kind closes.
CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())
#: Words of class, id and role that mark what is not the article.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination popup promo "
    "promotion related replies respond search share sharing sidebar social sponsor sponsored sponsors subscribe "
    "toolbar widget widgets complementary contentinfo alert".split())
#: Those that name a thing also at the front of a longer name (``ad-slot``, ``nav-links``).
FRONT = frozenset("ad ads advert breadcrumb comment comments cookie cookies footer menu nav navbar newsletter popup "
                  "sidebar social sponsor widget".split())
#: Fronts of names that say how a page or a wrapper is laid out.
LAYOUT = frozenset("has with without no is js not hide hidden show".split())
#: Whole names that mark furniture inside an article too, and an ``article`` that is a reader's or a teaser.
INNER = frozenset(
    "ad ads advert advertisement comments comment-list comment-body comment related related-posts related-articles "
    "replies respond disqus share sharing social-share share-buttons newsletter newsletter-signup sponsor sponsored "
    "promo nav navbar navigation menu breadcrumb breadcrumbs pagination sidebar toolbar widget popup modal "
    "cookie-banner cookie-notice cookies consent subscribe".split())
PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.I | re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)


@dataclass
class Page:
    """The blocks of a page in order; ``own``: those inside an article or main element."""

    blocks: list[str] = field(default_factory=list)
    own: list[bool] = field(default_factory=list)

    def dump(self) -> str:
        return json.dumps([self.blocks, self.own])


def load(page: str | None) -> Page | None:
    return Page(*json.loads(page)) if page else None


def marked(names: str, inside: bool) -> bool:
    """Does a class, id or role attribute name furniture? Inside an article only whole names count: there
    ``article-header`` holds the headline and ``share-price`` is a paragraph."""
    for name in names.strip("\"'").lower().split():
        if inside:
            if name in INNER:
                return True
        elif name in WORDS:
            return True
        else:
            parts = re.split("[-_]+", name)
            if len(parts) > 1 and parts[0] not in LAYOUT and (parts[-1] in WORDS or parts[0] in FRONT):
                return True
    return False


def parse(html: str) -> Page:
    """Blocks of text that the markup does not exclude.

    No wrapper takes a whole article with it: if a page's only articles are inside of excluded elements (a form
    around the site, a wrapper named like a side bar), the elements around the first of them do not count.
    """
    page, around = _parse(html, frozenset())
    if around and not any(page.own):
        page, _ = _parse(html, around)
    return page


def _parse(html: str, clear: frozenset[int]) -> tuple[Page, frozenset[int]]:
    """The page, and the excluded elements (by number) around its first article or main."""
    page, stack, text, at = Page(), [], [], 0
    around: frozenset[int] | None = None
    held: Counter[str] = Counter()  # open elements by name

    def flush() -> None:
        if block := " ".join(entities.unescape("".join(text)).split()):
            page.blocks.append(block)
            page.own.append(any(e[2] for e in stack))
        text.clear()

    for number, m in enumerate(PART.finditer(html)):
        if m.start() > at and not (stack and stack[-1][1]):
            text.append(html[at:m.start()])
        at = m.end()
        if not (name := m[3]):
            continue
        name = name.lower()
        skipped = bool(stack) and stack[-1][1]
        if name == "br" and not skipped:
            text.append(" ")
        if name in BLOCKS and not skipped:
            flush()
        if m[2]:
            while held[name]:
                last = stack.pop()[0]
                held[last] -= 1
                if last == name:
                    break
            continue
        if name in VOID or m[4].endswith("/"):
            continue
        if name in CLOSED_BY_SAME and stack and stack[-1][0] == name:
            held[stack.pop()[0]] -= 1
            skipped = bool(stack) and stack[-1][1]
        inside = bool(stack) and stack[-1][2]
        own = name in ("article", "main")
        if own and around is None:
            around = frozenset(e[3] for e in stack if e[4])
        off = name not in ("html", "body", "main") and any(
            marked(a, inside or name == "article") for a in ATTRIBUTE.findall(m[4]))
        # A header inside an article holds its headline; the page's own header is furniture.
        out = number not in clear and (off or (name in SKIPPED and not (name == "header" and inside)))
        stack.append((name, skipped or out, inside or (own and not off), number, out))
        held[name] += 1
    if at < len(html) and not (stack and stack[-1][1]):
        text.append(html[at:])
    flush()
    return page, around or frozenset()


def common(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of two lists of lines."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    ea, eb = len(a), len(b)
    while ea > start and eb > start and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    out = set(range(start)) | set(range(ea, len(a)))
    # What is left, without lines that the other page lacks.
    theirs, ours = set(b[start:eb]), set(a[start:ea])
    x = [i for i in range(start, ea) if a[i] in theirs]
    y = [j for j in range(start, eb) if b[j] in ours]
    if not x or not y:
        return out
    # Row i of the table of lengths is one number: its bit j is unset where y[j] makes the subsequence of x[:i]
    # longer. Only every step-th row is kept; the rows between are computed again on the way back.
    full, masks = (1 << len(y)) - 1, {}
    for k, j in enumerate(y):
        masks[b[j]] = masks.get(b[j], 0) | 1 << k

    def next_row(row: int, i: int) -> int:
        both = row & masks[a[x[i]]]
        return ((row + both) | (row - both)) & full

    step = max(1, int(len(x) ** 0.5))
    kept, row = [full], full
    for i in range(len(x)):
        row = next_row(row, i)
        if (i + 1) % step == 0:
            kept.append(row)
    j = len(y)
    for block in range((len(x) - 1) // step, -1, -1):
        rows = [kept[block]]
        for i in range(block * step, min((block + 1) * step, len(x))):
            rows.append(next_row(rows[-1], i))
        i = len(rows) - 1
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if rows[i] >> (j - 1) & 1:
                    out.add(x[block * step + i])
                    j -= 1
    return out


def alike(a: Page, b: Page) -> bool:
    """Are two pages copies of each other? By the text that they do not share, if they share the most."""
    x, y = Counter(a.blocks), Counter(b.blocks)
    both = sum(len(t) * n for t, n in (x & y).items())
    if 2 * both <= max(sum(map(len, a.blocks)), sum(map(len, b.blocks))):
        return False
    rest, other = (Counter(p for t, n in left.items() for p in _pairs(t) * n) for left in (x - y, y - x))
    if not rest or not other:
        return True
    return 2 * (rest & other).total() > max(rest.total(), other.total())


def _pairs(block: str) -> list[tuple[str, ...]]:
    words = block.split()
    return list(zip(words, words[1:], strict=False)) or [tuple(words)]


def main_text(page: Page, neighbours: list[Page]) -> str:
    """The page's text without the open lines it shares with pages of the same template.

    Lines that make up more than half of the page have to be shared with both neighbours, if there are two.
    """
    near = [n for n in neighbours if not alike(page, n)]
    size = sum(map(len, page.blocks))
    shared = [common(page.blocks, n.blocks) for n in near]
    gone: set[int] = set()
    for lines in shared:
        most = 2 * sum(len(page.blocks[i]) for i in lines) > size
        gone |= set.intersection(*shared) if most else lines
    # Without a page to compare with, open text around an article or main element is furniture.
    out = not near and any(page.own)
    return "\n\n".join(b for i, b in enumerate(page.blocks) if page.own[i] or (i not in gone and not out))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                                      schema=schema)
    rows.clear()
    return made


def _emit(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) >= 1000:
            yield _batch(waiting, schema)
    if waiting:
        yield _batch(waiting, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)


TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
OPEN = pa.schema([("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                  ("page", pa.string())])
#: Texts, pages whose run is cut by a border (side), and one row per partition with its outer pages.
SCANNED = pa.schema([*TEXT, ("page", pa.string()), ("part", pa.int32()), ("side", pa.string()),
                     ("first_host", pa.string()), ("last_host", pa.string())])
TEXT_SQL = "page_id long, url string, text string, n_chars long"
OPEN_SQL = "host string, path string, page_id long, url string, page string"
SCANNED_SQL = f"{TEXT_SQL}, page string, part int, side string, first_host string, last_host string"


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the pages without open text."""
    def rows() -> Iterator[tuple]:
        for _, _, page_id, url, html in _rows(batches):
            page = parse(html or "")
            if all(page.own):
                text = main_text(page, [])
                yield page_id, url, text, len(text)

    return _emit(rows(), TEXT)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with open text."""
    def rows() -> Iterator[tuple]:
        for host, path, page_id, url, html in _rows(batches):
            page = parse(html or "")
            if not all(page.own):
                yield host, path, page_id, url, page.dump()

    return _emit(rows(), OPEN)


def _finished(page_id: int, url: str, page: Page, near: list[Page | None]) -> tuple:
    text = main_text(page, [n for n in near if n])
    return page_id, url, text, len(text)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of a partition in order of host and path; a run waits for the first page after it."""
    part = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        run: list[tuple] = []
        host = first = first_host = before = after_first = None
        runs = 0

        def close(after: Page | None, side: str) -> Iterator[tuple]:
            for page_id, url, page in run:
                if side:
                    yield page_id, url, None, None, page.dump(), part, side, None, None
                else:
                    yield *_finished(page_id, url, page, [before, after]), None, part, "", None, None

        for now, _, page_id, url, text in _rows(batches):
            page = load(text)
            if not run:
                first, first_host, host = page, now, now
            elif now != host or not alike(run[-1][2], page):
                after = page if now == host else None
                yield from close(after, "" if runs else "first")
                after_first = after_first if runs else after
                before, host, runs = run[-1][2] if now == host else None, now, runs + 1
                run.clear()
            elif run[-1][2] == page:
                page = run[-1][2]  # a long run of copies is held once
            run.append((page_id, url, page))
        if run:
            yield from close(None, "last" if runs else "only")
            outer = [p.dump() if p else None for p in (first, after_first, before, run[-1][2])]
            yield (None, None, None, None, json.dumps(outer), part, "part" if runs else "whole", first_host, host)

    return _emit(rows(), SCANNED)


def _borders(parts: list[Row]) -> list[tuple]:
    """part, side, and the pages before and after the run: borders of all partitions made whole."""
    parts = sorted(parts, key=lambda p: p.part)
    outer = {p.part: json.loads(p.page) for p in parts}

    def walk(order: list[Row], own: str, far: str, edge: int, inner: int) -> dict[int, str | None]:
        """The nearest page beyond each partition that is not in the run at its border."""
        found: dict[int, str | None] = {}
        host = last = beyond = None
        for p in order:
            pages = outer[p.part]
            near = None
            if last and p[own] == host:
                near = beyond if alike(load(last), load(pages[edge])) else last
            found[p.part] = near
            host, last = p[far], pages[3 - edge]
            beyond = near if p.side == "whole" else pages[inner]
        return found

    before = walk(parts, "first_host", "last_host", 0, 2)
    after = walk(parts[::-1], "last_host", "first_host", 3, 1)
    out = []
    for p in parts:
        _, after_first, before_last, _ = outer[p.part]
        if p.side == "whole":
            out.append((p.part, "only", before[p.part], after[p.part]))
        else:
            out += [(p.part, "first", before[p.part], after_first), (p.part, "last", before_last, after[p.part])]
    return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _emit((_finished(page_id, url, load(page), [load(before), load(after)])
                  for page_id, url, page, before, after in _rows(batches)), TEXT)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null or empty html gives an empty text. A null URL has no host and no neighbours of other hosts;
    repeated rows are pages of their own, and copies to each other. Other columns are not read.
    """
    spark = pages.sparkSession
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    rows = pages.select(host.alias("host"), path.alias("path"), F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    texts = rows.mapInArrow(_marked, TEXT_SQL)
    order = ("host", "path", "page_id", "url", "page")
    spread = keep(rows.mapInArrow(_open, OPEN_SQL), "open").repartitionByRange(*order).sortWithinPartitions(*order)
    scanned = keep(spread.mapInArrow(_scan, SCANNED_SQL), "scanned")
    # A few pages per partition.
    parts = scanned.where("side IN ('part', 'whole')").select("part", "side", "first_host", "last_host", "page").collect()
    if not parts:
        return texts
    borders = spark.createDataFrame(_borders(parts), "part int, side string, before string, after string")
    cut = scanned.where("side IN ('first', 'last', 'only')").join(borders, ["part", "side"])
    settled = cut.select("page_id", "url", "page", "before", "after").mapInArrow(_settle, TEXT_SQL)
    return texts.unionByName(scanned.where("side = ''").select(*TEXT.names)).unionByName(settled)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
