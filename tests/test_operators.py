"""Operators against brute force, with hot keys and small blocks."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veil.functions.boxes import loc_boxes
from veil.functions.normalize import spelled_digits, unspace
from veil.operators import blocks, grid, pages, payload, regions, rules, tables, terms
from veil.operators.model import chunk_text, model_items, unchunk
from veil.operators.payload import build_payload, split_action
from veil.sources import files
from veil.sources.files import parse_delimited, read_grid, read_texts


def test_nothing_is_cut_by_default(spark):
    cells = spark.createDataFrame([(1, "s", i, [str(i), None]) for i in range(700)],
                                  "file_id int, sheet string, row_idx int, cells array<string>")
    text = grid.grid_to_text(grid.cap_sheet(cells)).first().text.split("\n")
    assert text == ["--- sheet: s (700 rows) ---", *[f"{i} | " for i in range(700)]]
    assert grid.cap_sheet(cells, n=5).count() == 5
    read = spark.createDataFrame([(1, i, "") for i in range(1, 21)], "file_id int, page_no int, words string").select(
        "file_id", "page_no", F.split("words", " ").alias("items"))
    assert files.pages_to_read(read, files.flag_scanned(read)).count() == 20
    body = "".join(f"<h2>Head {i}</h2><a href='x'>Go {i}</a><p>{'some words ' * 20}{i}</p>" for i in range(40))
    page = spark.createDataFrame([("http://h.example/", f"<body>{body}</body>")], "url string, html string")
    got = pages.page_context(pages.scan_pages(page)).first()
    assert len(got.headings) == len(got.actions) == 40 and got.text.endswith("some words 39")
    items = spark.createDataFrame([(1, i, "[PERSON]", "NAME", f"name{i}") for i in range(400)],
                                  "page_id int, start int, ph string, cat string, match string")
    assert pages.paint_terms(items).count() == 400


def test_running_equals_window(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.7 else rng.randrange(5), i, rng.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, o int, v long")
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("s", F.sum("v").over(w)).withColumn("m", F.max("v").over(w))
    got = blocks.running(df, ["k"], "o", F.col("v"), "s", width=7)
    got = blocks.running(got, ["k"], "o", F.col("v"), "m", fold="max", width=7)
    assert sorted(got.select("k", "o", "s", "m").collect(), key=lambda r: r["o"]) == sorted(
        want.select("k", "o", "s", "m").collect(), key=lambda r: r["o"])


def test_dedupe_equals_fold(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), i, float(rng.randrange(60)), float(rng.randrange(300))) for i in range(400)]
    rows += [(0, 400 + i, rows[0][2], rows[0][3]) for i in range(200)] + [(1, 999, None, None)]
    df = spark.createDataFrame(rows, "page_id int, ord int, left_px double, top_px double")
    want = set()
    for page in range(3):
        kept = []
        for p, o, x, y in sorted(r for r in rows if r[0] == page and r[2] is not None):
            if all(abs(x - a) >= 6 or abs(y - b) >= 6 for a, b in kept):
                kept.append((x, y))
                want.add((p, o))
    want.add((1, 999))
    assert {(r["page_id"], r["ord"]) for r in regions.dedupe_rects(df).collect()} == want


def test_bands_with_blocks(spark):
    rows = [(1, i, float(y), float(y + h)) for i, (y, h) in enumerate(
        [(0, 5), (0, 50), (30, 10), (60, 5), (64, 3), (70, 1), (71.5, 1)])]
    df = spark.createDataFrame(rows, "image_id int, region_id int, y0 double, y1 double")
    got = tables.bands(df, "image_id", "y0", "y1", "row", width=10.0).collect()
    assert {r["y0"]: r["row"] for r in got} == {0.0: 0, 30.0: 0, 60.0: 1, 64.0: 1, 70.0: 2, 71.5: 3}


def test_spans_to_regions_brute_force(spark):
    rng = random.Random(3)
    regs, pos = [], 0
    for i in range(60):
        n = rng.randrange(1, 40)
        regs.append((1, i, pos, pos + n))
        pos += n + 1
    spans = [(1, s, s + rng.randrange(1, 90)) for s in rng.sample(range(pos), 40)]
    r = spark.createDataFrame(regs, "image_id int, region_id int, start int, end int")
    s = spark.createDataFrame(spans, "image_id int, start int, end int")
    got = regions.spans_to_regions(s, r, bucket=16).select("span_start", "span_end", "region_id").collect()
    want = sorted((a, b, i) for _, a, b in spans for _, i, x, y in regs if a < y and b > x)
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize(("first", "per_part"), [(0, 3), (9_995, 10_000)])
def test_spans_of_a_part_meet_its_regions(spark, first, per_part):
    rows = [(i % 2, first + i, f"secret{i}" if i % 3 == 0 else f"word{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "image_id int, region_id int, text string")
    texts = regions.join_regions(df, per_part=per_part)
    spans = [(r.image_id, r.part_no, m.start(), m.end()) for r in texts.collect()
             for m in re.finditer("secret[0-9]+", r.text)]
    placed = regions.region_offsets(df, per_part=per_part)
    part = {(r.image_id, r.part_no): r.text for r in texts.collect()}
    assert len(part) > 2
    assert all(part[r.image_id, r.part_no][r.start:r.end] == r.text for r in placed.collect())
    found = spark.createDataFrame(spans, "image_id int, part_no int, start int, end int")
    hit = regions.spans_to_regions(found, placed).select("image_id", "region_id").collect()
    assert sorted(map(tuple, hit)) == sorted((i, o) for i, o, t in rows if t.startswith("secret"))
    with pytest.raises(ValueError, match="part_no"):
        regions.spans_to_regions(found.drop("part_no"), placed)


def brute(text, term):
    low, t, at, out = text.lower(), term.lower(), -1, []
    while (at := low.find(t, at + 1)) != -1:
        around = (low[at - 1] if at else " ") + (low[at + len(t)] if at + len(t) < len(low) else " ")
        if not any(c.isascii() and c.isalnum() for c in around):
            out.append(at)
    return out


def test_match_terms_brute_force(spark):
    texts = ["Ravi met Travis. ravi, RAVI!", "Project Falcon; project  falcon; the Project Falcon-2",
             "C++ and c++x and (c++)", "a-b-c x", ""]
    words = ["ravi", "project falcon", "c++", "b", "x", "a-b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = terms.match_terms(df, spark.createDataFrame([(w,) for w in words], "term string"))
    want = sorted((i, w, at) for i, t in enumerate(texts) for w in words if len(w) >= 2 for at in brute(t, w))
    assert sorted((r["doc_id"], r["term"], r["start"]) for r in got.collect()) == want


def test_memory_variants(spark):
    memory = spark.createDataFrame([(1, "adjhfb124", "SECRET", 1), (1, "abcd-9876", "ID", 1)],
                                   "conv_id int, value string, cat string, first_turn int")
    turns = spark.createDataFrame([
        (1, 1, "adjhfb124"), (1, 2, "it is ADJHFB124 ok"), (1, 3, "421bfhjda"), (1, 4, "a d j h f b 1 2 4"),
        (1, 5, "part 9876 only"), (1, 6, "other 98761"), (2, 7, "adjhfb124")], "conv_id int, turn int, text string")
    assert sorted(r["turn"] for r in terms.match_memory(turns, memory).collect()) == [2, 3, 4, 5]


def test_rules_upkeep(spark):
    log = spark.createDataFrame([
        (1, "term", "Priya", None, None), (2, "allow", "PRIYA", None, None), (3, "colname", "salary", None, None),
        (4, "colname", "salary", None, None), (5, "term", "priya", None, None), (6, "term", "Priya", None, None)],
        "seq int, kind string, value string, phrase string, qualifier string")
    assert [(r["seq"], r["kind"]) for r in rules.upsert_rules(log).orderBy("seq").collect()] == [
        (3, "colname"), (5, "term")]
    gone = spark.createDataFrame([("term", "Mumbai"), ("colname", "SALARY")], "kind string, value string")
    left = rules.remove_rules(rules.upsert_rules(log).select("seq", "kind", "value"), gone)
    assert [(r["kind"], r["value"]) for r in left.collect()] == [("term", "priya")]
    asked = lambda *rows: sorted((r["kind"], r["value"]) for r in rules.remove_rules(
        left, spark.createDataFrame(rows, "kind string, value string")).collect())
    # Nothing removed and terms alone: an allow rule. Anything removed, or another kind: none.
    assert asked(("term", "Mumbai")) == [("allow", "Mumbai"), ("term", "priya")]
    assert asked(("term", "Mumbai"), ("term", "priya")) == []
    assert asked(("term", "Mumbai"), ("colname", "pay")) == [("term", "priya")]


def test_visual_targets(spark):
    mine = spark.createDataFrame([
        (1, "visual", None, None, "photograph", None), (2, "visual", None, None, "logo", "aadhaar")],
        rules.RULE_SCHEMA)
    targets = rules.visual_targets(mine)
    assert sorted((r["phrase"], r["builtin"]) for r in targets.collect()) == [
        ("QR code", True), ("logo", False), ("photograph", False)]
    asked = rules.phrasings(targets).collect()
    last = {r["phrase"]: (r["task"], r["wording"]) for r in sorted(asked, key=lambda r: r["priority"])}
    assert last == {p: ("detection", p) for p in ("QR code", "logo", "photograph")}
    tries = sorted((r["phrase"], r["priority"], r["wording"]) for r in asked if r["task"] == "grounding")
    assert tries == [("QR code", 0, "barcode"), ("QR code", 1, "QR code"), ("logo", 0, "aadhaar logo"),
                     ("logo", 1, "logo"), ("photograph", 0, "photo of a person"),
                     ("photograph", 1, "human face"), ("photograph", 2, "photograph")]


@pytest.mark.parametrize("text,sep,want", [
    ('a,b\n"x,1","y\n2"\n', ",", [["a", "b"], ["x,1", "y\n2"]]),
    ('say ""hi""\r\n"he said ""no""",\r\n , \r\nz', ",", [["say hi"], ['he said "no"', ""], ["z"]]),
    ("a\tb,c\n\n", "\t", [["a", "b,c"]]),
    ('a,"open, b\nc', ",", [["a", "open, b\nc"]]),
])
def test_delimited(spark, text, sep, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_delimited(F.col("t"), sep).alias("r")).first()["r"] == want


def test_read_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\n"Rao, A","x\ny"\n\nB,"say ""hi"""\n')
    got = read_grid(spark, str(tmp_path / "a.csv")).orderBy("row_idx").collect()
    assert [r["cells"] for r in got] == [["name", "note"], ["Rao, A", "x\ny"], ["B", 'say "hi"']]
    (tmp_path / "b.txt").write_text("x" * 50)
    assert read_texts(spark, str(tmp_path / "b.txt"), 10).first()["text"] == "x" * 10 + "\n… truncated"


def test_chunks(spark):
    text = "word " * 500 + "y" * 2000
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = chunk_text(df).orderBy("chunk_no").collect()
    assert "".join(r["text"] for r in got) == text and max(len(r["text"]) for r in got) <= 900
    assert all(text[r["base"]:r["base"] + len(r["text"])] == r["text"] for r in got)
    spans = spark.createDataFrame([(1, 900, 3, 8)], "doc_id int, base int, start int, end int")
    assert unchunk(spans).first()["start"] == 903


def test_model_grading(spark):
    texts = ["my son Arjun is ill", "tell me about Mahatma Gandhi"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = spark.createDataFrame([(0, 7, 12, "PERSON", 0.9), (1, 14, 28, "PERSON", 0.9)],
                                  "doc_id int, start int, end int, label string, score double")
    got = {r["doc_id"]: r["i"]["level"] for r in model_items(df, spans, ("doc_id",), "text").collect()}
    assert got == {0: "medium", 1: "low"}


def test_scalar_readings(spark):
    df = spark.createDataFrame([("nine eight double seven", "a d i 1 2 3")], "a string, b string")
    row = df.select(F.expr(spelled_digits("a")).alias("x"), F.expr(unspace("b")).alias("y")).first()
    assert (row["x"], row["y"]) == ("9877", "adi123")


def test_location_tokens(spark):
    df = spark.createDataFrame([("<s>face<loc_0><loc_499><loc_999><loc_10><loc_1><loc_2><loc_3><loc_4></s>",)], "t string")
    got = df.select(loc_boxes(F.col("t"), F.lit(1000.0), F.lit(500.0)).alias("b")).first()["b"]
    assert [b["label"] for b in got] == ["face", "face"]
    assert got[0]["box"] == pytest.approx([0.5, 249.75, 999.5, 5.25])


def test_answers(spark):
    df = spark.createDataFrame([("Do this.\nACTION: Highlight | Save button\n",), ("no action",)], "t string")
    got = df.select(*[c.alias(n) for c, n in zip(split_action(F.col("t")), "vat")]).collect()
    assert [tuple(r) for r in got] == [("Do this.", "highlight", "Save button"), ("no action", None, None)]


def test_payload_without_blocks(spark):
    q = spark.createDataFrame([(1, 1, "hello")], "conv_id int, turn int, text string")
    f = spark.createDataFrame([(1, 1, "a.txt", "text", "")], "conv_id int, turn int, name string, kind string, text string")
    assert build_payload(q.filter("turn > 1"), f, q).first()["payload"] == "hello"


def test_terms_and_memory_of_any_length(spark):
    texts = spark.createDataFrame([(1, "the big project falcon launch is near")], "doc_id long, text string")
    wanted = spark.createDataFrame([("Big Project Falcon Launch",)], "term string")
    assert [(r["start"], r["end"]) for r in terms.match_terms(texts, wanted).collect()] == [(4, 29)]
    turns = spark.createDataFrame(
        [(1, 2, "tell Ana"), (1, 3, "banana an a"), (1, 4, "ask jo li wu"), (1, 5, "it was 834")],
        "conv_id long, turn long, text string")
    memory = spark.createDataFrame([(1, v, "NAME", 1) for v in ("Ana", "834", "Jo Li Wu")],
                                   "conv_id long, value string, cat string, first_turn long")
    got = terms.match_memory(turns, memory).collect()
    assert sorted((r["turn"], r["match"]) for r in got) == [(2, "Ana"), (4, "jo li wu"), (5, "834")]


def test_request_of_a_late_session_keeps_its_system_turn(spark):
    turns = spark.createDataFrame([(1, 250_001, "user", "hi"), (1, 450_000, "user", "again")],
                                  "conv_id long, turn long, role string, text string")
    rows = payload.request_messages(turns, "Be brief.").orderBy("part_no").collect()
    assert [r["part_no"] for r in rows] == [0, 1]
    assert ["system" in r["messages"] for r in rows] == [True, False]


def test_files_keep_attach_order(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, "conv_id long, turn long, " + schema)
    files = one([(1, 1, "b", "text", "first", 0), (1, 1, "a", "text", "second", 1)],
                "name string, kind string, text string, ord int")
    got = payload.build_payload(one([(1, 1, "s")], "text string"), files, one([(1, 1, "q")], "text string"))
    text = got.first()["payload"]
    assert text.index("first") < text.index("second") and text.endswith("---\n\nq")


def test_account_numbers_end_at_18_digits_and_longer_ones_are_hidden_too(spark):
    from veil.operators import detect as d

    df = spark.createDataFrame([("a " + "7" * 18 + " b " + "7" * 19,)], "text string")
    found = lambda f: [len(r[0]) for r in df.select(F.inline(F.expr(f("text")))).select("match").collect()]
    assert (found(d.detect_accounts), found(d.detect_numbers)) == ([18], [19])
    assert sorted(found(d.all_items)) == [18, 19]


def test_delimited_file_of_many_rows(spark, tmp_path):
    """Ten times the rows took a hundred times as long."""
    import time

    took = {}
    for n in (2_000, 2_000, 40_000):
        (tmp_path / f"{n}.csv").write_text("".join(f'{i},"a, ""{i}""\nb",c\r\n' for i in range(n)))
        began = time.time()
        got = read_grid(spark, str(tmp_path / f"{n}.csv")).agg(
            F.count("cells").alias("n"), F.sum(F.col("cells")[0].cast("long")).alias("s"),
            F.min(F.size("cells")).alias("m")).first()
        took[n] = time.time() - began
        assert tuple(got) == (n, n * (n - 1) // 2, 3)
    assert took[40_000] < 60 * max(took[2_000], 0.1)


def test_tasks_do_not_grow_with_the_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(400_000).selectExpr("id", "md5(cast(id AS string)) AS h").coalesce(1).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "t.parquet").glob("*.parquet"))
    spread = files.read_spread(spark, path, size // 100)
    assert spread.rdd.getNumPartitions() >= 100 and spread.count() == 400_000
