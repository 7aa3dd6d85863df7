"""Operators over all rows, also where the registered query's SQL asks for some of them."""

import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from veil.functions import secrets as sec
from veil.operators import gate, pages, regions
from veil.plans import catalog, chats, duck
from veil.plans.tables import derived, with_derived
from veil.schema import PAINTABLE


def test_detector_queries_see_every_row(spark, monkeypatch):
    n = derived(spark, DATA, "messages").count()
    monkeypatch.setattr(chats.d, "detect_grouped", lambda c: f"array(named_struct('cat', 'X', 'match', {c}))")
    assert catalog.QUERIES["h3_ocr_groups"](spark, DATA).count() == n
    monkeypatch.setattr(chats, "from_hex", lambda c: "text")
    assert catalog.QUERIES["g15_decoders"](spark, DATA).count() == derived(spark, DATA, "sentences").count()


def test_memory_hits_remember_all_categories(spark, monkeypatch):
    seen, real = [], chats.match_memory
    monkeypatch.setattr(chats, "match_memory", lambda turns, memory: seen.append(memory) or real(turns, memory))
    catalog.QUERIES["h24_memory_hits"](spark, DATA)
    assert {r.cat for r in seen[0].select("cat").distinct().collect()} >= {"NAME", "PHONE", "SECRET", "CARD"}


def test_describe_secret_over_all_values(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{DATA}/orders.parquet'")
    want = con.execute(f"{with_derived('messages')} SELECT DISTINCT planted, {duck.describe('planted')} FROM messages "
                       "WHERE planted IS NOT NULL").fetchall()
    got = derived(spark, DATA, "messages").filter("planted IS NOT NULL").select(
        "planted", F.expr(sec.describe_secret("planted"))).distinct().collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.fixture(scope="module")
def boxes(spark):
    return derived(spark, DATA, "boxes").withColumn("ph", F.concat(F.lit("["), F.upper("text"), F.lit("]"))).cache()


def test_covered_note_over_all_boxes(boxes):
    names = defaultdict(set)
    for r in boxes.collect():
        names[r.image_id].add(r.ph)
    want = {i: "\nCOVERED IN THE PICTURE: " + ", ".join(sorted(p)) for i, p in names.items()}
    assert {r.image_id: r.note for r in regions.covered_note(boxes).collect()} == want


def test_first_success_over_all_boxes(boxes):
    rows = boxes.selectExpr("image_id", "region_id % 2 AS target", "region_id", "CAST(x0 AS INT) % 7 AS priority")
    best = defaultdict(lambda: 99)
    for r in rows.collect():
        best[r.image_id, r.target] = min(best[r.image_id, r.target], r.priority)
    want = sorted(tuple(r) for r in rows.collect() if r.priority == best[r.image_id, r.target])
    cols = ("image_id", "target", "region_id", "priority")
    assert sorted(map(tuple, regions.first_success(rows).select(*cols).collect())) == want


def test_paint_terms_over_all_sentences(spark):
    rows = derived(spark, DATA, "sentences").select("doc_id", "text")
    found = gate.findings(gate.sanitize(rows, warnings=False), ("doc_id",)).cache()
    want = []
    for r in found.collect():
        if r.cat in PAINTABLE:
            parts = re.split(r"\s*[,\n]\s*", r.match) if r.cat == "ADDRESS" else [r.match]
            want += [(r.doc_id, p.strip()) for p in parts if len(p.strip()) >= 2]
    got = pages.paint_terms(found, "doc_id").select("doc_id", "term").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1000
