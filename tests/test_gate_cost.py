"""What the session gate and its exit check evaluate for a text, and that the shorter ways give the same spans."""

import re

from pyspark.sql import functions as F

from veil.functions import spans as sp
from veil.operators import detect as d
from veil.operators import session_gate as g
from veil.operators.gate import unresolved
from veil.operators.terms import TOKEN, remembered_leaks, tokens, word_spans
from veil.session import cut

TEXTS = ["", "a", "one a two a", "aa a", "é😀 a1 b-c", "x￿a￿b a", "no match 9", "a\nb", "ab ab abc", "[ID] a",
         "word " * 900, None]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def spans(spark, made):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", F.expr(made).alias("f")).collect()
    return {r["text"]: None if r["f"] is None else [tuple(x) for x in r["f"]] for r in rows}


def test_single_and_repeated_matches_have_their_offsets(spark):
    for pattern in ("(?<![a-z])a", "[a-z]+", "a(?=b)|9", "[b-c]"):
        for found in (sp.find_spans("text", pattern), sp.find_tokens("text", pattern)):
            got = spans(spark, found)
            for t in TEXTS[:-1]:
                assert got[t] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)], (pattern, t)


def test_tokens_of_short_and_long_texts(spark):
    for short in (4000, 0):
        got = spans(spark, tokens("text", short))
        assert all(got[t] == [(m.start(), m.end(), m[0]) for m in re.finditer(TOKEN, t)] for t in TEXTS[:-1])
    got = spans(spark, word_spans("text", [1, 2, 5], "+"))
    for t in TEXTS[:-1]:
        at = list(re.finditer(TOKEN, t.lower()))
        assert got[t] == [(run[0].start(), run[-1].end(), "+".join(m[0] for m in run)) for n in (1, 2, 5)
                          for run in (at[i:i + n] for i in range(len(at) - n + 1))]


def test_gates_stand_outside_of_what_is_interpreted(spark):
    read = {name: name for name in ("low", "runs", "digits", "cued")}
    for name in d.LAYERS:
        made = d.layer_items("t", (name,), **read)
        assert re.match(r"concat\((?:concat\()*if\(", made), name
    # No pattern is compiled for each row, and the readings are columns, not variables of a lambda around all layers.
    made = d.detect_email("t")
    assert f"split(t, {sp.lit('￿')}" not in made and "regexp_replace(t" in made
    found = plan(unresolved(spark.createDataFrame([("a",)], "text string"), "text"))
    assert all(f"__{name}#" in found for name in read)


def test_session_gate_hides_and_hides_again(spark):
    turns = cut(spark.createDataFrame([
        (1, 1, "my name is Asha Kapoor"), (1, 2, "tell Kapoor, roopakahsa or asha.kapoor"), (1, 3, "see page 834"),
        (1, 4, 'drowssap = "a1b2c3d4" and my card is 4785380592391139'), (2, 1, "Kapoor is a common name"), (2, 2, None)],
        "conv_id long, turn long, text string"))
    got = {(r["conv_id"], r["turn"]): r["clean"] for r in g.gate_session(turns).collect()}
    assert got[1, 1] == "my name is [PERSON_1]" and got[1, 3] == "see page 834"
    assert got[1, 2] == "tell [PERSON_1], [PERSON_1] or [PERSON_1]"
    assert "[CARD]" in got[1, 4] and "4785" not in got[1, 4]
    assert got[2, 1] == "Kapoor is a common name" and got[2, 2] == ""


def test_exit_check_reads_each_payload_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(g, "cut", lambda df: stored.append(plan(df)) or cut(df))
    turns = cut(spark.createDataFrame([(1, 1, "my name is Asha")], "conv_id long, turn long, text string"))
    gated = g.gate_session(turns, warnings=False)
    stored.clear()
    g.verify_session(gated)
    # A generator over a bare column makes Spark put all detectors into a filter too.
    assert len(stored) == 1 and "Filter (size" not in stored[0] and stored[0].count(d.LONGER_NUMBER) <= 4


def test_leaks_inside_words_and_backwards(spark):
    texts = spark.createDataFrame([(1, 1, "xAsha-Kapoorx"), (1, 2, "roopak"), (1, 3, "[A] as[B]ha"), (1, 4, "li"), (1, 5, "lime"),
                                   (1, 6, None)], "conv_id long, turn long, clean string")
    held = spark.createDataFrame([(1, "Asha Kapoor", "NAME", 1), (1, "Kapoor", "NAME", 1), (1, "Li", "NAME", 1), (1, "Asha", "NAME", 1)],
                                 "conv_id long, value string, cat string, first_turn long")
    got = {(r["turn"], r["value"]) for r in remembered_leaks(texts, held).collect()}
    assert got == {(1, "Asha Kapoor"), (1, "Kapoor"), (1, "Asha"), (2, "Kapoor"), (4, "Li")}
