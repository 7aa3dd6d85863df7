"""Sides that grow with the input are shuffled, not sent whole through the driver."""

from pyspark.sql import functions as F

from tests.conftest import DATA
from veil.operators import session_gate as g
from veil.operators.placeholders import number_placeholders
from veil.operators.terms import match_memory, remembered_leaks
from veil.plans.catalog import QUERIES
from veil.plans.tables import derived
from veil.session import cut
from veil.streaming import sessions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_all_turns_are_not_broadcast(spark):
    turns = derived(spark, DATA, "messages")
    memory = cut(turns.filter("planted IS NOT NULL").select(
        "conv_id", F.col("planted").alias("value"), "cat", F.col("turn").alias("first_turn")))
    stored = cut(turns.select("conv_id", "turn", "text"))
    for hits in (match_memory(stored, memory), remembered_leaks(stored, memory, text="text")):
        assert "SortMergeJoin" in plan(hits) and "Broadcast" not in plan(hits)


def test_session_gate_does_not_broadcast(spark):
    turns = cut(derived(spark, DATA, "talks").select("conv_id", "turn", "text"))
    choices = turns.filter("turn % 4 = 0").select("conv_id", "turn", F.lit(11).alias("start"), F.lit(False).alias("hide"))
    gated = g.gate_session(turns, decisions=choices)
    assert "SortMergeJoin" in plan(gated) and "Broadcast" not in plan(gated)
    assert "Broadcast" not in plan(g.verify_session(cut(gated)))
    items = cut(g.session_findings(gated).drop("number"))
    assert "Broadcast" not in plan(number_placeholders(items))


def test_exit_check_of_sessions_plans_the_detectors_once(spark):
    turns = cut(derived(spark, DATA, "talks").select("conv_id", "turn", "text"))
    done = g.verify_session(cut(g.gate_session(turns, warnings=False)))
    assert plan(done).count("regexp") < 100  # the joins do not carry the detectors' hundreds of patterns


def test_stream_batches_do_not_broadcast(spark, tmp_path, monkeypatch):
    turns = cut(derived(spark, DATA, "messages").filter("turn % 8 IN (0, 5)").select(
        "conv_id", "turn", "text", F.expr("if(turn % 8 = 5, 'reset', '')").alias("control")))
    stored = []
    for module in (g, sessions):  # what is stored on the way no longer shows in the last plan
        monkeypatch.setattr(module, "cut", lambda df: stored.append(plan(df)) or cut(df))
    state = sessions.StateTable(spark, str(tmp_path), "bigint")
    for batch in (0, 1):  # the second one reads what the first has added
        done = sessions.gate_batch(turns.filter(f"turn % 2 = {batch}"), state, batch)
        assert "SortMergeJoin" in plan(done) and "Broadcast" not in plan(done)
    assert [p for p in stored if "Broadcast" in p] == []


def test_decided_items_do_not_broadcast(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(g, "cut", lambda df: stored.append(plan(df)) or cut(df))
    for name in ("c9_decided_items", "h27_rules_text"):
        stored.append(plan(QUERIES[name](spark, DATA)))
    assert any("SortMergeJoin" in p for p in stored)
    assert [p for p in stored if "Broadcast" in p] == []


def test_remembered_names_do_not_broadcast(spark):
    for name in ("c5_match_memory", "h24_memory_hits"):
        assert "Broadcast" not in plan(QUERIES[name](spark, DATA))
