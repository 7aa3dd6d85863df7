"""Memory, rules, decisions and numbers of a conversation in its clean text; the exit check on memory."""

import pytest
from pyspark.sql import functions as F

from veil.operators.rules import Rule
from veil.operators.session_gate import gate_session, session_findings, verify_session
from veil.session import cut

TURNS = "conv_id long, turn long, text string"
CHOICES = "conv_id long, turn long, start int, hide boolean"
CARD = "4111111111111112"  # not a valid number: medium


def clean(spark, turns, **options):
    out = gate_session(spark.createDataFrame(turns, TURNS), **options)
    return {(r["conv_id"], r["turn"]): r["clean"] for r in out.collect()}


def test_hidden_earlier_is_hidden_again(spark):
    got = clean(spark, [(1, 1, "my name is Asha Kapoor"), (1, 2, "my name is Ravi"), (1, 3, "tell Asha hi, and Kapoor too"),
                        (1, 4, "ivaR says hi"), (1, 5, "R a v i came"), (1, 6, "my name is Asha"), (2, 9, "tell Asha hi"),
                        (3, 1, "tell Asha hi"), (3, 2, "my name is Asha"), (3, 3, None), (3, 4, "write [Asha] or [ASHA]")])
    assert got == {(1, 1): "my name is [PERSON_1]", (1, 2): "my name is [PERSON_2]",
                   (1, 3): "tell [PERSON_1] hi, and [PERSON_1] too", (1, 4): "[PERSON_2] says hi",
                   (1, 5): "[PERSON_2] came", (1, 6): "my name is [PERSON_1]", (2, 9): "tell Asha hi",
                   (3, 1): "tell Asha hi", (3, 2): "my name is [PERSON_1]", (3, 3): "", (3, 4): "write [[PERSON_1]] or [ASHA]"}


def test_the_shared_part_of_an_address_is_no_memory(spark):
    got = clean(spark, [(1, 1, "write to meera77@mail.example.com"), (1, 2, "the mail of meera77 is an example")])
    assert got[1, 2] == "the mail of [EMAIL] is an example"


def test_decisions_hold_from_their_turn_on(spark):
    turns = [(1, t, f"my card is {CARD}") for t in (1, 2, 3)] + [(1, 4, f"is {CARD} right"), (2, 1, f"my card is {CARD}")]
    choices = spark.createDataFrame([(1, 2, 11, False), (1, 1, 11, True)], CHOICES)
    got = clean(spark, turns, decisions=choices)
    assert got == {(1, 1): "my card is [ACCOUNT]", (1, 2): f"my card is {CARD}", (1, 3): f"my card is {CARD}",
                   (1, 4): f"is {CARD} right", (2, 1): "my card is [ACCOUNT]"}


def test_high_items_stay_hidden(spark):
    choices = spark.createDataFrame([(1, 1, 11, False)], CHOICES)
    assert clean(spark, [(1, 1, "my name is Asha")], decisions=choices) == {(1, 1): "my name is [PERSON_1]"}


@pytest.mark.parametrize("rules, want", [
    ((), "my name is [PERSON_1], project falcon, [EMAIL]"),
    ((Rule("term", "Project Falcon"),), "my name is [PERSON_1], [TERM], [EMAIL]"),
    ((Rule("term", "falcon", label="Code name"), Rule("term", "fal")), "my name is [PERSON_1], project [CODE_NAME], [EMAIL]"),
    ((Rule("allow", "ASHA"),), "my name is Asha, project falcon, [EMAIL]"),
    ((Rule("show", "EMAIL"), Rule("category", "NAME")), "my name is [PERSON_1], project falcon, a.b@mail.example.com")])
def test_rules(spark, rules, want):
    assert clean(spark, [(1, 1, "my name is Asha, project falcon, a.b@mail.example.com")], rules=rules) == {(1, 1): want}


def test_a_category_rule_locks_its_items(spark):
    choices = spark.createDataFrame([(1, 1, 11, False)], CHOICES)
    got = clean(spark, [(1, 1, f"my card is {CARD}")], decisions=choices, rules=[Rule("category", "ACCOUNT")])
    assert got == {(1, 1): "my card is [ACCOUNT]"}


def test_exit_check_finds_what_the_session_hid(spark):
    turns = [(1, 1, "my name is Asha Kapoor"), (1, 2, "ok"), (1, 3, f"my card is {CARD}"), (1, 4, "ok"), (2, 1, "ok")]
    choices = spark.createDataFrame([(1, 3, 11, False)], CHOICES)
    gated = gate_session(spark.createDataFrame(turns, TURNS), decisions=choices)
    leak = F.when((F.col("turn") == 2) | (F.col("conv_id") == 2), F.concat("clean", F.lit(" xroopaK-ahsAx"))).when(
        F.col("turn") == 4, F.concat("clean", F.lit(f" {CARD} a@mail.example.com"))).otherwise(F.col("clean"))
    done = verify_session(cut(gated.withColumn("clean", leak))).collect()
    got = {(r["conv_id"], r["turn"]): r["residual"] for r in done}
    assert got == {(1, 1): [], (1, 2): ["Remembered value"], (1, 3): [], (1, 4): ["E-mail address"], (2, 1): []}


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 1, "my name is Asha", "x", 5)], TURNS + ", value string, start int")
    out = gate_session(df)
    assert [r["clean"] for r in out.collect()] == ["my name is [PERSON_1]"]
    none = gate_session(df.limit(0))
    assert none.collect() == [] and session_findings(none).collect() == []
