"""The gated stream: batches with state give what one batch over everything gives."""

from veil.operators.rules import Rule
from veil.operators.session_gate import gate_session
from veil.session import work_dir
from veil.streaming.sessions import StateTable, gate_batch, write_session_stream

SCHEMA = "conv_id long, turn long, text string, control string"
CARD = "4111111111111112"


def streamed(spark, *batches, **options):
    """Each batch is one run of the stream that goes on from the last."""
    src, out, state = (work_dir(spark, n) for n in ("in", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(src)
        write_session_stream(spark.readStream.schema(SCHEMA).parquet(src), out, state, **options).awaitTermination()
    return {(r["conv_id"], r["turn"]): (r["clean"], r["verdict"]) for r in spark.read.parquet(out).collect()}


TURNS = [(1, 1, "my name is Asha Kapoor", ""), (1, 2, "tell Asha hi", None), (2, 1, "my name is Ravi", ""),
         (1, 3, "my name is Meera", ""), (2, 2, f"my card is {CARD}", ""), (1, 4, "roopak and ravi", ""),
         (1, 5, "my name is asha kapoor", ""), (1, 6, f"ask roopakahsa about {CARD}", ""), (2, 3, f"is {CARD} right", "")]


def test_same_as_one_batch(spark):
    want = {(r["conv_id"], r["turn"]): (r["clean"], "clean")
            for r in gate_session(spark.createDataFrame(TURNS, SCHEMA)).collect()}
    assert want[1, 6][0] == "ask [PERSON_1] about [ACCOUNT]" and want[1, 3][0] == "my name is [PERSON_2]"
    assert streamed(spark, TURNS[:5], TURNS[5:], compact_every=2) == want


def test_controls_resets_and_late_turns(spark):
    got = streamed(
        spark,
        [(1, 1, "my name is Asha", ""), (1, 4, "my name is Ravi", ""), (1, 5, CARD, "allow"), (1, 6, f"my card is {CARD}", "")],
        [(1, 2, "tell Ravi and Asha", ""), (1, 7, f"is {CARD} right", ""), (1, 8, "", "reset"), (1, 9, "tell Asha", ""),
         (1, 10, "my name is Ravi", "")],
        [(1, 3, "tell Ravi and Asha", ""), (1, 11, f"my card is {CARD}", "")], rules=[Rule("term", "falcon")])
    assert {k: v[0] for k, v in got.items()} == {
        (1, 1): "my name is [PERSON_1]", (1, 4): "my name is [PERSON_2]", (1, 6): f"my card is {CARD}",
        (1, 2): "tell [PERSON_2] and [PERSON_1]",  # late, with the memory in force
        (1, 7): f"is {CARD} right", (1, 9): "tell Asha", (1, 10): "my name is [PERSON_1]",
        (1, 3): "tell [PERSON_1] and Asha", (1, 11): "my card is [ACCOUNT]"}
    assert {v[1] for v in got.values()} == {"clean"}


def test_a_repeated_batch_and_time_to_live(spark):
    path = work_dir(spark, "state")
    table = StateTable(spark, path, "bigint", compact_every=3, ttl_batches=2)
    frame = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    clean = lambda df: sorted(r["clean"] for r in df.collect())
    batches = [frame((1, 1, "my name is Asha", ""), (2, 1, "my name is Ravi", "")), frame((2, 2, "my name is Meera", "")),
               frame((2, 3, "tell Ravi", "")), frame((1, 9, "tell Asha", ""), (2, 9, "tell Meera", ""))]
    want = [["my name is [PERSON_1]"] * 2, ["my name is [PERSON_2]"], ["tell [PERSON_1]"], ["tell Asha", "tell [PERSON_2]"]]
    for number, rows in enumerate(batches):
        for _ in range(2 if number == 2 else 1):  # the second run is the repetition after a failure
            assert clean(gate_batch(rows, table, number)) == want[number]
