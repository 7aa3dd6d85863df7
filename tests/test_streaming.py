"""Session state, control rows, late turns, quarantine."""

from veil.session import work_dir
from veil.sources.sinks import write_clean
from veil.streaming.messages import session_gate, write_checked_stream

SCHEMA = "conv_id long, turn long, start int, cat string, value string, control string"


def numbered(spark, *batches):
    src, out = work_dir(spark, "in"), work_dir(spark, "out")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(src)
        stream = session_gate(spark.readStream.schema(SCHEMA).parquet(src))
        (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "_state")
         .trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(out).collect()
    return sorted((r["conv_id"], r["turn"], r["value"], r["number"], r["late"]) for r in got)


def test_state_carries_over_and_resets(spark):
    got = numbered(
        spark,
        [(1, 2, 0, "NAME", "Ravi", ""), (1, 1, 0, "NAME", "Asha", ""), (2, 1, 0, "NAME", "Ravi", "")],
        [(1, 3, 0, "NAME", "ravi", ""), (1, 4, 0, "NAME", "Meera", ""), (1, 5, 0, "", "Zoya", "allow"),
         (1, 6, 0, "NAME", "Zoya", "")],
        [(1, 2, 5, "NAME", "Priya", ""), (1, 7, 0, "", "", "reset"), (1, 8, 0, "NAME", "Ravi", "")])
    assert got == [(1, 1, "Asha", 1, False), (1, 2, "Priya", 4, True), (1, 2, "Ravi", 2, False),
                   (1, 3, "ravi", 2, False), (1, 4, "Meera", 3, False), (1, 8, "Ravi", 1, False),
                   (2, 1, "Ravi", 1, False)]


def test_refused_rows_are_kept_apart(spark):
    src, out = work_dir(spark, "in"), work_dir(spark, "checked")
    spark.createDataFrame([("call +1 (212) 555-1234",), ("hello",)], "text string").write.parquet(src)
    write_checked_stream(spark.readStream.schema("text string").parquet(src), out, out + "_state").awaitTermination()
    done = spark.read.parquet(out).filter("verdict = 'clean'")
    assert {r["clean"] for r in done.collect()} == {"call [PHONE]", "hello"}


def test_a_repeated_batch_replaces_its_rows(spark):
    out = work_dir(spark, "retried")
    rows = spark.createDataFrame([("a", 0), ("b", 1)], "clean string, residual_count int")
    for batch in (0, 1, 1):
        write_clean(rows, out, batch)
    assert sorted((r["batch"], r["clean"], r["verdict"]) for r in spark.read.parquet(out).collect()) == [
        (0, "a", "clean"), (0, "b", "quarantine"), (1, "a", "clean"), (1, "b", "quarantine")]
