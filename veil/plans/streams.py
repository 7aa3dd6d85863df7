"""Streaming queries: each runs to the end of the given tables and returns what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.plans import chats
from veil.plans.registry import query
from veil.plans.sessions import TERMS, checked_sql
from veil.plans.tables import TALKS, table, with_derived
from veil.session import work_dir
from veil.streaming import messages as st
from veil.streaming import sessions

TURN = "conv_id long, turn long, role string, text string"


def run(stream, spark, name: str):
    """Append a stream to a written table, all available input, and read it back."""
    out = work_dir(spark, name)
    done = (stream.writeStream.format("parquet").option("path", f"{out}/data")
            .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def turns(spark, sf):
    return st.read_messages_stream(spark, f"{sf}/conversations*.parquet", TURN)


@query("a10_message_stream", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, sf):
    return run(turns(spark, sf), spark, "messages")


@query("t1_sanitize_stream", "SELECT conv_id, turn, text AS clean FROM conversations")
def _(spark, sf):
    """Nothing private is planted in the conversations, so the clean text is the text."""
    clean = st.sanitize_stream(turns(spark, sf), warnings=False)
    return run(clean.select("conv_id", "turn", "clean"), spark, "sanitize")


def message_stream(spark, sf):
    """The derived turns as a stream of the orders table."""
    from veil.plans.tables import MESSAGES

    orders = table(spark, sf, "orders")
    source = (spark.readStream.schema(orders.schema).load(f"{sf}/orders*.parquet", format="parquet"))
    source = source.select("o_orderkey", "o_custkey").repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(MESSAGES, orders=source).select("conv_id", "turn", "text")


def _gate_sql() -> str:
    from veil.plans.registry import ORACLES

    return ORACLES["e1_number_placeholders"]


@query("t2_session_gate", _gate_sql())
def _(spark, sf):
    """The state of the stream and the batch ranking have to agree, so the check is the batch one."""
    out = work_dir(spark, "gate")
    sessions.write_session_stream(message_stream(spark, sf), f"{out}/data", f"{out}/state", memory=False,
                                  verify=False).awaitTermination()
    done = spark.read.parquet(f"{out}/data").select("conv_id", "turn", F.inline("items"))
    return done.filter("masked").select("conv_id", "turn", "cat", "value", "number")


@query("t2_session_text", checked_sql() + " SELECT conv_id, turn, clean, verdict FROM checked")
def _(spark, sf):
    """Clean text out of the stream: memory, numbers and rules as in the batch gate. A name written backwards whose
    first half only was hidden before is refused by the exit check."""
    orders = table(spark, sf, "orders")
    source = spark.readStream.schema(orders.schema).load(f"{sf}/orders*.parquet", format="parquet")
    talks = spark.sql(TALKS, orders=source.select("o_orderkey", "o_custkey")).select("conv_id", "turn", "text")
    out = work_dir(spark, "talks")
    sessions.write_session_stream(talks, f"{out}/data", f"{out}/state", rules=TERMS).awaitTermination()
    return spark.read.parquet(f"{out}/data").select("conv_id", "turn", "clean", "verdict")


@query("t3_controls", f"""{with_derived('messages')}, e AS (SELECT *, sum(CASE WHEN turn % 8 = 5 THEN 1 ELSE 0 END) OVER
    (PARTITION BY conv_id ORDER BY turn) AS epoch FROM messages),
  named AS (SELECT conv_id, epoch, planted AS v, min(turn) AS ft FROM e WHERE turn % 8 = 0 GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, epoch ORDER BY ft) AS n FROM named)
  SELECT e.conv_id, e.turn, replace(text, v, '[PERSON_' || n || ']') AS clean FROM e JOIN ranked r
    ON r.conv_id = e.conv_id AND r.epoch = e.epoch AND r.v = e.planted WHERE turn % 8 = 0""")
def _(spark, sf):
    """Reset rows in the stream: numbers begin again after each."""
    stream = message_stream(spark, sf).withColumn("control", F.expr("if(turn % 8 = 5, 'reset', '')"))
    out = work_dir(spark, "controls")
    sessions.write_session_stream(stream.filter("turn % 8 IN (0, 5)"), f"{out}/data", f"{out}/state",
                                  verify=False).awaitTermination()
    return spark.read.parquet(f"{out}/data").select("conv_id", "turn", "clean")


@query("t4_checked_stream", "SELECT conv_id, turn, 'clean' AS verdict, strlen(text) AS bytes FROM conversations")
def _(spark, sf):
    out = work_dir(spark, "checked")
    st.write_checked_stream(turns(spark, sf), f"{out}/data", f"{out}/state").awaitTermination()
    done = spark.read.parquet(f"{out}/data")
    return done.select("conv_id", "turn", "verdict", F.octet_length("clean").cast("long").alias("bytes"))


@query("t5_live_metrics", f"""{chats.ITEMS} SELECT CAST(count(value) AS BIGINT) AS found, CAST(sum(strlen({chats.CLEAN})) AS BIGINT) AS bytes,
  CAST(0 AS BIGINT) AS leaks FROM messages m LEFT JOIN items USING (conv_id, turn)""")
def _(spark, sf):
    """Counters over all triggers, from what the stream has written; the planted values are all hidden."""
    out = work_dir(spark, "metrics")
    st.write_checked_stream(message_stream(spark, sf), f"{out}/data", f"{out}/state", "live").awaitTermination()
    done = spark.read.parquet(f"{out}/data")
    return done.agg(F.sum("found").alias("found"), F.sum(F.octet_length("clean")).alias("bytes"),
                    F.sum("residual_count").alias("leaks"))
