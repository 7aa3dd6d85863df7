"""The session gate on a message stream: state is a table, a micro-batch is a join with it.

Each micro-batch goes through the batch operator (:func:`veil.operators.session_gate.gate_turns`) with what
its sessions gathered before. State is kept by (session, category, value), never by conversation: a
conversation with a third of all messages is spread over tasks like any other, equal values collapse in the
JVM, and no task replays a session. Every batch writes only what it adds, below its own number, so a batch that
is repeated after a failure replaces its folder and reads the same state as before; after ``compact_every`` batches
one folder takes the place of those before it, and sessions without a turn for ``ttl_batches`` are dropped there.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.operators.placeholders import session_epoch
from veil.operators.rules import Rule
from veil.operators.session_gate import SessionState, gate_turns, verify_session
from veil.session import cut, shuffled
from veil.sources.sinks import write_clean

KEY = "struct<id:{id},epoch:long>"
#: One row per fact of a session. ``kind``: memory, number, revealed, or seen (epoch: resets so far).
STATE = ("kind string, session {key}, cat string, value string, first_turn long, level string, ph string, "
         "number long, revealed long, batch long")


class StateTable:
    """Facts of sessions in folders ``from=<first batch>/to=<last batch>``."""

    def __init__(self, spark: SparkSession, path: str, id_type: str, compact_every: int = 16,
                 ttl_batches: int | None = None):
        self.spark, self.path = spark, path
        self.key = KEY.format(id=id_type)
        self.schema = STATE.format(key=self.key)
        self.compact_every, self.ttl = max(2, compact_every), ttl_batches

    def _folders(self, before: int, but: tuple[int, int] | None = None) -> list[tuple[int, int, str]]:
        """Folders that together hold every batch before a number, each batch once (``but`` one folder)."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        found = []
        for s in (fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/from=*/to=*/_SUCCESS")) or []):
            parent = s.getPath().getParent()
            a, b = (int(p.split("=")[1]) for p in (parent.getParent().getName(), parent.getName()))
            if b < before and (a, b) != but:
                found.append((a, -b, parent.toString()))
        out, reached = [], -1
        for a, b, path in sorted(found):  # the widest folder of equal starts first
            if a > reached:
                out.append((a, -b, path))
                reached = -b
        return out

    def read(self, before: int, but: tuple[int, int] | None = None) -> DataFrame:
        paths = [p for _, _, p in self._folders(before, but)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def add(self, facts: DataFrame, batch: int) -> None:
        rows = facts.withColumn("batch", F.lit(batch).cast("long"))
        self._write(rows, batch, batch)
        if (batch + 1) % self.compact_every == 0:
            # A repeated batch writes the same folder again and must not read what it replaces.
            self._write(self._compacted(self.read(batch + 1, but=(0, batch)), batch), 0, batch)

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows.select(names).write.mode("overwrite").parquet(f"{self.path}/from={first}/to={last}")

    def _compacted(self, rows: DataFrame, batch: int) -> DataFrame:
        """Facts of the epoch a session is in, of sessions seen within the time to live."""
        now = (rows.filter("kind = 'seen'").groupBy(F.col("session.id").alias("id"))
               .agg(F.max("session.epoch").alias("epoch"), F.max("batch").alias("last")))
        if self.ttl is not None:
            now = now.filter(F.col("last") > batch - self.ttl)
        current = rows.join(shuffled(now), (F.col("session.id") == F.col("id")) & (F.col("session.epoch") == F.col("epoch")))
        seen = now.select(F.struct("id", "epoch").cast(self.key).alias("session"), F.lit("seen").alias("kind"),
                          F.col("last").alias("batch"))
        return current.filter("kind <> 'seen'").drop("id", "epoch", "last").unionByName(seen, allowMissingColumns=True)


def _facts(state: SessionState) -> DataFrame:
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    return (kind(state.memory, "memory").unionByName(kind(state.numbers, "number"), allowMissingColumns=True)
            .unionByName(kind(state.revealed, "revealed"), allowMissingColumns=True))


def _state(facts: DataFrame) -> SessionState:
    of = lambda k, *cols: facts.filter(F.col("kind") == k).select("session", *cols)
    return SessionState(of("memory", "cat", "value", "first_turn", "level", "ph"),
                        of("number", "cat", "value", "number"), of("revealed", "value", "revealed"))


def gate_batch(rows: DataFrame, table: StateTable, batch: int, *, session: str = "conv_id", turn: str = "turn",
               text: str = "text", rules: Iterable[Rule] = (), memory: bool = True,
               verify: bool = False) -> DataFrame:
    """One micro-batch: its turns gated with the state before it; what they add goes to the table.

    ``control`` of a row, if there is one: null or empty (a turn), ``reset`` (the session forgets everything; turns
    of the batch from here on are a new epoch) or ``allow`` (the text is a value that is no longer flagged in turns
    after it). A turn that arrives late is handled in the epoch and with the memory that are in force then.
    """
    control = F.coalesce(F.col("control"), F.lit("")) if "control" in rows.columns else F.lit("")
    rows = cut(rows.withColumn("control", control))
    ids = rows.select(F.col(session).alias("__id")).distinct()
    facts = cut(table.read(batch).join(shuffled(ids), F.col("session.id") == F.col("__id"), "left_semi"))
    begun = facts.filter("kind = 'seen'").groupBy(F.col("session.id").alias("__id")).agg(
        F.max("session.epoch").alias("__base"))
    timed = session_epoch(rows, F.col("control") == "reset", session, turn)
    timed = (timed.join(shuffled(begun), F.col(session) == F.col("__id"), "left").withColumn("session", F.struct(
        F.col(session).alias("id"), (F.coalesce("__base", F.lit(0)) + F.col("epoch")).alias("epoch")).cast(table.key))
             .drop("__id", "__base", "epoch"))
    timed = cut(timed)
    known = _state(facts)
    free = (timed.filter("control = 'allow'").groupBy("session", F.lower(F.trim(text)).alias("value"))
            .agg(F.min(turn).alias("revealed")))
    turns = timed.filter("control = ''").drop("control")
    out, new = gate_turns(turns, session="session", turn=turn, text=text, rules=rules, memory=memory,
                          known=known, free=free)
    if verify:
        out = verify_session(cut(out), rules, "session", turn, state=known, free=new.revealed)
    seen = timed.groupBy(F.col("session.id").alias("id")).agg(F.max("session.epoch").alias("epoch")).select(
        F.struct("id", "epoch").cast(table.key).alias("session"), F.lit("seen").alias("kind"))
    table.add(_facts(new).unionByName(seen, allowMissingColumns=True), batch)
    return out.drop("session")


def write_session_stream(stream: DataFrame, path: str, checkpoint: str, *, session: str = "conv_id",
                         rules: Iterable[Rule] = (), memory: bool = True, verify: bool = True, compact_every: int = 16,
                         ttl_batches: int | None = None, turn: str = "turn", text: str = "text"):
    """Start the gated stream: rows below ``path/batch=<number>/verdict=<clean or quarantine>``, state below
    ``checkpoint/sessions``. Both folders have to be shared by all executors."""
    spark = stream.sparkSession
    table = StateTable(spark, f"{checkpoint}/sessions", stream.schema[session].dataType.simpleString(),
                       compact_every, ttl_batches)

    def write(batch: DataFrame, number: int) -> None:
        done = gate_batch(batch, table, number, session=session, turn=turn, text=text, rules=rules, memory=memory,
                          verify=verify)
        if not verify:
            done = done.withColumn("residual_count", F.lit(0))
        write_clean(done, path, number)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/query")
            .trigger(availableNow=True).start())
