"""Message streams: stateless redaction, the session gate, exit check per micro-batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veil.operators.gate import exit_check, findings, sanitize
from veil.operators.metrics import observe
from veil.sources.sinks import write_clean


def read_messages_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                         files_per_trigger: int = 64) -> DataFrame:
    """Turns as they arrive."""
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", files_per_trigger).load(path))


def sanitize_stream(stream: DataFrame, text: str = "text", source: str = "message",
                    **options: Any) -> DataFrame:
    """Stateless: every message through the gate, built-in expressions only, append mode."""
    return sanitize(stream, text, source=source, **options)


class SessionGate(StatefulProcessor):
    """Numbers values per session and category in order of first appearance.

    State: ``numbers`` maps a value to its number, ``counters`` holds the last number of each
    category, ``allow`` the values the user revealed, ``seen`` the latest turn. A turn older than
    ``seen`` is handled with the state as it is and flagged late. A control row ``reset`` clears
    everything, ``allow`` adds a value to the allow list.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "cat string, value string", "n int")
        self.counters = handle.getMapState("counters", "cat string", "n int")
        self.allow = handle.getMapState("allow", "value string", "yes boolean")
        self.seen = handle.getValueState("seen", "turn long")

    def handleInputRows(self, key: Any, rows: Iterator, timerValues: Any) -> Iterator:
        import pandas as pd

        # The batches of one key hold one trigger's rows of one session; maxFilesPerTrigger bounds
        # them. Turns have to be replayed in order, hence the sort. Every state call is a round
        # trip to the JVM, so what one trigger reads is kept here and counters are written once.
        batch = pd.concat(list(rows)).sort_values(["turn", "start"], kind="stable")
        known: dict = {}
        last: dict = {}
        allowed: dict = {}
        seen = (self.seen.get() or (-1,))[0] if self.seen.exists() else -1
        out = []
        for r in batch.itertuples(index=False):
            if r.control == "reset":
                for state in (self.numbers, self.counters, self.allow, self.seen):
                    state.clear()
                known, last, allowed, seen = {}, {}, {}, -1
                continue
            value = " ".join(r.value.split()).lower()
            if r.control == "allow":
                self.allow.updateValue((value,), (True,))
                allowed[value] = True
                continue
            late, seen = r.turn < seen, max(seen, int(r.turn))
            if value not in allowed:
                allowed[value] = self.allow.containsKey((value,))
            if allowed[value]:
                continue
            slot = (r.cat, value)
            if slot not in known:
                known[slot] = self.numbers.getValue(slot)[0] if self.numbers.containsKey(slot) else 0
            if not known[slot]:
                if r.cat not in last:
                    held = self.counters.containsKey((r.cat,))
                    last[r.cat] = self.counters.getValue((r.cat,))[0] if held else 0
                last[r.cat] += 1
                known[slot] = last[r.cat]
                self.numbers.updateValue(slot, (last[r.cat],))
            out.append((key[0], r.turn, r.start, r.cat, r.value, known[slot], bool(late)))
        for cat, n in last.items():
            self.counters.updateValue((cat,), (n,))
        if seen >= 0:
            self.seen.update((seen,))
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "turn", "start", "cat", "value", "number",
                                             "late"])

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GATE_OUTPUT = ("conv_id long, turn long, start int, cat string, value string, number long, "
               "late boolean")


def session_gate(items: DataFrame) -> DataFrame:
    """Stream of found values (conv_id, turn, start, cat, value, control) to numbered values.

    State is kept per conversation; one conversation is handled in order by one task, which is
    what its numbering means.
    """
    # Map state needs the RocksDB store; the default store of a plain session cannot hold it.
    items.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = items if "control" in items.columns else items.withColumn("control", F.lit(""))
    return (rows.select("conv_id", "turn", "start", "cat", "value", "control")
            .groupBy("conv_id")
            .transformWithStateInPandas(statefulProcessor=SessionGate(), outputStructType=GATE_OUTPUT,
                                        outputMode="append", timeMode="None"))


def stream_items(stream: DataFrame, keys: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """Masked items of a sanitized stream, one row each: the input of :func:`session_gate`."""
    return findings(sanitize_stream(stream, warnings=False), keys).select(*keys, "start", "cat", "value")


def write_checked_stream(stream: DataFrame, path: str, checkpoint: str, name: str = "veil"):
    """Exit check per micro-batch: verified rows and quarantine apart, live counters observed.

    Rows land below ``batch=<epoch>``, so a micro-batch that is retried writes the same folder again.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        write_clean(batch, path, epoch)

    checked = observe(exit_check(sanitize_stream(stream)), name)
    found = F.size(F.filter("items", lambda i: i["level"] != "low"))
    keep = checked.withColumn("found", found).drop("items", "warnings")
    return (keep.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
