"""Session settings the library is tuned for."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Regular expressions and folds are CPU bound: smaller input splits than the 128 MB default
    # keep all cores of a wide cluster busy.
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "veil", master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; keyword arguments override (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder is the one named by ``spark.checkpoint.dir``. Only a single-process session (tests)
    may leave it unset and then gets a local temporary folder; on a cluster that is an error, since
    every executor would write to its own disk.
    """
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/veil-{name}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: the join shuffles both sides.

    Spark takes the compressed size of the files read for the size of a side, also after an explode, and so
    sends a side of many times ``spark.sql.autoBroadcastJoinThreshold`` whole through the driver.
    """
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from there.

    For small results of expensive input that the plan needs more than once: the input is then
    read once, and a lost executor costs a re-read of the written table, not of its whole history.
    """
    path = work_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
