"""Exact duplicates by a tree merge of sorted digest runs (DataFrame functions only).

Every input split is a run: its rows become (digest, check values, best id, rows). In each round
``fan_in`` neighbouring runs meet: they are exchanged by (run, digest), sorted, and merged into one run
that keeps, per digest, the best identifier and the number of rows. Copies inside a split never leave
it, a hot text sends one row per run, and after ``log_fan_in(runs)`` rounds one run is left. A class is
only merged where digest, byte length and a second hash agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.store import keep, lower_ascii, table

KEY = ["digest", "bytes", "second"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, a unique row number, the run it begins in, and the digests of its normal text."""
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(
        F.col(id_col).alias("id"), norm.alias("norm"),
        F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run")).select(
        "id", "row", "run", F.sha2("norm", 256).alias("digest"), F.octet_length("norm").alias("bytes"),
        F.xxhash64("norm").alias("second"))


def merge_round(runs: DataFrame, fan_in: int, largest: bool) -> DataFrame:
    """One level of the tree: ``fan_in`` neighbouring runs become one sorted run."""
    best = F.max("best") if largest else F.min("best")
    return (runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", *KEY).agg(best.alias("best"), F.sum("rows").alias("rows"))
            .sortWithinPartitions("run", *KEY))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     largest: bool = True, fan_in: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest (or smallest) id stays; null ids lose against all others; of rows that repeat
    both id and text exactly one is kept. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = keep(digests(docs, id_col, text_col), "digests")
    order = F.struct(F.col("id").isNotNull().alias("has") if largest else F.col("id").isNull().alias("has"),
                     "id", "row")
    best = F.max(order) if largest else F.min(order)
    runs = rows.groupBy("run", *KEY).agg(best.alias("best"), F.count("*").alias("rows"))
    last = rows.agg(F.max("run")).first()[0] or 0
    while last > 0:
        runs, last = merge_round(runs, fan_in, largest), last // fan_in
        if last > 0:
            runs = keep(runs, "runs")
    won = runs.select(*KEY, "best", "rows")
    return rows.join(won, KEY).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("rows").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("digest").alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
"""
