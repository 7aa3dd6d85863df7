"""Connected components of a link table by label passing with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.store import drop, save


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of ``links`` (a, b).

    Each round a node takes the smallest label among its own and its neighbours', then its label's
    label; both are aggregates and equi joins. Labels are written to the shared folder each round.
    """
    spark = links.sparkSession
    both_at = save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .distinct(), "links")
    both = spark.read.parquet(both_at)
    at = save(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        labels = spark.read.parquet(at)
        seen = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near")))
        best = labels.join(seen, labels["node"] == seen["a"], "left").select(
            "node", F.least("root", "near").alias("new"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("far"))
        after = best.join(jump, "new", "left").select("node", F.least("new", "far").alias("root"),
                                                      (F.least("new", "far") != F.col("old")).alias("moved"))
        then = save(after, "labels")
        moved = spark.read.parquet(then).where("moved").limit(1).count()
        drop(spark, at)
        at = then
        if not moved:
            drop(spark, both_at)
            return spark.read.parquet(at).select("node", "root")
