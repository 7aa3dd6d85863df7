"""Summaries, notes and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veil.functions.spans import each
from veil.functions.text import placeholder_class


def findings_summary(findings: DataFrame, key: str) -> DataFrame:
    """Hits per placeholder class and file."""
    return findings.groupBy(key, placeholder_class(F.col("ph")).alias("class")).agg(
        F.count(F.lit(1)).alias("hits"))


def hidden_kinds(findings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Distinct kinds hidden per message, sorted."""
    return findings.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))


def payload_bytes(text: Column) -> Column:
    """Bytes that leave: UTF-8 length."""
    return F.octet_length(text)


def leak_report(checked: DataFrame) -> DataFrame:
    """Residual values by kind, over all payloads."""
    return checked.select(F.explode(F.expr(each("residual"))).alias("kind")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("leaks"))


RUN_METRICS = {
    "found": lambda: F.sum(F.size(F.filter("items", lambda i: i["level"] != "low"))),
    "bytes": lambda: F.sum(F.octet_length("clean")),
    "leaks": lambda: F.sum("residual_count"),
}


def run_metrics(checked: DataFrame) -> DataFrame:
    """Found, bytes and leaks of a run as one row. The leak count is the real one."""
    return checked.agg(*[m().cast("long").alias(k) for k, m in RUN_METRICS.items()])


def observe(checked: DataFrame, observation: Observation | str) -> DataFrame:
    """Attach the same counters to a job that runs anyway (batch or stream)."""
    return checked.observe(observation, *[m().cast("long").alias(k) for k, m in RUN_METRICS.items()])


def read_total(page_findings: DataFrame, gate_items: DataFrame, key: str) -> DataFrame:
    """Findings of the page plus items of the gate, per page."""
    both = page_findings.select(key).unionAll(gate_items.select(key))
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("total"))


def evaluate(predicted: DataFrame, labels: DataFrame, key: str, found: str,
             truth: str) -> DataFrame:
    """Recall on texts that hold something, false alarms on texts that do not."""
    j = predicted.join(labels, key)
    hit, pos = F.col(found) > 0, F.col(truth)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return j.agg(one(pos).alias("positives"), one(pos & hit).alias("caught"),
                 one(~pos).alias("negatives"), one(~pos & hit).alias("false_alarms"))


def warning_line(warnings: str = "warnings") -> Column:
    """Warnings in one line."""
    return F.array_join(F.transform(warnings, lambda w: w["why"]), " ")
