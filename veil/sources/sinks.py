"""Findings and verified texts out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.operators.gate import findings


def write_findings(sanitized: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """Masked findings, one folder per source."""
    findings(sanitized, keys).write.mode("append").partitionBy("source").parquet(path)


def split_verified(checked: DataFrame) -> DataFrame:
    """Tag rows: only those without residue are ``clean``. A row whose check gave nothing counts
    as refused, so a failed detection can never pass."""
    ok = F.coalesce(F.col("residual_count") == 0, F.lit(False))
    return checked.withColumn("verdict", F.when(ok, "clean").otherwise("quarantine"))


def write_clean(checked: DataFrame, path: str, batch: int | None = None) -> None:
    """Verified rows below ``verdict=clean``, refused ones below ``verdict=quarantine``.

    One job writes both folders, so the heavy check runs once and the two never mix. A micro-batch
    names its ``batch`` and owns the folder ``batch=<number>``: a repeated one replaces its rows.
    """
    out = split_verified(checked).write.partitionBy("verdict")
    if batch is None:
        out.mode("append").parquet(path)
    else:
        out.mode("overwrite").parquet(f"{path}/batch={batch}")
