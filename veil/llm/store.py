"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.session import work_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def save(df: DataFrame, name: str, by: str | None = None, codec: str = "snappy") -> str:
    """Write a table below ``spark.checkpoint.dir`` and give its path (``by``: a partition column)."""
    path = work_dir(df.sparkSession, name)
    out = df.write.option("compression", codec)
    out = out.partitionBy(by) if by else out
    out.parquet(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from the shared folder: lineage ends there."""
    return df.sparkSession.read.schema(df.schema).parquet(save(df, name))


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables that :func:`save` wrote and nothing will read again."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the byte loop of ``lower``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
