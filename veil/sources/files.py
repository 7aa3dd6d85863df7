"""Files in: routing, texts, delimited grids, document pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.functions.text import collapse_ws, cut_text
from veil.operators.blocks import ordered_text

MAX_CHARS = 200_000


def file_kind(name: Column, mime: Column) -> Column:
    """image, pdf, sheet or text, by media type and extension."""
    n = F.lower(name)
    return (F.when(F.coalesce(mime, F.lit("")).startswith("image/")
                   | n.rlike(r"\.(png|jpe?g|webp|gif|bmp)$"), "image")
            .when(n.endswith(".pdf"), "pdf")
            .when(n.rlike(r"\.(xlsx|xls|xlsm)$"), "sheet").otherwise("text"))


def classify_files(manifest: DataFrame, path: str = "path", mime: str = "mime") -> DataFrame:
    return manifest.withColumn("kind", file_kind(F.col(path), F.col(mime)))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of a folder; the content column is never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return classify_files(found.drop("content").withColumn("mime", F.lit(None).cast("string")))


def cut_texts(df: DataFrame, text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    return df.withColumn(text, cut_text(F.col(text), max_chars))


def read_texts(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    """One row per text file: ``path``, ``text`` (whole, or cut with a note beyond ``max_chars``)."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files if max_chars is None else cut_texts(files, max_chars=max_chars)


def parse_delimited(text: Column, sep: str) -> Column:
    """Delimited text to ``array<array<string>>``.

    Quoted fields may hold the separator or a newline, a doubled quote is a quote, carriage
    returns outside quotes vanish, wholly blank rows are dropped. Every cell is a string.
    """
    d = r"\t" if sep == "\t" else "\\Q" + sep + "\\E"
    quoted = r'"(?:[^"]++|"")*+(?:"|\z)'
    record = rf'((?:{quoted}|[^"\n]++)*+)(?:\n|\z)'
    field = rf'((?:{quoted}|[^"{d if sep == chr(9) else sep}\n])*+)({d}|\z)'
    # Outside quotes \r goes; the quotes themselves go last, doubled ones become one.
    plain = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(
        s, r'\r(?=(?:[^"]*"[^"]*")*[^"]*$)', ""), r'"((?:[^"]++|"")*+)(?:"|\z)', "$1"), '""', '"')

    # Records first, then the fields of each: the work grows with the text, not with its square.
    def cells(r: Column) -> Column:
        ends = F.filter(F.regexp_extract_all(r, F.lit(field), F.lit(2)), lambda e: e == sep)
        bodies = F.regexp_extract_all(r, F.lit(field), F.lit(1))
        return F.transform(F.slice(bodies, F.lit(1), F.size(ends) + 1), plain)

    rows = F.transform(F.regexp_extract_all(text, F.lit(record), F.lit(1)), cells)
    return F.filter(rows, lambda r: F.exists(r, lambda c: c.rlike(r"\S")))


def read_grid(spark: SparkSession, path: str, sep: str = ",",
              max_chars: int | None = None) -> DataFrame:
    """Rows of delimited files: ``file_id``, ``row_idx`` (header 0), ``cells``."""
    texts = read_texts(spark, path, max_chars)
    return texts.select(F.col("path").alias("file_id"), F.posexplode(
        parse_delimited(F.col("text"), sep)).alias("row_idx", "cells"))


def page_texts(pages: DataFrame) -> DataFrame:
    """Items of each page joined by single spaces."""
    return pages.withColumn("text", collapse_ws(F.array_join("items", " ")))


def assemble_pages(pages: DataFrame, note: str = "") -> DataFrame:
    """Document texts: a header line per page, pages joined by blank lines."""
    head = F.concat(F.lit("--- page "), "page_no", F.lit(f"{note} ---\n"), "text")
    return ordered_text(page_texts(pages).withColumn("text", head), ["file_id"], "page_no",
                        "text", "\n\n", per_part=10_000)


def flag_scanned(pages: DataFrame, per_page: int = 24) -> DataFrame:
    """Documents with almost no embedded text."""
    got = page_texts(pages).groupBy("file_id").agg(
        F.sum(F.length("text")).cast("long").alias("chars"), F.count(F.lit(1)).alias("pages"))
    return got.withColumn("scanned", F.col("chars") < per_page * F.col("pages"))


def pages_to_read(pages: DataFrame, flags: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages of scanned documents that go to image reading: all, or the first few."""
    scanned = flags.filter("scanned").select("file_id")
    wanted = pages if max_pages is None else pages.filter(F.col("page_no") <= max_pages)
    return wanted.join(scanned, "file_id", "left_semi")


def read_spread(spark: SparkSession, path: str, per_task: int = 2 << 20, by: str | None = None) -> DataFrame:
    """Parquet dealt out so that no task gets much more than ``per_task`` bytes of the files.

    Detection works for minutes on what one split of the reader holds, so splits are no measure for its tasks:
    with them the longest task grows with the table. At least twice as many tasks as cores. ``by`` names the key of the
    first grouping, which then needs no shuffle of its own and no task that grows with the table.
    """
    df = spark.read.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    wanted = max(spark.sparkContext.defaultParallelism * 2, -(-size // per_task))
    if by:
        return df.repartition(wanted, by)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
