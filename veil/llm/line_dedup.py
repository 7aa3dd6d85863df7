"""Line dedup over a levelled index of sorted runs of line hashes.

Documents arrive in batches, largest ids first. A batch becomes one run: (line hash, documents, keeper),
sorted by hash. It is anti-joined with the runs that are there, so that only lines not seen before name a
keeper (the largest id, since later batches hold smaller ones); then it is added at level 0. ``fan_in``
runs of one level are compacted into one run of the next. At the end the runs are merged: lines in at
least ``least_docs`` documents are dropped everywhere but in their keeper.

Runs hold one row per distinct line of a batch, whatever the number of copies: a hot line is counted
before it is shuffled. Lines are keyed by two 64-bit hashes with different seeds. Runs are tables in the
shared folder, bucketed by hash, so that later batches merge with them without moving them again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.store import drop, lower_ascii, save, table
from veil.session import work_dir

SPACE = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]
#: Stands for a null id; sorts below every other.
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(line: Column, least_chars: int) -> Column:
    """Two hashes of the line's key as a struct; null where the key is shorter than ``least_chars``."""
    key = line_key(line)
    return F.when(F.length(key) >= least_chars,
                  F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")))


class Runs:
    """Levelled sorted runs of (h1, h2, docs, keeper)."""

    def __init__(self, spark: SparkSession, fan_in: int = 2):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def read(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (run.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
         .option("path", work_dir(self.spark, name)).saveAsTable(name))
        return name

    def _remove(self, name: str) -> None:
        path = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()[1]
        self.spark.sql(f"DROP TABLE {name}")
        drop(self.spark, path)

    def merged(self, names: list[str]) -> DataFrame:
        parts = reduce(DataFrame.unionByName, [self.spark.table(n) for n in names])
        return parts.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """Anti-join a batch (h1, h2, doc) with the runs, add it as a run, compact full levels."""
        own = batch.groupBy(*HASH).agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("top"))
        fresh = own
        for run in self.read():
            fresh = fresh.join(run.select(*HASH), HASH, "left_anti")
        if self.levels:
            seen = own.join(fresh.select(*HASH, F.lit(True).alias("new")), HASH, "left")
            own = seen.withColumn("top", F.when(F.col("new"), F.col("top")))
        name = self._write(own.select(*HASH, "docs", F.col("top").alias("keeper")))
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fan_in:
                return
            full, self.levels[level] = self.levels[level], []
            name = self._write(self.merged(full))
            for old in full:
                self._remove(old)
            level += 1

    def close(self) -> str:
        """Merge all runs into one plain table and give its path."""
        names = [n for level in self.levels for n in level]
        path = save(self.merged(names), "lines")
        for name in names:
            self._remove(name)
        self.levels = []
        return path


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int, least_docs: int,
                   batches: int) -> DataFrame:
    """doc, drops: per document the hashes of the lines it has to lose (documents with any)."""
    spark = docs.sparkSession
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    some = docs.select(ident.alias("doc"))
    cuts = sorted(set(some.approxQuantile("doc", [i / batches for i in range(1, batches)], 0.01)))
    batch = reduce(lambda c, x: c + (F.col("doc") < F.lit(int(x))).cast("int"), cuts, F.lit(0))
    found = docs.select(ident.alias("doc"), F.explode(F.array_distinct(F.filter(F.transform(
        lines_of(F.col(text_col)), lambda x: key_hash(x, least_chars)), lambda h: h.isNotNull()))).alias("h"))
    where = save(found.select(batch.alias("batch"), "doc", "h.h1", "h.h2"), "line-hashes", by="batch")
    hashes = spark.read.schema("doc long, h1 long, h2 long, batch int").parquet(where)
    runs = Runs(spark)
    for b in range(len(cuts) + 1):
        runs.add(hashes.where(F.col("batch") == b))
    hot = spark.read.parquet(runs.close()).where(F.col("docs") >= least_docs)
    return (hashes.join(hot, HASH).where(F.col("doc") != F.col("keeper"))
            .groupBy("doc").agg(F.collect_set(F.struct(*HASH)).alias("drops")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40,
                least_docs: int = 5, batches: int = 4) -> DataFrame:
    """All rows and columns of ``docs`` with the text replaced, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least
    ``least_chars`` code points that occur in at least ``least_docs`` documents lose all their lines
    except those in the largest id holding them. A null or empty text is one empty line and becomes
    empty. Rows that share an id count as one document and are treated alike; null ids together are one
    document, smaller than any other. Columns of ``docs`` named n_lines or n_dropped are replaced.
    """
    drops = repeated_lines(docs, id_col, text_col, least_chars, least_docs, batches)
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    all_rows = docs.select(F.struct(*names).alias("row"), ident.alias("doc"))
    lines = lines_of(F.col(f"row.{text_col}"))
    kept = F.filter(lines, lambda x: ~F.coalesce(
        F.array_contains(F.col("drops"), key_hash(x, least_chars)), F.lit(False)))
    return (all_rows.join(drops, "doc", "left")
            .select("row", F.size(lines).cast("long").alias("n_lines"),
                    F.when(F.col("drops").isNotNull(), kept).alias("kept"))
            .select(*[F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n"))
                      .otherwise(F.coalesce(F.col(f"row.{c}"), F.lit(""))).alias(c) if c == text_col
                      else F.col(f"row.{c}").alias(c) for c in names],
                    "n_lines", F.when(F.col("kept").isNotNull(), F.col("n_lines") - F.size("kept"))
                    .otherwise(F.lit(0)).cast("long").alias("n_dropped")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, h.keeper IS NOT NULL AND h.keeper <> k.doc_id AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
