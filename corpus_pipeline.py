"""From raw documents to packed training sequences.

Stages, in order: toxic documents go; lines that repeat over documents go; of near duplicates one document
stays; what is left is packed. Each stage is written as Parquet to the shared folder and read again as
the next one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.line_dedup import dedup_lines
from veil.llm.ngram_join import similar_documents
from veil.llm.packing import pack_documents
from veil.llm.store import keep, table
from veil.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic. Null texts stay."""
    names = docs.columns
    return score_toxicity(docs, table(spark, sf_dir, "labels")).where(~F.col("toxic")).select(*names)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat over five or more; ``n_chars`` follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group linked by five-word shingles at 0.8.

    Rows that repeat both id and text count once. Rows without an id cannot be told apart by it: all stay if
    one of them is linked to no row with an id, else none.
    """
    stay = similar_documents(docs, k=5, num=80).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = keep(stay.select(F.col("doc_id").alias("stays")).distinct(), "stays")
    # Rows meet their id and their repeats in one shuffle by id; rows without an id go apart.
    named = docs.join(stay, F.col("doc_id") == F.col("stays"), "left_semi").dropDuplicates(["doc_id", "text"])
    if not stay.where("stays IS NULL").limit(1).count():
        return named
    return named.unionByName(docs.where("doc_id IS NULL").dropDuplicates(["text"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_duplicates", drop_near_copies),
          ("packing", pack)]

#: Classifiers and tokenizers cannot be said in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
