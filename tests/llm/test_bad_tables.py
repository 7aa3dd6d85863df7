"""Empty tables, clashing columns, vectors of different lengths, very long matches."""

import random
import time

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veil.llm.ann import nearest
from veil.llm.bpe import Encoder
from veil.llm.toxicity import score_toxicity
from veil.llm.vocab import encoding, ranks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, None, None, None, None)], DOCS)
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    out = score_toxicity(docs, labels.limit(0)).collect()
    assert [(r["doc_id"], r["p_toxic"], r["toxic"], r["junk"]) for r in out] == [(1, 0.0, False, False), (2, 0.0, False, False)]
    assert score_toxicity(docs.limit(0), labels).collect() == []
    assert score_toxicity(docs, labels.where("doc_id = 7")).count() == 2


def test_toxicity_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good text", i, i, i) for i in range(20)],
                                 "doc_id long, text string, probability int, prediction int, rawPrediction int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], LABELS)
    out = score_toxicity(docs, labels, least_docs=1).collect()
    assert all(r["probability"] == r["prediction"] == r["rawPrediction"] == r["doc_id"] for r in out) and len(out) == 20


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_vectors_of_different_lengths(spark):
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(12)] + [(100, [1.0, 1.0]), (101, [1.0])]
    out = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("row_id") == 0).collect()
    assert [r["vec_id"] for r in out] == list(range(1, 11))


@pytest.mark.parametrize("name", ["a", "=", "ab", "hex", "abc"])
def test_a_long_match_in_seconds(name):
    n, rnd = 1_000_000, random.Random(3)
    text = "".join(rnd.choice("abcdef") for _ in range(n)) if name == "hex" else name * (n // len(name))
    path = P.path("byte_bpe_50k.tiktoken")
    enc, start = Encoder(ranks(path), P.PATTERN), time.time()
    got = enc.encode(text)
    assert time.time() - start < 30  # about 4 on an idle core
    assert got == encoding(path, P.PATTERN).encode_ordinary(text) and not enc.known
