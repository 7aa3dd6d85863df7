"""Text-model plug-in: chunks in, spans out. The model itself is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.logits import winning_label, winning_score

# Labels the model may give, and how a finding of each is shown.
LABELS = {"PERSON": ("NAME", "Person", "[PERSON]"), "LOC": ("PLACE", "Place", "[PLACE]"),
          "ORG": ("ORG", "Organisation", "[ORG]"), "ADDRESS": ("ADDRESS", "Address", "[ADDRESS]"),
          "DATE": ("DOB", "Date", "[DOB]"), "AGE": ("AGE", "Age", "[AGE]"),
          "PASSWORD": ("SECRET", "Password", "[SECRET]")}

# A model name is hidden only when the sentence is personal; "tell me about X" is not.
PERSONAL = r"(?i)(?<![a-z])(?:my|our|i|we|mr|mrs|ms|dr|name)(?![a-z])[^.!?\n]{0,60}$"
PUBLIC = r"(?i)(?:tell me about|who (?:is|was)|history of|biography of|life of|about) [^.!?\n]{0,20}$"


def chunks(text: Column, size: int = 900) -> Column:
    """Contiguous pieces of at most ``size`` characters, cut after white space where there is any.

    ``array<struct<start,text>>``; the pieces put together are the text again.
    """
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size - 1}}}(?:\s|\z)|\S{{{size}}}|\s"), F.lit(0))
    zero = F.struct(F.lit(0).alias("p"), F.array().cast(
        "array<struct<start:int,text:string>>").alias("o"))
    step = lambda z, t: F.struct((z["p"] + F.length(t)).alias("p"), F.concat(
        z["o"], F.array(F.struct(z["p"].alias("start"), t.alias("text")))).alias("o"))
    return F.aggregate(parts, zero, step, lambda z: z["o"])


def chunk_text(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 900) -> DataFrame:
    """One row per chunk with its base offset."""
    return df.select(key, F.posexplode(chunks(F.col(text), size)).alias("chunk_no", "c")).select(
        key, "chunk_no", F.col("c.start").alias("base"), F.col("c.text").alias("text"))


def unchunk(spans: DataFrame) -> DataFrame:
    """Spans of chunks as spans of the whole text."""
    return (spans.withColumn("start", F.col("start") + F.col("base"))
            .withColumn("end", F.col("end") + F.col("base")).drop("base"))


def run_model(df: DataFrame, model: Callable[[], Callable], key: str = "doc_id",
              text: str = "text", size: int = 900) -> DataFrame:
    """Model spans of every text. ``model()`` loads it, once per worker process; the result maps a
    pandas Series of texts to lists of (start, end, label, score)."""
    pieces = chunk_text(df, key, text, size)
    key_type = dict(pieces.dtypes)[key]

    def work(batches: Iterator) -> Iterator:
        import pandas as pd

        predict = model()
        for pdf in batches:
            rows = [(k, b, *span) for k, b, found in zip(pdf[key], pdf["base"], predict(pdf["text"]))
                    for span in found]
            yield pd.DataFrame(rows, columns=[key, "base", "start", "end", "label", "score"])

    out = pieces.mapInPandas(
        work, f"{key} {key_type}, base int, start int, end int, label string, score double")
    return unchunk(out)


def score_tokens(tokens: DataFrame, logits: str = "logits") -> DataFrame:
    """Winning label and its softmax probability for each token."""
    return (tokens.withColumn("label_idx", winning_label(F.col(logits)))
            .withColumn("score", winning_score(F.col(logits))))


def model_items(df: DataFrame, spans: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    """Model spans as items, graded by the words around them."""
    known = lambda n: F.coalesce(*[F.when(F.col("label") == k, F.lit(v[n]))
                                   for k, v in LABELS.items()])
    j = spans.filter(F.col("label").isin(*LABELS)).join(df.select(*keys, text), list(keys))
    head = F.substring(text, F.greatest(F.col("start") - 80, F.lit(0)) + 1,
                       F.least(F.col("start"), F.lit(80)))
    value = F.substring(text, F.col("start") + 1, F.col("end") - F.col("start"))
    level = F.when(head.rlike(PUBLIC) & ~head.rlike(PERSONAL), "low").otherwise("medium")
    return j.select(*keys, F.struct(
        F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
        value.alias("match"), value.alias("value"), known(0).alias("cat"), known(1).alias("kind"),
        level.alias("level"), F.lit("model").alias("layer"),
        F.concat(F.lit("text model, "), F.round("score", 2)).alias("ev"), known(2).alias("ph")).alias("i"))


def with_model_items(df: DataFrame, spans: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    packed = model_items(df, spans, keys, text).groupBy(*keys).agg(
        F.collect_list("i").alias("model_items"))
    return df.join(packed, list(keys), "left")
