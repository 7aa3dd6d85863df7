"""Toxicity categories by a chain of linear classifiers.

Categories are predicted in order. The model of a category sees the words of a text and the
probabilities of the categories before it. For training those are out-of-fold predictions (a fold's rows
are scored by a model fitted on the other folds), since a model's own training predictions would look
better than what it will see later. The decision threshold of a category is where the F1 of its
out-of-fold predictions is largest.

Features are words (runs of letters, lower-cased) and their first four letters. The vocabulary is
fitted, like the models, on labelled rows only: at most about ``most_rows`` of them, chosen by a hash of
the id. Their ids and labels go to the tasks that read the texts, so texts are not shuffled; scoring is one
projection over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.store import keep, table


def words(text: Column) -> Column:
    """Distinct words, and beginnings of four letters (marked ``^``) that stand for inflected forms."""
    found = F.array_distinct(F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    return F.concat(found, F.transform(found, lambda w: F.concat(F.lit("^"), F.substring(w, 1, 4))))


#: Columns that a model adds; named apart from those a table may have.
MADE = ("__raw", "__both", "__class")


class NoLabels(ValueError):
    """There is no labelled row to fit on."""


@dataclass
class Chain:
    """A fitted chain: vocabulary, one model and one threshold per category."""

    vocabulary: CountVectorizerModel
    models: list[tuple[str, LogisticRegressionModel, float]]

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """All rows and columns of ``docs``, plus p_<category> and <category> (a decision) for each.

        Null and empty texts are scored as texts without words. Existing columns of those names, and
        columns named __words, __x, __f, __raw, __both or __class, are replaced.
        """
        mine = [n for c, _, _ in self.models for n in (c, f"p_{c}")] + ["__words", "__x", "__f", *MADE]
        out = self.vocabulary.transform(docs.drop(*mine).withColumn("__words", words(F.col(text_col))))
        before: list[str] = []
        for category, model, threshold in self.models:
            out = _predict(model, _features(out, before), f"p_{category}")
            out = out.withColumn(category, F.col(f"p_{category}") >= threshold)
            before.append(f"p_{category}")
        return out.drop("__words", "__x", "__f")


def _features(df: DataFrame, before: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=["__x", *before], outputCol="__f").transform(df.drop("__f"))


def _predict(model: LogisticRegressionModel, df: DataFrame, name: str) -> DataFrame:
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("__both")[1]).drop(*MADE)


def _fit(df: DataFrame, label: str, reg: float) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol="__f", labelCol=label, rawPredictionCol="__raw",
                              probabilityCol="__both", predictionCol="__class", maxIter=20, tol=1e-4, regParam=reg,
                              standardization=False).fit(df)


def _threshold(oof: DataFrame, p: str, label: str) -> float:
    """The cut in hundredths at which the F1 of predictions is largest; 0.5 if nothing is positive."""
    bins = sorted((r["bin"], r["pos"], r["all"]) for r in oof.groupBy(
        F.floor(F.col(p) * 100).cast("int").alias("bin")).agg(
        F.sum(label).alias("pos"), F.count("*").alias("all")).collect())
    total = sum(b[1] for b in bins)
    if not total:
        return 0.5
    best, cut, hit, taken = 0.0, 0.5, 0.0, 0
    for bin_, pos, n in reversed(bins):
        hit, taken = hit + pos, taken + n
        if (f1 := 2 * hit / (taken + total)) > best:
            best, cut = f1, bin_ / 100
    return cut


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id",
              text_col: str = "text", most_rows: int = 12_000, folds: int = 3, vocab_size: int = 10_000,
              least_docs: int = 5, reg: float = 0.001) -> Chain:
    """Fit on the rows of ``docs`` that ``labels`` names (id and a 0/1 column per category, in order).

    Rows whose id or any label is null are not used; of several label rows of one id the largest
    label counts. A category with one class only gets a constant model. No labelled rows: an error.
    """
    rated = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        *(F.max(F.col(c).cast("double")).alias(f"y_{c}") for c in categories)).dropna()
    n = rated.count()
    if not n:
        raise NoLabels("no labelled rows to fit on")
    if n > most_rows:
        rated = rated.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < (most_rows << 40) // n)
    # Of bounded size: about ``most_rows`` ids and labels.
    rated = F.broadcast(rated)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = keep(texts.join(rated, "id").select(
        "*", words(F.col("text")).alias("__words"),
        F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(folds)).alias("fold")).drop("text"), "labelled")
    if not sample.limit(1).count():
        raise NoLabels("no labelled rows to fit on")
    # Ties at the end of the vocabulary go by the word, so that a repeated fit is the same.
    common = (sample.select(F.explode(F.array_distinct("__words")).alias("w")).groupBy("w")
              .agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)
              .orderBy(F.desc("n"), "w").limit(vocab_size).collect())
    vocabulary = CountVectorizerModel.from_vocabulary(
        [r["w"] for r in common] or ["^"], inputCol="__words", outputCol="__x").setBinary(True)
    train = keep(vocabulary.transform(sample).drop("__words").repartition(8, "id")
                 .sortWithinPartitions("id"), "features")
    models, before = [], []
    for c in categories:
        y, p = f"y_{c}", f"p_{c}"
        data = _features(train, before)
        model = _fit(data, y, reg)
        parts = []
        for f in range(folds):
            rest = data.where(F.col("fold") != f)
            parts.append(_predict(_fit(rest, y, reg), data.where(F.col("fold") == f), p)
                         if rest.limit(1).count() else _predict(model, data.where(F.col("fold") == f), p))
        oof = parts[0]
        for part in parts[1:]:
            oof = oof.unionByName(part)
        train = keep(oof.drop("__f"), "features")
        models.append((c, model, _threshold(train, p, y)))
        before.append(p)
    return Chain(vocabulary, models)


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with p_junk, junk, p_toxic and toxic, by a chain from poor quality to toxicity.

    Without any labelled row (an empty table of documents or labels) nothing can be told: probabilities are 0
    and no document is junk or toxic.
    """
    rated = labels.select("doc_id", (1 - F.col("quality")).alias("junk"), F.col("toxic"))
    try:
        return fit_chain(docs, rated, ["junk", "toxic"], **options).score(docs)
    except NoLabels:
        out = docs
        for c in ("junk", "toxic"):
            out = out.withColumn(f"p_{c}", F.lit(0.0)).withColumn(c, F.lit(False))
        return out


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "p_junk", "junk", "p_toxic", "toxic")
