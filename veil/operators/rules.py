"""User rules: the settings list, its upkeep, and the visual targets it asks for."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RULE_SCHEMA = "seq int, kind string, value string, label string, phrase string, qualifier string"

# Rule kinds that act on rows and columns.
GRID_KINDS = ("colname", "colindex", "row", "rowset", "firstrows", "lastrows")

# Regions covered in every picture without being asked.
BUILTIN_VISUAL = ("photograph", "QR code")

# Wordings for a region search, best first.
WORDINGS = {
    "photograph": ("photo of a person", "human face", "photograph"),
    "human face": ("human face", "photo of a person"),
    "QR code": ("barcode", "QR code"),
    "barcode": ("barcode", "QR code"),
}

# Words that name the same kind of column.
SYNONYMS = (
    ("name", "customer", "client", "employee", "person", "fullname"),
    ("phone", "mobile", "mobileno", "telephone", "contact", "cell", "phonenumber"),
    ("money", "amount", "salary", "price", "balance", "total", "pay", "cost", "income", "fee"),
    ("email", "mail", "emailid", "emailaddress"),
    ("address", "location", "street", "residence"),
    ("birth", "dob", "dateofbirth", "birthday", "birthdate"),
)


@dataclass(frozen=True)
class Rule:
    """One statement of the user. Settings, not data: a list of these fits any driver."""

    kind: str
    value: str = ""
    label: str = ""
    phrase: str = ""
    qualifier: str = ""


def column_words(rules: Iterable[Rule]) -> list[str]:
    """Header words that ``colname`` rules reach: the word itself and its synonyms."""
    words: dict[str, None] = {}
    for rule in rules:
        if rule.kind == "colname":
            word = "".join(ch for ch in rule.value.lower() if ch.isascii() and ch.isalnum())
            group = next((g for g in SYNONYMS if word in g), ())
            words.update(dict.fromkeys([word, *group]))
    return list(words)


def upsert_rules(log: DataFrame) -> DataFrame:
    """Statements in order (``seq``) to the rules in force.

    ``allow`` and ``term`` for the same word replace each other, so the last one wins; exact
    repeats count once, at their first place since the last change.
    """
    word = F.lower("value")
    paired = F.col("kind").isin("allow", "term")
    same = F.when(paired, F.concat(F.lit("word:"), word)).otherwise(F.concat_ws(
        "\x01", "kind", word, F.coalesce("phrase", F.lit("")), F.coalesce("qualifier", F.lit(""))))
    keyed = log.withColumn("__k", same)
    back = Window.partitionBy("__k").orderBy("seq")
    changed = keyed.withColumn("__new", ~F.col("kind").eqNullSafe(F.lag("kind").over(back)))
    newest = Window.partitionBy("__k").orderBy(F.desc("seq"))
    return (changed.filter("__new").withColumn("__rn", F.row_number().over(newest))
            .filter(F.col("__rn") == 1).drop("__k", "__new", "__rn"))


def remove_rules(rules: DataFrame, gone: DataFrame) -> DataFrame:
    """Set difference. A request (``gone``, one statement of the user) that removes nothing and names
    terms alone was about words that a detector hides: its terms become allow rules."""
    key = ["kind", "__v"]
    r = rules.withColumn("__v", F.lower("value"))
    g = gone.withColumn("__v", F.lower("value"))
    left = r.join(g.select(*key).distinct(), key, "left_anti").drop("__v")
    # Only where the whole request removed nothing and named terms alone.
    known = r.select(*key).distinct().withColumn("__hit", F.lit(True))
    whole = Window.partitionBy("__request")
    stays = F.max(F.col("__hit").isNotNull() | (F.col("kind") != "term")).over(whole)
    unhidden = (g.withColumn("__request", F.lit(0)).join(known, key, "left")
                .withColumn("__stays", stays).filter(~F.col("__stays"))
                .drop("__request", "__hit", "__stays"))
    known = rules.filter(F.col("kind") == "allow").select(F.lower("value").alias("__v"))
    allows = unhidden.join(known, "__v", "left_anti").dropDuplicates(["__v"]).withColumn(
        "kind", F.lit("allow")).drop("__v")
    return left.unionByName(allows, allowMissingColumns=True)


def visual_targets(rules: DataFrame) -> DataFrame:
    """Regions to look for: visual rules, and the built-in ones no plain rule already names."""
    spark = rules.sparkSession
    mine = rules.filter(F.col("kind") == "visual").select(
        "phrase", F.coalesce("qualifier", F.lit("")).alias("qualifier"),
        F.coalesce("label", "phrase").alias("label"), F.lit(False).alias("builtin"))
    base = spark.createDataFrame([(p,) for p in BUILTIN_VISUAL], "phrase string")
    extra = base.join(mine.filter(F.col("qualifier") == ""), "phrase", "left_anti").select(
        "phrase", F.lit("").alias("qualifier"), F.col("phrase").alias("label"),
        F.lit(True).alias("builtin"))
    return mine.unionByName(extra)


def phrasings(targets: DataFrame) -> DataFrame:
    """One row per question to ask, best first (``priority`` from 0): wordings for the region search, and at last
    the plain phrase for the search over all kinds of objects (``task``)."""
    table = F.create_map(*[x for k, v in WORDINGS.items()
                           for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    base = F.coalesce(F.try_element_at(table, F.col("phrase")), F.array("phrase"))
    asked = F.when(F.col("qualifier") != "", F.concat(
        F.array(F.concat_ws(" ", "qualifier", "phrase")), base)).otherwise(base)
    ask = lambda task, w: F.struct(F.lit(task).alias("task"), w.alias("wording"))
    every = F.concat(F.transform(asked, lambda w: ask("grounding", w)), F.array(ask("detection", F.col("phrase"))))
    return targets.select("*", F.posexplode(every).alias("priority", "__q")).select(
        *targets.columns, "priority", "__q.*")
