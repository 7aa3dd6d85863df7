"""Outgoing payloads, chat history and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.text import placeholder_tokens, strip

ACTION = r"(?im)ACTION:\s*(\w+)\s*\|\s*(.+)\s*$"


def build_payload(screens: DataFrame, files: DataFrame, questions: DataFrame,
                  keys: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """Screen block, file blocks, a rule, the question; joined by blank lines.

    Inputs carry ``keys`` and clean text: screens ``text``; files ``name, kind, text`` (finished
    ones); questions ``text``. Empty blocks are left out. Files keep the order of a column ``ord``
    (the order in which they were attached); without it they go by name.
    """
    block = lambda df, pos, name, text, at=F.lit(0): df.select(
        *keys, F.struct(F.lit(pos).alias("p"), at.cast("long").alias("a"), name.alias("n"),
                        text.alias("t")).alias("b"))
    at = F.col("ord") if "ord" in files.columns else F.lit(0)
    full = F.coalesce(F.col("text"), F.lit("")) != ""
    head = F.concat(F.lit("FILE: "), "name", F.lit(" ("), "kind", F.lit(")\n"), "text")
    parts = (block(screens.filter(full), 0, F.lit(""), F.concat(F.lit("SCREEN\n"), "text"))
             .unionByName(block(files.filter(full), 1, F.col("name"), head, at))
             .unionByName(block(questions, 3, F.lit(""), F.coalesce("text", F.lit("")))))
    got = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("b")).alias("b"))
    blocks = F.filter("b", lambda b: b["p"] < 3)
    question = F.filter("b", lambda b: b["p"] == 3)
    texts = lambda a: F.transform(a, lambda b: b["t"])
    rule = F.when(F.size(blocks) > 0, F.array(F.lit("---"))).otherwise(
        F.array().cast("array<string>"))
    return got.select(*keys, F.array_join(F.concat(texts(blocks), rule, texts(question)),
                                          "\n\n").alias("payload"))


def split_action(text: Column) -> tuple[Column, Column, Column]:
    """An answer's visible text, its action and its target (``-`` means none)."""
    found = text.rlike(ACTION)
    target = strip(F.regexp_extract(text, ACTION, 2))
    visible = F.when(found, strip(F.substring(text, F.lit(1), F.regexp_instr(
        text, F.lit(ACTION)) - 1))).otherwise(strip(text))
    return (visible, F.when(found, F.lower(F.regexp_extract(text, ACTION, 1))),
            F.when(found, F.nullif(target, F.lit("-"))))


def mock_answer(body: Column) -> Column:
    """A fixed reply that only reports bytes and placeholders."""
    found = F.array_distinct(placeholder_tokens(body))
    listed = F.when(F.size(found) > 0, F.concat(
        F.lit("Placeholders present: "), F.array_join(found, " "), F.lit("\n"))).otherwise(
        "No placeholders in this one.\n")
    return F.concat(F.lit("I received "), F.octet_length(body), F.lit(" bytes.\n"), listed,
                    F.lit("ACTION: none | -"))


def request_messages(turns: DataFrame, system: str, style: str = "flat", session: str = "conv_id",
                     turn: str = "turn", per_part: int = 100_000) -> DataFrame:
    """History as a chat request: system turn first, then the turns in order, as JSON.

    ``flat`` gives role and content; ``parts`` gives user/model roles with nested parts. A session
    that spans more than ``per_part`` turns continues in further rows (``part_no``); its first row has
    the system turn, whatever number its turns begin with.
    """
    model = F.col("role").isin("model", "assistant")
    part = F.floor(F.col(turn) / per_part).cast("int").alias("__part")
    if style == "flat":
        role = F.when(model, "assistant").otherwise(F.col("role"))
        msg = F.struct(role.alias("role"), F.col("text").alias("content"))
    else:
        role = F.when(model, "model").otherwise("user")
        msg = F.struct(role.alias("role"), F.array(F.struct(F.col("text").alias("text"))).alias("parts"))
    got = turns.groupBy(session, part).agg(F.array_sort(F.collect_list(
        F.struct(F.col(turn).alias("o"), msg.alias("m")))).alias("l"))
    # One row per part: the rank of a part within its session.
    nth = (F.row_number().over(Window.partitionBy(session).orderBy("__part")) - 1).cast("int")
    got = got.withColumn("part_no", nth)
    msgs = F.transform("l", lambda x: x["m"])
    if style == "flat":
        lead = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
        msgs = F.when(F.col("part_no") == 0, F.concat(lead, msgs)).otherwise(msgs)
    return got.select(session, "part_no", F.to_json(msgs).alias("messages"))


def topic_offers(texts: DataFrame, keys: tuple[str, ...] = ("conv_id", "turn"),
                 text: str = "text") -> DataFrame:
    """Words of topic warnings that could be hidden too: one low item per free occurrence."""
    stop = ("diagnosed", "my", "with", "and", "the", "a", "an", "i", "was", "is")
    topics = F.filter("warnings", lambda w: w["type"] == "topic")
    pairs = F.flatten(F.transform(topics, lambda w: F.transform(
        F.regexp_extract_all(w["text"], F.lit(r"[\p{L}\p{N}'-]+"), F.lit(0)),
        lambda x: F.struct(F.lower(x).alias("word"), w["topic"].alias("topic"), w["why"].alias("why")))))
    words = texts.select(*keys, F.col(text).alias("__t"), "items",
                         F.explode(F.array_distinct(pairs)).alias("w")).filter(
        ~F.col("w.word").isin(*stop))
    pieces = F.split(F.lower("__t"), F.concat(F.lit(r"\Q"), F.col("w.word"), F.lit(r"\E")), -1)
    zero = F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("o"))
    size = F.length("w.word")
    starts = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), zero, lambda z, g: F.struct(
        (z["p"] + F.length(g) + size).alias("p"),
        F.concat(z["o"], F.array(z["p"] + F.length(g))).alias("o")), lambda z: z["o"])
    hits = words.select(*keys, "__t", "items", "w", F.explode(starts).alias("start")).withColumn(
        "end", F.col("start") + F.length("w.word"))
    free = ~F.exists("items", lambda i: (F.col("start") < i["end"]) & (F.col("end") > i["start"]))
    return (hits.filter(free).select(
        *keys, "start", "end", F.substring("__t", F.col("start") + 1, F.length("w.word")).alias("match"),
        F.col("w.word").alias("value"), F.lit("HEALTH").alias("cat"),
        F.lit("Sensitive topic").alias("kind"), F.lit("low").alias("level"),
        F.lit("topic").alias("layer"), F.col("w.why").alias("ev"),
        F.concat(F.lit("["), F.coalesce("w.topic", F.lit("PRIVATE")), F.lit("_INFO]")).alias("ph"))
        .dropDuplicates([*keys, "start"]))
