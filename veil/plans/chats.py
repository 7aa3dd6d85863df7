"""Queries over chat turns and single sentences: cues, sessions, memory, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions import secrets as sec
from veil.functions import spans as sp
from veil.functions.decode import from_hex
from veil.functions.text import (phrase_placeholder, placeholder_class, placeholder_tokens)
from veil.functions.urls import query_param, userinfo
from veil.operators import detect as d
from veil.operators import gate, metrics, payload, placeholders
from veil.operators.evaluation import span_outcomes, span_scores
from veil.operators.pages import paint_terms
from veil.operators.terms import match_memory
from veil.plans import duck
from veil.plans.registry import query
from veil.plans.tables import derive, derived, table, with_derived
from veil.session import cut

M = with_derived("messages")
S = with_derived("sentences")

# What the gate finds in the derived turns, from the planted truth.
ITEMS = f"""{M}, items AS (SELECT conv_id, turn, CAST(strpos(text, planted) - 1 AS INT) AS start, planted AS value,
  CASE WHEN cat = 'CARD' AND NOT ({duck.luhn('planted')}) THEN 'ACCOUNT' ELSE cat END AS cat,
  CASE WHEN cat = 'CARD' AND NOT ({duck.luhn('planted')}) THEN 'medium' ELSE 'high' END AS level,
  CASE WHEN cat = 'NAME' THEN 'Person' WHEN cat = 'PHONE' THEN 'Phone number'
    WHEN cat = 'SECRET' AND length(planted) = 9 THEN 'Password or secret'
    WHEN cat = 'SECRET' AND {duck.entropy('planted')} >= 3.0 THEN 'High-entropy string'
    WHEN cat = 'SECRET' THEN 'Named secret'
    WHEN {duck.luhn('planted')} THEN 'Payment card' ELSE 'Long number' END AS kind,
  CASE WHEN cat = 'NAME' THEN '[PERSON_1]' WHEN cat = 'PHONE' THEN '[PHONE]'
    WHEN cat = 'SECRET' THEN {duck.describe('planted')}
    WHEN {duck.luhn('planted')} THEN '[CARD]' ELSE '[ACCOUNT]' END AS ph
  FROM messages WHERE planted IS NOT NULL)"""
CLEAN = "CASE WHEN planted IS NULL THEN text ELSE replace(text, planted, ph) END"


def messages(spark, sf):
    return derived(spark, sf, "messages")


def gated(spark, sf):
    """Turns through the gate once."""
    return gate.sanitize(messages(spark, sf).select("conv_id", "turn", "text"), source="message")


def items(spark, sf):
    return gate.findings(gated(spark, sf), ("conv_id", "turn"))


@query("b7_masks_by_default", f"{ITEMS} SELECT level, true AS masked, count(*) AS n FROM items GROUP BY level")
def _(spark, sf):
    rows = gated(spark, sf).select(F.explode(F.expr(sp.each("items"))).alias("i"))
    return rows.groupBy(F.col("i.level").alias("level"), F.expr(sp.masks_by_default("i")).alias("masked")
                        ).agg(F.count(F.lit(1)).alias("n"))


@query("d2_hidden_kinds", f"{ITEMS} SELECT conv_id, turn, kind AS kinds FROM items")
def _(spark, sf):
    return metrics.hidden_kinds(items(spark, sf), ("conv_id", "turn"))


@query("s3_apply", f"{ITEMS} SELECT m.conv_id, m.turn, {CLEAN} AS clean FROM messages m LEFT JOIN items USING (conv_id, turn)")
def _(spark, sf):
    return gated(spark, sf).select("conv_id", "turn", "clean")


@query("f1_order_items", f"{ITEMS} SELECT m.conv_id, m.turn, coalesce(CAST(start AS VARCHAR), '') AS starts FROM messages m LEFT JOIN items USING (conv_id, turn)")
def _(spark, sf):
    ordered = F.expr(sp.order_items("items"))
    return gated(spark, sf).select("conv_id", "turn", F.array_join(
        F.transform(ordered, lambda i: i["start"].cast("string")), ",").alias("starts"))


@query("e5_resolve_overlaps", f"{with_derived('sentences')}, items AS ({duck.items('sentences', 'doc_id')}) SELECT doc_id, "
       f"CAST(unnest(k).s AS INT) AS start, unnest(k).v AS match FROM ({duck.kept('items', 'doc_id')})")
def _(spark, sf):
    layers = ("email", "card", "phone", "ip", "structure", "entropy")
    both = F.expr(sp.resolve_overlaps(f"concat({d.all_items('text', layers)}, {long_numbers()})"))
    return derived(spark, sf, "sentences").select("doc_id", F.inline(both)).select("doc_id", "start", "match")


def long_numbers() -> str:
    return sp.to_items(sp.find_spans("text", d.LONG_NUMBER), cat="ACCOUNT", kind="Long number",
                       level="medium", layer="shape", ev="many digits", ph="[ACCOUNT]")


@query("e1_number_placeholders", f"""{ITEMS}, first AS (SELECT conv_id, cat, lower(value) AS v, min(turn) AS t FROM items GROUP BY ALL)
  SELECT i.conv_id, i.turn, i.cat, i.value, number FROM items i JOIN (SELECT *, dense_rank() OVER
    (PARTITION BY conv_id, cat ORDER BY t) AS number FROM first) f
  ON i.conv_id = f.conv_id AND i.cat = f.cat AND lower(i.value) = f.v""")
def _(spark, sf):
    return placeholders.number_placeholders(items(spark, sf)).select("conv_id", "turn", "cat", "value", "number")


@query("e8_attach_once", f"{M} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS with_screen FROM messages")
def _(spark, sf):
    return placeholders.attach_once(messages(spark, sf).select("conv_id", "turn"))


@query("e9_session_epoch", f"""{M} SELECT conv_id, turn, CAST(sum(CASE WHEN turn % 8 = 5 THEN 1 ELSE 0 END) OVER
  (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS epoch FROM messages""")
def _(spark, sf):
    turns = messages(spark, sf).select("conv_id", "turn")
    return placeholders.session_epoch(turns, F.col("turn") % 8 == 5)


@query("c5_match_memory", f"""{ITEMS}, forms AS (SELECT conv_id, form, min({{'t': turn, 'v': value}}) AS m FROM (
    SELECT conv_id, turn, value, unnest(list_distinct(list_concat([b, reverse(b)], list_filter(
      regexp_extract_all(lower(value), '[a-z0-9]+'), lambda p: length(p) >= 4)))) AS form FROM (
      SELECT *, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') AS b FROM items)) GROUP BY ALL),
  runs AS (SELECT conv_id, turn, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1]),
      list_transform(range(1, len(w) - 2), lambda i: w[i] || w[i + 1] || w[i + 2] || w[i + 3]))) AS form
    FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM messages))
  SELECT conv_id, turn, form, m.v AS value, m.t AS first_turn, count(*) AS n FROM runs JOIN forms USING (conv_id, form)
  WHERE m.t < turn GROUP BY ALL""")
def _(spark, sf):
    memory = cut(items(spark, sf).select("conv_id", "value", "cat", F.col("turn").alias("first_turn")))
    hits = match_memory(messages(spark, sf), memory)
    form = F.regexp_replace(F.lower("match"), "[^a-z0-9]", "").alias("form")
    return hits.groupBy("conv_id", "turn", form, "value", "first_turn").agg(F.count(F.lit(1)).alias("n"))


# The reviewer reveals every third turn's findings.
DECISION = "turn % 3 <> 0"


def decided(spark, sf):
    found = cut(items(spark, sf))
    choices = found.select("conv_id", "turn", "start", F.expr(DECISION).alias("hide"))
    return gate.apply_decisions(found, choices)


@query("c9_apply_decisions", f"{ITEMS} SELECT conv_id, turn, start, level, level = 'high' OR {DECISION} AS masked FROM items")
def _(spark, sf):
    return decided(spark, sf).select("conv_id", "turn", "start", "level", "masked")


@query("s9_commit_decisions", f"{ITEMS} SELECT DISTINCT conv_id, lower(value) AS value FROM items WHERE level = 'medium' AND NOT ({DECISION})")
def _(spark, sf):
    return gate.commit_decisions(decided(spark, sf))


@query("c6_drop_allowed", f"""{ITEMS} SELECT conv_id, turn, start, value FROM items i WHERE NOT EXISTS (
  SELECT 1 FROM items a WHERE a.level = 'medium' AND NOT (a.turn % 3 <> 0) AND a.conv_id = i.conv_id AND lower(a.value) = lower(i.value))""")
def _(spark, sf):
    found = decided(spark, sf)
    return gate.drop_allowed(found, gate.commit_decisions(found)).select("conv_id", "turn", "start", "value")


@query("r8_allow_rule", f"{ITEMS} SELECT conv_id, turn, value FROM items WHERE lower(value) NOT IN ('meera', 'ravi')")
def _(spark, sf):
    found = items(spark, sf)
    rules = spark.createDataFrame([("Meera",), ("RAVI",)], "value string")
    return gate.drop_allowed(found, everywhere=rules).select("conv_id", "turn", "value")


@query("b12_needs_review", f"""{ITEMS}, r AS (SELECT m.conv_id, m.turn, i.level FROM messages m LEFT JOIN items i USING (conv_id, turn))
  SELECT count(*) AS turns, count(level) AS always, count(*) FILTER (level = 'medium') AS unsure, CAST(0 AS BIGINT) AS never FROM r""")
def _(spark, sf):
    out = gated(spark, sf).withColumn("ner_ok", F.lit(True))
    n = lambda m: F.sum(F.when(gate.needs_review(m), 1).otherwise(0)).cast("long").alias(m)
    return out.agg(F.count(F.lit(1)).alias("turns"), n("always"), n("unsure"), n("never"))


@query("h12_secret", f"{M} SELECT conv_id, turn, planted AS match, {duck.describe('planted')} AS ph FROM messages WHERE turn % 8 = 4")
def _(spark, sf):
    found = F.inline(F.expr(sec.finish_items(d.detect_secret("text"))))
    return messages(spark, sf).select("conv_id", "turn", found).select("conv_id", "turn", "match", "ph")


@query("h13_ordinary_english", f"{M} SELECT text, count(*) AS n, planted IS NULL AS untouched FROM messages GROUP BY ALL")
def _(spark, sf):
    plain = messages(spark, sf).select("text")
    clean = gate.sanitize(plain.withColumn("raw", F.col("text")), warnings=False)
    return clean.groupBy("text", (F.col("raw") == F.col("clean")).alias("untouched")).agg(F.count(F.lit(1)).alias("n"))


@query("g5_fold_leet", f"{M} SELECT conv_id, turn, translate(lower(text), '@0135$7', 'aolesst') AS folded FROM messages")
def _(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", F.expr(sec.fold_leet(sec.lower_ascii("text"))).alias("folded"))


@query("g6_edit_distance", f"""{M}, w AS (SELECT unnest(string_split(text, ' ')) AS word FROM messages)
  SELECT word, least(levenshtein(word, 'password'), 3) AS edits, count(*) AS n FROM w WHERE levenshtein(word, 'password') <= 2 GROUP BY ALL""")
def _(spark, sf):
    words = messages(spark, sf).select(F.explode(F.split("text", " ")).alias("word"))
    near = words.withColumn("edits", F.levenshtein("word", F.lit("password"), 2)).filter(F.col("edits") >= 0)
    return near.groupBy("word", F.col("edits").cast("long").alias("edits")).agg(F.count(F.lit(1)).alias("n"))


@query("g7_fuzzy_cues", f"{M} SELECT conv_id, turn, CAST(strpos(text, w) - 1 AS INT) AS start, w AS cue FROM (SELECT *, CASE turn % 8 "
       "WHEN 4 THEN 'oassword' WHEN 5 THEN 'password' END AS w FROM messages) WHERE w IS NOT NULL")
def _(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", F.inline(F.expr(sec.find_cues("text")))).select(
        "conv_id", "turn", F.col("s").alias("start"), F.col("v").alias("cue"))


@query("g8_entropy", f"{M} SELECT planted, round({duck.entropy('planted')}, 6) AS bits FROM messages WHERE planted IS NOT NULL")
def _(spark, sf):
    return messages(spark, sf).filter(F.col("planted").isNotNull()).select(
        "planted", F.round(F.expr(sec.entropy("planted")), 6).alias("bits"))


CLASSES = "".join(f" + CASE WHEN regexp_matches(planted, '{c}') THEN 1 ELSE 0 END" for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
LETTER = "regexp_matches(planted, '[A-Za-z]')"


@query("g9_strength", f"""{M} SELECT planted, CAST(greatest(0, 0{CLASSES} + CASE WHEN length(planted) >= 8 THEN 1 ELSE 0 END
  + CASE WHEN length(planted) >= 12 THEN 1 ELSE 0 END + CASE WHEN {duck.entropy('planted')} >= 2.5 THEN 1 ELSE 0 END
  + CASE WHEN {LETTER} AND regexp_matches(planted, '[0-9]') THEN 1 ELSE 0 END
  + CASE WHEN {LETTER} AND regexp_matches(planted, '[^A-Za-z0-9]') THEN 1 ELSE 0 END
  - CASE WHEN {duck.word_like('planted')} THEN 3 ELSE 0 END) AS INT) AS score FROM messages WHERE planted IS NOT NULL""")
def _(spark, sf):
    return messages(spark, sf).filter(F.col("planted").isNotNull()).select(
        "planted", F.expr(sec.strength("planted")).cast("int").alias("score"))


@query("g10_describe_secret", f"{M} SELECT planted, {duck.describe('planted')} AS ph FROM messages WHERE planted IS NOT NULL")
def _(spark, sf):
    return messages(spark, sf).filter("planted IS NOT NULL").select(
        "planted", F.expr(sec.describe_secret("planted")).alias("ph"))


def planted(where: str) -> str:
    return f"{S} SELECT doc_id, CAST(strpos(text, planted) - 1 AS INT) AS start, planted AS match FROM sentences WHERE {where}"


def sentence_items(spark, sf, detector, cats=None):
    rows = derived(spark, sf, "sentences").select("doc_id", F.inline(F.expr(detector("text"))))
    return (rows.filter(F.col("cat").isin(*cats)) if cats else rows).select("doc_id", "start", "match")


VERHOEFF = """list_reduce(list_prepend('00', list_transform(range(1, 13), lambda i: substr(reverse(v), i, 1) || CAST((i - 1) % 8 AS VARCHAR))),
  lambda c, x: substr('0123456789123406789523401789563401289567401239567859876043216598710432765982104387659321049876543210',
   CAST(substr(c, 1, 1) AS INT) * 10 + CAST(substr('01234567891576283094580379614289160435279453126870428657390127938064157046913258',
   CAST(substr(x, 2, 1) AS INT) * 10 + CAST(substr(x, 1, 1) AS INT) + 1, 1) AS INT) + 1, 1) || '0') = '00'"""

for name, detector, cats, where in (
        ("h4_pan", d.detect_pan, None, "t = 1"),
        ("h5_ifsc", d.detect_ifsc, None, "t = 2"),
        ("h6_upi", d.detect_upi, None, "t = 3"),
        ("h10_coord", d.detect_coord, None, "t = 4"),
        ("h11_codes", d.detect_codes, None, "t IN (5, 6, 7, 8)"),
        ("h14_api_keys", d.detect_keys, None, "t = 11"),
        ("h16_cue_slots", d.detect_secret, None, "t IN (9, 10)"),
        ("h18_people", d.detect_people, None, "t IN (12, 13)"),
        ("h19_personal", d.detect_personal, None, "t IN (14, 15, 16)"),
        ("h20_address", d.detect_address, None, "t = 17"),
        ("h23_encoded", d.detect_encoded, None, "t = 20")):
    query(name, planted(where))(
        lambda spark, sf, detector=detector, cats=cats: sentence_items(spark, sf, detector, cats))


def digit_runs(where: str) -> str:
    return f"SELECT doc_id, s AS start, v AS match FROM ({duck.spans('sentences', 'doc_id', 'text', '[0-9]+')}) WHERE {where}"


@query("h2_aadhaar", f"{S} {digit_runs(f'length(v) = 12 AND v >= {duck.q(chr(50))} AND {VERHOEFF}')}")
def _(spark, sf):
    return sentence_items(spark, sf, d.detect_aadhaar)


@query("h22_accounts", f"{planted('t IN (18, 19)')} UNION ALL {digit_runs('length(v) BETWEEN 11 AND 18')}")
def _(spark, sf):
    return sentence_items(spark, sf, d.detect_accounts)


@query("h3_ocr_groups", f"{M} SELECT conv_id, turn, substr(planted, 1, 4) || ' ' || substr(planted, 5, 3) || ' ' || substr(planted, 9, 4) AS match "
       "FROM messages WHERE turn % 8 IN (2, 6)")
def _(spark, sf):
    """A digit lost in reading: groups of 4, 3 and 4."""
    turns = messages(spark, sf).withColumn("text", F.expr(
        "CASE WHEN cat = 'CARD' THEN 'id ' || substr(planted, 1, 4) || ' ' || substr(planted, 5, 3) || ' ' || substr(planted, 9, 4) ELSE text END"))
    return turns.select("conv_id", "turn", F.inline(F.expr(d.detect_grouped("text")))).select("conv_id", "turn", "match")


@query("h24_memory_hits", f"""{ITEMS}, mem AS (SELECT conv_id, value, min(turn) AS t FROM items WHERE cat = 'NAME' GROUP BY ALL)
  SELECT m.conv_id, m.turn, mem.value FROM messages m JOIN mem ON m.conv_id = mem.conv_id AND m.turn > mem.t
    AND list_contains(string_split(m.text, ' '), mem.value)""")
def _(spark, sf):
    """The hits of names; the values of all categories are remembered."""
    memory = cut(items(spark, sf).select("conv_id", "value", "cat", F.col("turn").alias("first_turn")))
    return match_memory(messages(spark, sf), memory).filter("cat = 'NAME'").select("conv_id", "turn", "value")


@query("h25_topic_warnings", f"{S} SELECT doc_id, 'HEALTH' AS topic, 'diagnosed with diabetes' AS text FROM sentences WHERE t = 21")
def _(spark, sf):
    return derived(spark, sf, "sentences").select("doc_id", F.inline(F.expr(d.topic_warnings("text")))).select("doc_id", "topic", "text")


@query("d10_warning_line", f"{S} SELECT doc_id, CASE WHEN t = 21 THEN 'mentions health: diagnosed with diabetes' ELSE '' END AS line FROM sentences")
def _(spark, sf):
    return derived(spark, sf, "sentences").withColumn("warnings", F.expr(d.topic_warnings("text"))).select(
        "doc_id", metrics.warning_line().alias("line"))


@query("g24_topic_offers", f"""{S} SELECT doc_id, CAST(strpos(text, w) - 1 AS INT) AS start, w AS match, '[HEALTH_INFO]' AS ph
  FROM sentences CROSS JOIN (VALUES ('diabetes')) v(w) WHERE t = 21""")
def _(spark, sf):
    texts = gate.analyze(derived(spark, sf, "sentences").select("doc_id", "text"))
    return payload.topic_offers(texts, ("doc_id",)).select("doc_id", "start", "match", "ph")


@query("h27_rule_terms", f"{M} SELECT conv_id, turn, CAST(strpos(text, 'Priya') - 1 AS INT) AS start FROM messages WHERE text LIKE '%Priya%'")
def _(spark, sf):
    from veil.operators.terms import match_terms

    rules = spark.createDataFrame([("priya",), ("Project Falcon",)], "term string")
    turns = messages(spark, sf).withColumn("key", F.struct("conv_id", "turn"))
    return match_terms(turns, rules, "key").select("key.conv_id", "key.turn", "start")


# Sentences that hold nothing a page covers itself: a valid national number, a tax number, a bank code, the warnings.
NUMBER = "CASE WHEN t = 0 THEN planted ELSE '000000000000' END"
UNCOVERED = f"(t IN (1, 2, 21, 22, 23) OR (t = 0 AND {VERHOEFF.replace('reverse(v)', f'reverse({NUMBER})')}))"


@query("b13_paint_terms", f"""{S}, parts AS (SELECT doc_id, trim(unnest(CASE WHEN t = 17 THEN string_split_regex(planted, '\\s*[,\\n]\\s*')
    ELSE [planted] END)) AS term FROM sentences WHERE NOT ({UNCOVERED}))
  SELECT doc_id, term FROM parts WHERE length(term) >= 2""")
def _(spark, sf):
    rows = derived(spark, sf, "sentences")
    found = gate.findings(gate.sanitize(rows.select("doc_id", "text"), warnings=False), ("doc_id",))
    return paint_terms(found, "doc_id", most=300).select("doc_id", "term")


@query("d13_read_total", f"""{ITEMS}, elements AS ({with_derived('elements')[len('WITH elements AS ('):-1]}),
  both_ AS (SELECT page_id FROM elements WHERE type = 'password' OR autocomplete LIKE 'cc-%' UNION ALL SELECT conv_id FROM items)
  SELECT page_id, count(*) AS total FROM both_ GROUP BY page_id""")
def _(spark, sf):
    from veil.operators.elements import classify_fields

    page = classify_fields(derived(spark, sf, "elements")).filter("tier = 0").select("page_id")
    return metrics.read_total(page, items(spark, sf).select(F.col("conv_id").alias("page_id")), "page_id")


FILES = "SELECT c_custkey AS conv_id, c_name AS name, 'text' AS kind, c_mktsegment AS text FROM {customer}"


@query("d11_build_payload", f"""{ITEMS}, clean AS (SELECT m.conv_id, m.turn, {CLEAN} AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
    FROM messages m LEFT JOIN items USING (conv_id, turn))
  SELECT conv_id, turn, CASE WHEN rn = 1 THEN 'SCREEN' || chr(10) || 'PAGE: home of ' || CAST(conv_id AS VARCHAR) || chr(10) || chr(10)
    || 'FILE: ' || c_name || ' (text)' || chr(10) || c_mktsegment || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || text AS payload
  FROM clean JOIN customer ON conv_id = c_custkey""")
def _(spark, sf):
    clean = cut(gated(spark, sf).select("conv_id", "turn", F.col("clean").alias("text")))
    first = placeholders.attach_once(clean)
    customers = derive(spark, sf, FILES, "customer")
    first = first.join(customers.select("conv_id"), "conv_id", "left_semi")
    opening = first.filter("with_screen").select("conv_id", "turn")
    screens = opening.withColumn("text", F.concat(F.lit("PAGE: home of "), "conv_id"))
    return payload.build_payload(screens, opening.join(customers, "conv_id"), first.select("conv_id", "turn", "text"))


@query("d12_last_user_turn", "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _(spark, sf):
    return placeholders.last_user_turn(table(spark, sf, "conversations"))


@query("e13_drop_unanswered", """SELECT conv_id, turn, role FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt
  FROM conversations) WHERE NOT (nxt IS NULL AND role = 'user')""")
def _(spark, sf):
    return placeholders.drop_unanswered(table(spark, sf, "conversations")).select("conv_id", "turn", "role")


@query("g25_request_messages", """SELECT conv_id, CAST(0 AS INT) AS part_no, CAST(to_json(list_prepend({'role': 'system', 'content': 'Be brief.'},
  list({'role': CASE WHEN role IN ('model', 'assistant') THEN 'assistant' ELSE role END, 'content': text} ORDER BY turn))) AS VARCHAR) AS messages
  FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    return payload.request_messages(table(spark, sf, "conversations"), "Be brief.")


ANSWER = "SELECT turn, text || chr(10) || 'ACTION: ' || CASE WHEN turn % 2 = 0 THEN 'Scroll | row ' || CAST(turn AS STRING) ELSE 'none | -' END AS text FROM messages"


@query("g18_split_action", f"{M}, a AS ({ANSWER}) SELECT turn, regexp_extract(text, '^(.*)\\nACTION', 1) AS visible, "
       "CASE WHEN turn % 2 = 0 THEN 'scroll' ELSE 'none' END AS action, CASE WHEN turn % 2 = 0 THEN 'row ' || CAST(turn AS VARCHAR) END AS target FROM a")
def _(spark, sf):
    answers = spark.sql(ANSWER.replace("messages", "{messages}"), messages=messages(spark, sf))
    visible, action, target = payload.split_action(F.col("text"))
    return answers.select("turn", visible.alias("visible"), action.alias("action"), target.alias("target"))


@query("g19_mock_answer", f"{ITEMS} SELECT m.turn, 'I received ' || strlen({CLEAN}) || ' bytes.' || chr(10) || CASE WHEN ph IS NULL THEN "
       "'No placeholders in this one.' ELSE 'Placeholders present: ' || ph END || chr(10) || 'ACTION: none | -' AS answer "
       "FROM messages m LEFT JOIN items USING (conv_id, turn)")
def _(spark, sf):
    return gated(spark, sf).select("turn", payload.mock_answer(F.col("clean")).alias("answer"))


@query("g16_placeholder_class", f"{ITEMS} SELECT {duck.PLACEHOLDER_CLASS} AS class, count(*) AS n FROM items GROUP BY 1")
def _(spark, sf):
    return items(spark, sf).groupBy(placeholder_class(F.col("ph")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("g17_placeholder_tokens", f"{ITEMS} SELECT m.conv_id, m.turn, coalesce(ph, '') AS tokens FROM messages m LEFT JOIN items USING (conv_id, turn)")
def _(spark, sf):
    tokens = F.array_join(placeholder_tokens(F.col("clean")), " ").alias("tokens")
    return gated(spark, sf).select("conv_id", "turn", tokens)


@query("g12_phrase_placeholder", "SELECT o_orderkey, '[' || replace(upper(lower(o_orderpriority) || ' code'), ' ', '_') || ']' AS ph FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", phrase_placeholder(
        F.concat(F.lower("o_orderpriority"), F.lit(" code"))).alias("ph"))


URLS = """SELECT o_orderkey AS k, 'https://bob:' || md5(CAST(o_orderkey AS STRING)) || '@h' || CAST(o_custkey AS STRING)
  || '.example.com/a?x=1&token=t' || CAST(o_orderkey AS STRING) || 'zz#top' AS url FROM {orders}"""


@query("g14_url_secrets", "SELECT o_orderkey AS k, 'bob:' || md5(CAST(o_orderkey AS VARCHAR)) AS userinfo, 't' || o_orderkey || 'zz' AS token FROM orders")
def _(spark, sf):
    return derive(spark, sf, URLS, "orders").select("k", userinfo(F.col("url")).alias("userinfo"),
                                                    query_param(F.col("url"), "token").alias("token"))


@query("g15_decoders", f"{S} SELECT doc_id, 'password=' || CAST(doc_id AS VARCHAR) || 'x9' AS decoded FROM sentences WHERE t = 20")
def _(spark, sf):
    decoded = derived(spark, sf, "sentences").select("doc_id", F.expr(from_hex("planted")).alias("decoded"))
    return decoded.filter("decoded IS NOT NULL")


@query("f5_distinct_in_order", f"""{M} SELECT conv_id, turn, array_to_string(list_reduce(string_split(text, ' '), lambda a, x:
  CASE WHEN list_contains(a, x) THEN a ELSE list_append(a, x) END, []::VARCHAR[]), ' ') AS words FROM messages""")
def _(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("e3_cap_per_group", f"{M} SELECT conv_id, turn FROM messages QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3")
def _(spark, sf):
    from veil.operators.blocks import first_rows

    return first_rows(messages(spark, sf).select("conv_id", "turn"), ["conv_id"], ["turn"], 3)


def name_model():
    """Stand-in for a text model: capitalised words are people."""
    import re

    word = re.compile(r"[A-Z][a-z]{2,}")
    return lambda texts: [[(m.start(), m.end(), "PERSON", 0.9) for m in word.finditer(t)] for t in texts]


@query("h21_model_spans", f"{M} SELECT turn, CAST(strpos(text, nm) - 1 AS INT) AS start, nm AS match, 'medium' AS level FROM (SELECT *, "
       "regexp_extract(text, '[A-Z][a-z]{2,}') AS nm FROM messages) WHERE nm <> ''")
def _(spark, sf):
    from veil.operators.model import model_items, run_model

    texts = messages(spark, sf).select("turn", "text")
    found = model_items(texts, run_model(texts, name_model, "turn"), ("turn",), "text")
    return found.select("turn", F.col("i.start").alias("start"), F.col("i.match").alias("match"), F.col("i.level").alias("level"))


# What the gate finds in the derived turns against what was planted there.
RIGHT = f"(CASE WHEN cat = 'CARD' THEN {duck.luhn('planted')} ELSE true END)"


def planted_spans(rows):
    at = F.expr("locate(planted, text)")
    return rows.filter("planted IS NOT NULL").select(
        "conv_id", "turn", (at - 1).alias("start"), (at - 1 + F.length("planted")).alias("end"), "cat")


@query("d9_span_scores", f"""{M}, r AS (SELECT cat, {RIGHT} AS ok FROM messages WHERE planted IS NOT NULL)
  SELECT cat, count(*) AS positives, count(*) FILTER (ok) AS caught, CAST(0 AS BIGINT) AS wide,
    count(*) FILTER (NOT ok) AS wrong_category, CAST(0 AS BIGINT) AS cut_short, CAST(0 AS BIGINT) AS missed,
    CAST(0 AS BIGINT) AS false_alarm, count(*) FILTER (ok) / count(*) AS recall, count(*) FILTER (ok) / count(*) AS precision
  FROM r GROUP BY cat""")
def _(spark, sf):
    """The gate on planted truth: every value is hidden whole, nothing else is; card numbers whose check digit
    is wrong are called accounts."""
    found = items(spark, sf).select("conv_id", "turn", "start", "end", "cat")
    return span_scores(span_outcomes(found, planted_spans(messages(spark, sf)), ("conv_id", "turn")))


@query("d9_span_outcomes", f"""{M}, p AS (SELECT *, CAST(strpos(text, planted) - 1 AS INT) AS s, CAST(length(planted) AS INT) AS n,
    {RIGHT} AS ok FROM messages)
  SELECT conv_id, turn, CASE turn % 5 WHEN 1 THEN s - 2 WHEN 2 THEN s + 1 ELSE s END AS start,
    CASE turn % 5 WHEN 2 THEN s + n - 1 ELSE s + n END AS "end", CASE WHEN turn % 5 = 3 AND NOT ok THEN 'ACCOUNT' ELSE cat END AS cat,
    CASE turn % 5 WHEN 1 THEN 'cut_short' WHEN 3 THEN 'false_alarm' ELSE CASE WHEN NOT ok THEN 'wrong_category'
      WHEN turn % 5 = 2 THEN 'wide' ELSE 'caught' END END AS outcome FROM p WHERE planted IS NOT NULL
  UNION ALL SELECT conv_id, turn, CAST(0 AS INT), CAST(3 AS INT), 'NAME', 'missed' FROM p WHERE planted IS NULL""")
def _(spark, sf):
    """Truth moved on purpose, so that every outcome occurs: begun two characters earlier, one shorter at both
    ends, left out, and planted where nothing is."""
    turns = messages(spark, sf)
    kind = F.col("turn") % 5
    shift = lambda c, on, by: F.when(kind == on, F.col(c) + by).otherwise(F.col(c))
    moved = (planted_spans(turns).filter(kind != 3).withColumn("start", shift("start", 1, -2))
             .withColumn("start", shift("start", 2, 1)).withColumn("end", shift("end", 2, -1)))
    none = turns.filter("planted IS NULL").select(
        "conv_id", "turn", F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("NAME").alias("cat"))
    found = items(spark, sf).select("conv_id", "turn", "start", "end", "cat")
    return span_outcomes(found, moved.unionByName(none), ("conv_id", "turn"))
