"""Queries over rule statements, delimited files and readings of a text."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions.normalize import normalize, spelled_digits, unspace
from veil.operators import gate, rules
from veil.operators.detect import detect_backwards
from veil.plans.chats import CLEAN, ITEMS, messages
from veil.plans.registry import query
from veil.plans.tables import derive, oracle
from veil.session import work_dir
from veil.sources.files import read_grid

# A statement of the user per customer; words come back, also as the other kind.
LOG = """SELECT CAST(c_custkey AS INT) AS seq, CASE c_custkey % 4 WHEN 0 THEN 'colname' WHEN 1 THEN 'allow' ELSE 'term' END AS kind,
  CASE c_custkey % 3 WHEN 0 THEN 'Word' ELSE 'word' END || CAST((c_custkey * 7) % 41 AS STRING) AS value, '' AS label,
  '' AS phrase, '' AS qualifier FROM {customer}"""
IN_FORCE = f"""log AS ({oracle(LOG)}), keyed AS (SELECT *, CASE WHEN kind = 'colname' THEN 'c' ELSE 'w' END || lower(value) AS k FROM log),
  changed AS (SELECT * FROM keyed QUALIFY kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY k ORDER BY seq)),
  rules AS (SELECT * FROM changed QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1)"""


def in_force(spark, sf):
    return rules.upsert_rules(derive(spark, sf, LOG, "customer"))


@query("f6_upsert_rules", f"WITH {IN_FORCE} SELECT seq, kind, value FROM rules")
def _(spark, sf):
    """Of allow and term statements about one word the last holds; repeats count once, at their first place."""
    return in_force(spark, sf).select("seq", "kind", "value")


@query("f7_remove_rules", f"""WITH {IN_FORCE}, gone AS (SELECT 'word' || s_suppkey AS value FROM supplier)
  SELECT seq, kind, value FROM rules WHERE NOT (kind = 'term' AND lower(value) IN (SELECT value FROM gone))""")
def _(spark, sf):
    """A request that removes something: the terms named after suppliers go, the rest stays."""
    gone = derive(spark, sf, "SELECT 'term' AS kind, 'WORD' || CAST(s_suppkey AS STRING) AS value FROM {supplier}", "supplier")
    return rules.remove_rules(in_force(spark, sf), gone).select("seq", "kind", "value")


@query("f7_unhide_terms", f"""WITH {IN_FORCE}, gone AS (SELECT DISTINCT 'shown' || s_suppkey AS value FROM supplier)
  SELECT seq, kind, value FROM rules UNION ALL SELECT NULL, 'allow', value FROM gone""")
def _(spark, sf):
    """A request that removes nothing and names terms alone: its terms become allow rules."""
    gone = derive(spark, sf, "SELECT 'term' AS kind, 'shown' || CAST(s_suppkey AS STRING) AS value FROM {supplier}", "supplier")
    return rules.remove_rules(in_force(spark, sf), gone).select("seq", "kind", "value")


# A region rule per part: every seventh names a kind that is looked for anyway, with a qualifier or without.
VISUAL = """SELECT 'visual' AS kind, '' AS value, CASE p_partkey % 7 WHEN 0 THEN 'photograph' ELSE 'mark ' || p_brand END AS phrase,
  CASE p_partkey % 2 WHEN 0 THEN p_type ELSE '' END AS qualifier, CAST(p_partkey AS STRING) AS label FROM {part}"""


@query("c8_visual_targets", f"""WITH mine AS ({oracle(VISUAL)}) SELECT phrase, qualifier, label, false AS builtin FROM mine
  UNION ALL SELECT p, '', p, true FROM (VALUES ('photograph'), ('QR code')) AS b(p)
  WHERE p NOT IN (SELECT phrase FROM mine WHERE qualifier = '')""")
def _(spark, sf):
    return rules.visual_targets(derive(spark, sf, VISUAL, "part")).select("phrase", "qualifier", "label", "builtin")


@query("r9_phrasings", f"""WITH mine AS ({oracle(VISUAL)}), asked AS (SELECT label, phrase, list_concat(
    CASE WHEN qualifier <> '' THEN [qualifier || ' ' || phrase] ELSE [] END,
    CASE phrase WHEN 'photograph' THEN ['photo of a person', 'human face', 'photograph'] ELSE [phrase] END) AS w FROM mine)
  SELECT label, CAST(i - 1 AS INT) AS priority, CASE WHEN i <= len(w) THEN 'grounding' ELSE 'detection' END AS task,
    CASE WHEN i <= len(w) THEN w[i] ELSE phrase END AS wording FROM (SELECT *, unnest(range(1, len(w) + 2)) AS i FROM asked)""")
def _(spark, sf):
    """Wordings for the region search, best first, and the plain phrase for the object search at last."""
    mine = rules.visual_targets(derive(spark, sf, VISUAL, "part")).filter("NOT builtin")
    return rules.phrasings(mine).select("label", "priority", "task", "wording")


# A delimited file per nation, written and read again; names hold separators, quotes and line ends.
CELLS = """SELECT c_nationkey AS nation, c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN ', Ltd' WHEN 1 THEN ' "x"'
  WHEN 2 THEN chr(10) || 'second line' ELSE '' END AS name, c_mktsegment AS segment FROM {customer}"""


@query("a2_read_grid", f"WITH cells AS ({oracle(CELLS)}) SELECT nation, CAST(c_custkey AS VARCHAR) AS id, name, segment FROM cells")
def _(spark, sf):
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), quoted(F.col("name")), quoted(F.col("segment")))
    path = work_dir(spark, "csv")
    rows = derive(spark, sf, CELLS, "customer").select("nation", line.alias("value"))
    rows.repartition("nation").write.partitionBy("nation").text(path)
    cells = read_grid(spark, f"{path}/nation=*/*.txt")
    nation = F.regexp_extract("file_id", "nation=([0-9]+)", 1).cast("int")
    return cells.select(nation.alias("nation"), *[F.col("cells")[i].alias(n) for i, n in enumerate(("id", "name", "segment"))])


@query("g2_normal_reading", f"{ITEMS} SELECT m.conv_id, m.turn, text AS normal, {CLEAN} AS clean FROM messages m LEFT JOIN items USING (conv_id, turn)")
def _(spark, sf):
    """Invisible characters between words and look-alike letters in them: read, found and hidden as if plain."""
    odd = F.expr("concat('\\u200b', translate(replace(text, ' ', ' \\u2060'), 'aeoA', '\\u0430\\u0435\\u043e\\u0391'))")
    turns = messages(spark, sf).select("conv_id", "turn", odd.alias("text"))
    read = turns.withColumn("normal", F.expr(normalize("text")))
    return gate.sanitize(read, warnings=False).select("conv_id", "turn", "normal", "clean")


@query("g3_spelled_digits", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS digits, 'k' || o_orderkey AS joined FROM orders")
def _(spark, sf):
    """Digits as words, two equal ones in a row as `double`; and a key spelled character by character."""
    words = "array('zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine')"
    runs = "regexp_extract_all(cast(o_orderkey AS string), '(00|11|22|33|44|55|66|77|88|99|[0-9])', 0)"
    word = f"concat(if(length(r) = 2, 'double ', ''), element_at({words}, cast(left(r, 1) AS int) + 1))"
    rows = derive(spark, sf, "SELECT o_orderkey FROM {orders}", "orders").select(
        "o_orderkey", F.expr(f"array_join(transform({runs}, r -> {word}), ' ')").alias("said"),
        F.expr("array_join(split(concat('k', o_orderkey), ''), ' ')").alias("spaced"))
    return rows.select("o_orderkey", F.expr(spelled_digits("said")).alias("digits"), F.expr(unspace("spaced")).alias("joined"))


@query("h26_backwards", "SELECT c_custkey, CAST(6 AS INT) AS start, reverse('c' || c_custkey || '@mail.example.com') AS match FROM customer")
def _(spark, sf):
    """E-mail addresses written backwards."""
    rows = derive(spark, sf, "SELECT c_custkey, 'reach ' || reverse('c' || CAST(c_custkey AS STRING) || '@mail.example.com') || ' now' AS text FROM {customer}", "customer")
    return rows.select("c_custkey", F.inline(F.expr(detect_backwards("text")))).select("c_custkey", "start", "match")
