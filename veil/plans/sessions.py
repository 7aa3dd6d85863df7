"""Whole conversations through the gate: memory, rules, decisions and numbers in the clean text."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.operators import session_gate as g
from veil.operators.rules import Rule
from veil.plans import duck
from veil.plans.registry import query
from veil.plans.tables import derived, with_derived
from veil.schema import PLACEHOLDER
from veil.session import cut

TERMS = (Rule("term", "project falcon"),)
SWITCHES = (Rule("term", "Project Falcon", label="Project"), Rule("category", "ACCOUNT"), Rule("show", "EMAIL"),
            Rule("allow", "meera"))
# The user reveals the card number in every fourth turn.
REVEAL = "t IN (3, 7) AND turn % 4 = 0"


def _sql(fine: str = "''", fixed: str = "false") -> str:
    """CTEs up to ``used`` (person hidden per turn), ``ranked`` (numbers) and ``done`` (clean text), from what is
    planted in the talks. ``fine``: a name that is never hidden; ``fixed``: no number can be revealed."""
    return f"""{with_derived('talks')},
named AS (SELECT conv_id, turn, nm || ' ' || sur AS value FROM talks WHERE t = 0
  UNION ALL SELECT conv_id, turn, nm FROM talks WHERE t = 3 AND nm <> {fine}),
mem AS (SELECT conv_id, value, min(turn) AS ft, lower(replace(value, ' ', '')) AS bare FROM named GROUP BY ALL),
forms AS (SELECT conv_id, form, min({{'t': ft, 'v': value}}) AS m FROM (SELECT conv_id, value, ft, unnest(list_distinct(
  list_concat([bare, reverse(bare)], string_split(lower(value), ' ')))) AS form FROM mem) GROUP BY ALL),
words AS (SELECT *, CASE t WHEN 0 THEN nm || ' ' || sur WHEN 1 THEN sur WHEN 2 THEN reverse(nm || sur) WHEN 3 THEN nm
  WHEN 5 THEN sur WHEN 8 THEN nm END AS word FROM talks),
used AS (SELECT w.*, CASE WHEN word = {fine} THEN NULL WHEN m.t < turn THEN m.v WHEN t = 0 OR t = 3 THEN word END AS value
  FROM words w LEFT JOIN forms f ON f.conv_id = w.conv_id AND f.form = lower(replace(w.word, ' ', ''))),
ranked AS (SELECT conv_id, value, min(turn) AS ft, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS n
  FROM used WHERE value IS NOT NULL GROUP BY conv_id, value),
open AS (SELECT conv_id, min(turn) AS r FROM talks WHERE {REVEAL} AND NOT ({duck.luhn('card')}) AND NOT ({fixed}) GROUP BY conv_id),
shown AS (SELECT u.*, CASE WHEN u.value IS NULL THEN text ELSE replace(text, word, '[PERSON_' || n || ']') END AS half,
    CASE WHEN {duck.luhn('card')} THEN '[CARD]' WHEN turn >= r THEN card ELSE '[ACCOUNT]' END AS card_ph
  FROM used u LEFT JOIN ranked k ON k.conv_id = u.conv_id AND k.value = u.value LEFT JOIN open o ON o.conv_id = u.conv_id)"""


def _clean(card: str, term: str, email: str) -> str:
    return (f"CASE t WHEN 3 THEN replace(half, card, {card}) WHEN 7 THEN replace(half, card, {card}) "
            f"WHEN 4 THEN replace(half, 'project falcon', '{term}') WHEN 5 THEN replace(half, h, {duck.describe('h')}) "
            f"WHEN 8 THEN replace(half, substr(h, 1, 9) || '@mail.example.com', {email}) ELSE half END")


def talks(spark, sf):
    return derived(spark, sf, "talks").select("conv_id", "turn", "t", "text", "card")


def decisions(turns):
    return turns.filter(REVEAL).select("conv_id", "turn", (F.instr("text", F.col("card")) - 1).alias("start"),
                                       F.lit(False).alias("hide"))


ALL = _clean("card_ph", "[TERM]", "'[EMAIL]'")


@query("s2_session_text", f"{_sql()} SELECT conv_id, turn, {ALL} AS clean FROM shown")
def _(spark, sf):
    """Memory, a term rule, decisions and numbers, in one pass of the gate."""
    turns = talks(spark, sf)
    return g.gate_session(turns, rules=TERMS, decisions=decisions(turns)).select("conv_id", "turn", "clean")


@query("h27_rules_text", f"""{_sql("'Meera'", "true")} SELECT conv_id, turn, {_clean("card_ph", "[PROJECT]",
       "substr(h, 1, 9) || '@mail.example.com'")} AS clean FROM shown""")
def _(spark, sf):
    """Rules in the gate: a category always hidden (decisions have no effect on it), one left alone, a name allowed."""
    turns = talks(spark, sf)
    return g.gate_session(turns, rules=SWITCHES, decisions=decisions(turns)).select("conv_id", "turn", "clean")


@query("c5_hidden_again", f"""{_sql()} SELECT u.conv_id, u.turn, word AS match, u.value, '[PERSON_' || n || ']' AS ph
  FROM used u JOIN ranked k ON k.conv_id = u.conv_id AND k.value = u.value
  WHERE u.turn > (SELECT min(f.m.t) FROM forms f WHERE f.conv_id = u.conv_id AND f.form = lower(replace(u.word, ' ', '')))""")
def _(spark, sf):
    """People hidden again, whole, by a part of the name or backwards."""
    found = g.session_findings(g.gate_session(talks(spark, sf), warnings=False))
    return found.filter("layer = 'memory' AND cat = 'NAME'").select("conv_id", "turn", "match", "value", "ph")


@query("c9_decided_items", f"""{_sql()} SELECT conv_id, turn, CAST(strpos(text, card) - 1 AS INT) AS start,
  {duck.luhn('card')} OR turn % 4 > 0 AS masked FROM talks LEFT JOIN open USING (conv_id)
  WHERE t IN (3, 7) AND (r IS NULL OR turn <= r)""")
def _(spark, sf):
    """Decisions on items: high ones stay hidden, and after a reveal the number is no longer flagged."""
    turns = talks(spark, sf)
    found = g.session_findings(g.gate_session(turns, decisions=decisions(turns), warnings=False))
    return found.filter("cat IN ('CARD', 'ACCOUNT')").select("conv_id", "turn", "start", "masked")


HIDDEN = _clean("CASE WHEN " + duck.luhn("card") + " THEN '[CARD]' ELSE '[ACCOUNT]' END", "[TERM]", "'[EMAIL]'")


def checked_sql(added: str = "''") -> str:
    """(conv_id, turn, clean, residual_count, verdict) of payloads to which something is added."""
    return f"""{_sql()}, leaky AS (SELECT conv_id, turn, {HIDDEN} || {added} AS clean FROM shown),
  flat AS (SELECT *, regexp_replace(lower(regexp_replace(clean, {duck.q(PLACEHOLDER)}, '|', 'g')), '[^a-z0-9|]', '', 'g') AS f FROM leaky),
  left_over AS (SELECT f.conv_id, f.turn, count(*) AS n FROM flat f JOIN ranked k ON k.conv_id = f.conv_id AND k.ft <= f.turn
    AND (contains(f, lower(replace(k.value, ' ', ''))) OR contains(f, reverse(lower(replace(k.value, ' ', ''))))) GROUP BY ALL),
  checked AS (SELECT conv_id, turn, clean, CAST(coalesce(n, 0) AS INT) AS residual_count,
    CASE WHEN n > 0 THEN 'quarantine' ELSE 'clean' END AS verdict FROM leaky LEFT JOIN left_over USING (conv_id, turn))"""


@query("s6_session_exit", checked_sql("CASE WHEN turn % 7 = 0 THEN ' x' || nm || '-' || sur || 'x' ELSE '' END")
       + " SELECT conv_id, turn, residual_count, verdict FROM checked")
def _(spark, sf):
    """The exit check on the session's memory; a name is put into every seventh payload, inside a longer word."""
    turns = derived(spark, sf, "talks").select("conv_id", "turn", "text", "nm", "sur")
    gated = g.gate_session(turns, rules=TERMS, warnings=False)
    leaky = gated.withColumn("clean", F.expr("if(turn % 7 = 0, concat(clean, ' x', nm, '-', sur, 'x'), clean)"))
    done = g.verify_session(cut(leaky))
    return done.select("conv_id", "turn", "residual_count",
                       F.when(F.col("residual_count") > 0, "quarantine").otherwise("clean").alias("verdict"))
