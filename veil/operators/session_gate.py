"""The gate over whole conversations: memory, rules, decisions and numbers reach the clean text.

A turn depends on the turns before it in four ways: a value hidden earlier is hidden again, in any form;
a value the user revealed is left alone from then on; equal values share a number; and a payload
must not hold anything hidden so far. None of these needs the turns one after the other. What a session
has hidden is a table of first appearances (session, value, turn), what it has revealed another, and a
turn takes from them the rows with a smaller turn: equi joins of small rows, so that a conversation
with a third of all turns is spread like any other. Texts are read twice (detection, remembered forms)
and joined once with the items of their own turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions import spans as sp
from veil.functions.text import normal_value
from veil.operators.detect import topic_warnings
from veil.operators.gate import apply_decisions, resolved, unresolved
from veil.operators.blocks import row_numbers
from veil.operators.rules import Rule
from veil.operators.terms import match_memory, remembered_leaks, trie_pattern
from veil.schema import ITEM_FIELDS, ITEMS, NUMBERED, WARNINGS
from veil.session import cut, shuffled

CARRIED = ("level", "ph")


@dataclass
class SessionState:
    """What sessions have gathered: small tables keyed by session, also the state of a stream.

    ``memory``: session, cat, value, first_turn, level, ph. ``numbers``: session, cat, value (normal form), number.
    ``revealed``: session, value (lower case), revealed (the first turn).
    """

    memory: DataFrame
    numbers: DataFrame
    revealed: DataFrame


def term_items(rules: Iterable[Rule], text: str) -> str:
    """Items of the ``term`` rules: whole words in any case, one pattern per label (``[TERM]`` without one)."""
    by_label: dict[str, list[str]] = {}
    for rule in rules:
        if rule.kind == "term" and re.search("[A-Za-z0-9]", rule.value):
            by_label.setdefault(rule.label, []).append(rule.value.strip())
    found = []
    for label, words in by_label.items():
        pattern = f"(?i)(?<![A-Za-z0-9])(?:{trie_pattern(words)})(?![A-Za-z0-9])"
        word = re.sub("[^A-Z0-9]+", "_", label.upper()).strip("_")
        found.append(sp.to_items(sp.find_spans(text, pattern), cat="TERM", kind="Your rule", level="high",
                                 layer="rule", ev="named by a rule", ph=f"[{word or 'TERM'}]"))
    return f"concat({', '.join(found)})" if found else sp.NO_ITEMS


def _values(rules: Iterable[Rule], kind: str) -> list[str]:
    return sorted({r.value.strip() for r in rules if r.kind == kind})


def ruled(found: str, rules: Iterable[Rule]) -> str:
    """Items that ``allow`` values and ``show`` categories leave."""
    inside = lambda col, values: f"{col} IN ({', '.join(map(sp.lit, values))})"
    x, tests = sp.var("x"), []
    if values := [v.lower() for v in _values(rules, "allow")]:
        tests.append(inside(f"lower(trim({x}.value))", values))
    if shown := _values(rules, "show"):
        tests.append(inside(f"{x}.cat", shown))
    return f"filter({found}, {x} -> NOT ({' OR '.join(tests)}))" if tests else found


def _decide(items: DataFrame, rules: list[Rule], decisions: DataFrame | None, keys: list[str]) -> DataFrame:
    """Resolved items with ``masked``; ``category`` rules make theirs high (not before, so that they win no
    overlap by it)."""
    if always := _values(rules, "category"):
        items = items.withColumn("level", F.when(F.col("cat").isin(always), "high").otherwise(F.col("level")))
    if decisions is None:
        return items.withColumn("masked", F.col("level") != "low")
    return apply_decisions(items, decisions, (*keys, "start"))


def _resolve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Item rows of each turn without overlaps."""
    packed = rows.groupBy(*keys).agg(F.collect_list(F.struct(*ITEM_FIELDS)).cast(ITEMS).alias("found"))
    return packed.select(*keys, F.inline(resolved("found")))


def first_hidden(decided: DataFrame, session: str, turn: str) -> DataFrame:
    """What a session remembers: each hidden value with the turn, level and placeholder it first had."""
    first = F.min(F.struct(F.col(turn).alias("first_turn"), "start", "value", *CARRIED))
    return (decided.filter("masked").groupBy(session, "cat", normal_value(F.col("value")).alias("__n"))
            .agg(first.alias("f")).select(session, "cat", "f.first_turn", "f.value", *[f"f.{c}" for c in CARRIED]))


def first_revealed(decided: DataFrame, session: str, turn: str) -> DataFrame:
    """Medium values that the user revealed, with the first turn of that: allowed afterwards."""
    return (decided.filter((F.col("level") == "medium") & ~F.col("masked"))
            .groupBy(session, F.lower("value").alias("value")).agg(F.min(turn).alias("revealed")))


def _not_revealed(rows: DataFrame, revealed: DataFrame, session: str, turn: Column) -> DataFrame:
    keyed = rows.withColumn("__v", F.lower("value")).join(
        shuffled(revealed.withColumnRenamed("value", "__v")), [session, "__v"], "left")
    return keyed.filter(F.col("revealed").isNull() | (F.col("revealed") >= turn)).drop("__v", "revealed")


def _remembered(base: DataFrame, memory: DataFrame, session: str, turn: str, text: str) -> DataFrame:
    """Hits of earlier values as item rows; level and placeholder are those of the first appearance."""
    hits = match_memory(base.select(session, turn, text), memory, session, turn, text, carry=CARRIED)
    made = {"kind": "Remembered value", "layer": "memory", "ev": "hidden earlier"}
    return hits.select(session, turn, *[F.lit(made[f]).alias(f) if f in made else F.col(f) for f in ITEM_FIELDS])


def _earliest(memory: DataFrame, session: str) -> DataFrame:
    """One row per value of a session, the earliest."""
    return (memory.groupBy(session, "cat", normal_value(F.col("value")).alias("__n"))
            .agg(F.min(F.struct("first_turn", "value", *CARRIED)).alias("f")).select(session, "cat", "f.*"))


def _numbers(rows: DataFrame, session: str, turn: str, known: DataFrame | None) -> DataFrame:
    """Numbers of hidden values that have none yet, by first appearance after the known ones."""
    value = normal_value(F.col("value"))
    first = (rows.filter("masked").groupBy(session, "cat", value.alias("value"))
             .agg(F.min(F.struct(F.col(turn).alias("t"), F.col("start").alias("s"))).alias("f"))
             .select(session, "cat", "value", F.col("f.t").alias("t"), F.col("f.s").alias("s")))
    if known is None:
        return row_numbers(first, [session, "cat"], "t", "number", width=1_000_000, ties=("s", "value")).drop("t", "s")
    last = known.groupBy(session, "cat").agg(F.max("number").alias("__last"))
    new = first.join(shuffled(known), [session, "cat", "value"], "left_anti")
    new = row_numbers(new, [session, "cat"], "t", "number", width=1_000_000, ties=("s", "value")).drop("t", "s")
    return new.join(shuffled(last), [session, "cat"], "left").withColumn(
        "number", F.col("number") + F.coalesce("__last", F.lit(0))).drop("__last")


def _with_numbers(rows: DataFrame, numbers: DataFrame, session: str) -> DataFrame:
    """Hidden items with the number of their value; people, places and organisations show it."""
    word = F.create_map(*[F.lit(x) for pair in NUMBERED.items() for x in pair])
    named = F.col("masked") & F.col("cat").isin(*NUMBERED)
    keyed = rows.withColumn("__n", normal_value(F.col("value"))).join(
        shuffled(numbers.withColumnRenamed("value", "__n")), [session, "cat", "__n"], "left").drop("__n")
    return (keyed.withColumn("number", F.when(F.col("masked"), F.col("number")))
            .withColumn("ph", F.when(named, F.concat(
                F.lit("["), word[F.col("cat")], F.lit("_"), F.col("number").cast("string"), F.lit("]"))).otherwise(F.col("ph"))))


def _merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else old.select(new.columns).unionByName(new)


def gate_turns(turns: DataFrame, *, session: str = "conv_id", turn: str = "turn", text: str = "text",
               rules: Iterable[Rule] = (), decisions: DataFrame | None = None, memory: bool = True,
               warnings: bool = True, known: SessionState | None = None,
               free: DataFrame | None = None) -> tuple[DataFrame, SessionState]:
    """The gated turns of :func:`gate_session`, and what their sessions have gathered beyond ``known``.

    ``known`` is the state before these turns, whatever their numbers: its values are hidden in all of them.
    ``free`` has the columns of ``SessionState.revealed``: further values that are allowed in later turns.
    """
    keys, rules = [session, turn], list(rules)
    base = unresolved(turns, text, extra=term_items(rules, "__t"))
    base = base.withColumn("found", F.expr(ruled("found", rules)).cast(ITEMS))
    if warnings:
        base = base.withColumn("warnings", F.expr(topic_warnings(text)).cast(WARNINGS))
    base = cut(base)
    rows = base.select(*keys, F.inline("found"))
    own = base.select(*keys, F.inline(resolved("found")))
    held = cut(first_hidden(_decide(own, rules, decisions, keys), session, turn))
    if memory:
        before = known and known.memory.withColumn("first_turn", F.lit(-2 ** 63).cast("long"))
        again = _remembered(base, held if known is None else cut(_earliest(_merged(before, held), session)),
                            session, turn, text)
        if allowed := [v.lower() for v in _values(rules, "allow")]:
            again = again.filter(~F.lower("value").isin(*allowed) & ~F.lower("match").isin(*allowed))
        rows = cut(rows.unionByName(again))
    decided = _decide(_resolve(rows, keys), rules, decisions, keys)
    revealed = _merged(free, first_revealed(decided, session, turn))
    if decisions is not None or known is not None or free is not None:
        before = known and known.revealed.withColumn("revealed", F.lit(-2 ** 63).cast("long"))
        first = _merged(before, revealed).groupBy(session, "value").agg(F.min("revealed").alias("revealed"))
        rows = _not_revealed(rows, first, session, F.col(turn))
        decided = _decide(_resolve(rows, keys), rules, decisions, keys)
    decided = cut(decided)
    numbers = cut(_numbers(decided, session, turn, known and known.numbers))
    final = _with_numbers(decided, _merged(known and known.numbers, numbers), session)
    packed = final.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct(*ITEM_FIELDS, "masked", "number"))).alias("items"))
    none = F.array().cast(packed.schema["items"].dataType)
    out = base.drop("found").join(shuffled(packed), keys, "left").withColumn("items", F.coalesce("items", none))
    out = out.withColumn("clean", F.expr(sp.apply_items(text, "items", lambda i: f"{i}.masked")))
    if known is not None:
        same = [session, "cat", "__n"]
        old = known.memory.select(session, "cat", normal_value(F.col("value")).alias("__n"))
        held = held.withColumn("__n", normal_value(F.col("value"))).join(shuffled(old), same, "left_anti").drop("__n")
    return out, SessionState(held, numbers, revealed)


def gate_session(turns: DataFrame, **options) -> DataFrame:
    """Turns with ``clean``, ``items`` (with ``masked`` and ``number``) and ``warnings``; the text becomes its
    normal reading. Options:

    * ``session``, ``turn``, ``text``: columns. (session, turn) is unique and ``turn`` rises; a null text is empty.
      For sessions with resets, key by a column that holds (session, epoch), see
      :func:`veil.operators.placeholders.session_epoch`.
    * ``rules``: settings. ``term`` (hidden wherever it stands, ``label`` names its placeholder), ``allow``
      (never flagged), ``category`` (always hidden), ``show`` (category left alone).
    * ``decisions``: rows (session, turn, start, hide), the user's choices on single items. High items stay
      hidden; a medium one that is revealed is allowed in all later turns, also when it was hidden before.
    * ``memory``: a value hidden in a turn is hidden again in every later one, whole, reversed, spaced out or in
      parts, under the placeholder it had; before overlaps are resolved, so it competes with the detectors.
    * ``warnings``: add them.

    Numbers of people, places, addresses and organisations run through the session.
    """
    return gate_turns(turns, **options)[0]


def session_findings(gated: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per item of gated turns, hidden or not."""
    return gated.select(session, turn, F.inline(F.expr(sp.each("items"))))


def verify_session(gated: DataFrame, rules: Iterable[Rule] = (), session: str = "conv_id", turn: str = "turn",
                   text: str = "clean", state: SessionState | None = None, free: DataFrame | None = None) -> DataFrame:
    """Adds ``residual`` and ``residual_count``: kinds that a finished payload still holds.

    The detectors read the payload again, and everything that the session has hidden up to this turn is looked
    for in it. Values that ``allow`` and ``show`` rules or the user's decisions up to this turn set free are
    none. Pass stored turns; they are read three times. ``state`` adds what the sessions hid before these turns,
    ``free`` (as ``SessionState.revealed``) further values set free.
    """
    found, value = session_findings(gated, session, turn), F.lower("value")
    shown = _merged(free, first_revealed(found, session, turn))
    held = first_hidden(found, session, turn)
    if state is not None:
        first = F.lit(-2 ** 63).cast("long")
        shown = _merged(state.revealed.withColumn("revealed", first), shown)
        held = _earliest(_merged(state.memory.withColumn("first_turn", first), held), session)
    shown = shown.groupBy(session, F.col("value").alias("__v")).agg(F.min("revealed").alias("revealed"))
    again = unresolved(gated.select(session, turn, text), text)
    again = (again.select(session, turn, F.inline(F.expr(sp.each(ruled("found", rules))))).filter("level <> 'low'")
             .select(session, turn, "kind", value.alias("__v")))
    # Stored, so that the detectors' expression is planned once, not again after every shuffle of the joins below.
    again = cut(again)
    leaks = remembered_leaks(gated, held, session, turn, text)
    leaks = leaks.select(session, turn, F.lit("Remembered value").alias("kind"), value.alias("__v"))
    left = (again.unionByName(leaks).join(shuffled(shown), [session, "__v"], "left")
            .filter(F.col("revealed").isNull() | (F.col("revealed") > F.col(turn)))
            .groupBy(session, turn).agg(F.array_sort(F.collect_list("kind")).alias("residual")))
    out = gated.join(shuffled(left), [session, turn], "left")
    return (out.withColumn("residual", F.coalesce("residual", F.array().cast("array<string>")))
            .withColumn("residual_count", F.size("residual")))
