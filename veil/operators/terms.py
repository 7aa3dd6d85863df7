"""Remembered values and named terms found again in texts, as equi joins on tokens."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions import spans as sp
from veil.schema import PLACEHOLDER
from veil.session import shuffled

TOKEN = "[a-z0-9]+"


def word_counts(rows: DataFrame, value: str) -> list[int]:
    """The numbers of words that the values have, shortest first: a handful of integers."""
    n = F.size(F.regexp_extract_all(F.lower(value), F.lit(TOKEN), F.lit(0)))
    return sorted(r[0] for r in rows.select(n.alias("n")).filter("n > 0").distinct().collect())


def tokens(text: str, short: int = 4000) -> str:
    """Tokens of a lower-case text: ``array<struct<s,e,v>>``. A short one is split at every other sign, and the end of
    a piece is the length of what is before the next one; that grows with the square of a text, so long ones are
    read by :func:`veil.functions.spans.find_tokens`."""
    def pieces(plain: str) -> str:
        v, i, w = sp.var("v"), sp.var("i"), sp.var("w")
        end = f"length(substring_index({plain}, ' ', {i} + 1))"
        return (f"filter(transform(split({plain}, ' ', -1), ({v}, {i}) -> named_struct('s', {end} - length({v}), "
                f"'e', {end}, 'v', {v})), {w} -> {w}.v <> '')")

    fast = sp.let(f"regexp_replace({text}, '[^a-z0-9]', ' ')", pieces)
    return f"if(length({text}) <= {short}, {fast}, {sp.find_tokens(text, TOKEN)})"


def word_spans(text: str, sizes: list[int], joiner: str = " ") -> str:
    """Single tokens, and runs of as many adjacent tokens as ``sizes`` lists:
    ``array<struct<s,e,v>>`` (expression text)."""
    def grams(tok: str) -> str:
        i, w = sp.var("i"), sp.var("w")

        def runs(n: int) -> str:
            words = (f"concat_ws({sp.lit(joiner)}, {', '.join(f'{tok}[{i} + {k}].v' for k in range(n))})" if n <= 4 else
                     f"array_join(transform(slice({tok}, {i} + 1, {n}), {w} -> {w}.v), {sp.lit(joiner)})")
            run = f"named_struct('s', {tok}[{i}].s, 'e', {tok}[{i} + {n - 1}].e, 'v', {words})"
            return f"if(size({tok}) < {n}, {sp.NO_SPANS}, transform(sequence(0, size({tok}) - {n}), {i} -> {run}))"

        longer = [runs(n) for n in sizes if n > 1]
        return f"concat({', '.join([tok, *longer])})" if longer else tok

    return sp.let(tokens(f"lower({text})"), grams)


def trie_pattern(words: Iterable[str]) -> str:
    """One pattern for all words: a trie of their characters, so that a common beginning is read once. Of
    words that begin at the same place the longest is tried first."""
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def show(node: dict) -> str:
        ways = [re.sub(r"([^\w\s])", r"\\\1", ch) + show(child) for ch, child in sorted(node.items()) if ch]
        if not ways:
            return ""
        inner = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return f"{inner}?" if "" in node else inner

    return show(root)


def match_terms(texts: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text",
                term: str = "term", sizes: list[int] | None = None, most_first: int = 2000) -> DataFrame:
    """Whole-word, case-insensitive hits of each term: one row per hit (key, term, start, end).

    The first words of the terms become one trie pattern, and a text gives rows only where one of them
    stands; with more than ``most_first`` first words (or one of more than 100 characters) every word is a
    row, and a semi-join with the first words takes its place. Such a row carries the characters that
    the longest term could need, so it is compared with the exact terms by one hash join, however large the
    list; texts are read once and joined with nothing. Hits may overlap.

    Terms shorter than two characters, or without a letter or digit, cannot be whole words and are
    dropped, null terms too. Terms may have any number of words: ``sizes`` lists the numbers that occur,
    read from the term table (with its greatest lengths, one small job) where it is not given. Null texts
    and empty tables give no rows.
    """
    low = F.lower(term)
    part = lambda pattern: F.regexp_extract(low, pattern, 0)
    wanted = (terms.select(low.alias("term"), part("(?s)[a-z0-9](?:.*[a-z0-9])?").alias("body"),
                           part("^[^a-z0-9]*").alias("lead"), part("[^a-z0-9]*$").alias("tail"),
                           part(TOKEN).alias("first"))
              .filter((F.length("term") >= 2) & (F.col("body") != "")).distinct())
    most = lambda c: F.max(F.length(c))
    words = F.size(F.regexp_extract_all("body", F.lit(TOKEN), F.lit(0)))
    facts = wanted.agg(most("body").alias("body"), most("lead").alias("lead"), most("tail").alias("tail"),
                       most("first").alias("first"), F.collect_set(words).alias("sizes")).first()
    sizes = sorted(facts["sizes"]) if sizes is None else sizes
    body, lead, tail = (facts[c] or 0 for c in ("body", "lead", "tail"))
    firsts = wanted.select(F.col("first").alias("v")).distinct()
    few = [r["v"] for r in firsts.limit(most_first + 1).collect()] if (facts["first"] or 0) <= 100 else None
    small = few is not None and len(few) <= most_first
    pattern = f"(?<![a-z0-9])(?:{trie_pattern(few)})(?![a-z0-9])" if small and few else TOKEN

    def places(lower: str) -> str:
        i, w = sp.var("i"), sp.var("w")
        # One character more on both sides shows whether a term with a sign at its end is a whole word.
        before = f"substring({lower}, greatest({i}.s - {lead + 1}, 0) + 1, least({i}.s, {lead + 1}))" if lead else "''"
        place = f"named_struct('s', {i}.s, 'v', {i}.v, 'pre', {before}, 'win', "
        if sizes == [1] and not tail:  # the word is all that is compared
            return f"transform({sp.find_tokens(lower, pattern)}, {i} -> {place}{i}.v))"
        # What follows a word is read by a look-ahead: a substring would count from the start of the text for each word.
        ahead = f"regexp_extract_all({lower}, {sp.lit(f'(?s){pattern}(?=(.{{0,{body + tail + 1}}}))')}, 1)"
        return f"zip_with({sp.find_tokens(lower, pattern)}, {ahead}, ({i}, {w}) -> {place}concat({i}.v, {w})))"

    found = texts.select(key, F.inline(F.expr(sp.let(f"lower({text})", places))))
    if not small:
        found = found.join(firsts, "v", "left_semi")
    # Possessive, so a run ends where its last word ends; one cut by the window is longer than any term.
    run = lambda n: F.regexp_extract("win", f"^[a-z0-9]++(?:[^a-z0-9]++[a-z0-9]++){{{n - 1}}}", 0)
    runs = found.select(key, "s", "pre", "win", F.explode(F.array(*[run(n) for n in sizes] or [F.lit("")])).alias("body"))
    met = runs.filter(F.length("body").between(1, body)).join(shuffled(wanted.drop("first")), "body")
    free = lambda c: ~c.rlike("[a-z0-9]")
    after = F.substring("win", F.length("body") + 1, F.lit(tail + 1))
    left = F.length("pre") - F.length("lead")
    start = F.col("s") - F.length("lead")
    return met.filter(
        F.col("pre").endswith(F.col("lead")) & ((left <= 0) | free(F.substring("pre", left, F.lit(1))))
        & after.startswith(F.col("tail")) & free(F.substring(after, F.length("tail") + 1, F.lit(1)))
    ).select(key, "term", start.alias("start"), (start + F.length("term")).alias("end"))


def memory_variants(memory: DataFrame, session: str = "conv_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every form under which a remembered value may come back: whole or reversed at any length, and
    its parts of four or more characters (of an e-mail address those before the @: the rest is shared)."""
    bare = F.regexp_replace(F.lower("value"), "[^a-z0-9]", "")
    own = F.when(F.col("cat") == "EMAIL", F.substring_index("value", "@", 1)).otherwise(F.col("value"))
    parts = F.filter(F.regexp_extract_all(F.lower(own), F.lit(TOKEN), F.lit(0)), lambda p: F.length(p) >= 4)
    forms = F.array_distinct(F.concat(F.array(bare, F.reverse(bare)), parts))
    held = ("first_turn", "value", "cat", *carry)
    rows = memory.select(session, *held, F.explode(forms).alias("form"))
    # One row per form, the earliest: the join below can then never multiply tokens.
    return (rows.filter(F.length("form") > 0).groupBy(session, "form").agg(
        F.min(F.struct(*held)).alias("m"))
        .select(session, "form", "m.*"))


def match_memory(turns: DataFrame, memory: DataFrame, session: str = "conv_id",
                 turn: str = "turn", text: str = "text", sizes: list[int] | None = None,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """Hits of values remembered from earlier turns of the same session, outside placeholders.

    Tokens, runs of as many tokens as a remembered value has, and spaced-out characters
    (``4 7 8 5``) are the join keys; a form of fewer than four characters must be a whole token.
    ``sizes`` is read from ``memory`` where it is not given, so pass a stored table. ``carry`` names
    further columns of ``memory`` that the hits are to have.
    """
    sizes = sorted({2, *(word_counts(memory, "value") if sizes is None else sizes)})
    s = sp.var("s")
    spaced = sp.find_spans(f"lower({text})", "[a-z0-9](?:[ .-][a-z0-9]){3,}(?![a-z0-9])")
    joined = (f"transform({spaced}, {s} -> named_struct('s', {s}.s, 'e', {s}.e, 'v', "
              f"regexp_replace({s}.v, '[ .-]', '')))")
    forms = f"concat({word_spans(text, sizes, '')}, {joined})"
    i = sp.var("i")
    p = sp.var("p")
    whole = f"(length({i}.v) >= 4 OR length({i}.v) = {i}.e - {i}.s)"
    with_text = sp.let(sp.protected_spans(text), lambda held: (
        f"transform(filter({forms}, {i} -> {whole} AND NOT exists({held}, {p} -> {i}.s < {p}.e AND {i}.e > {p}.s)), "
        f"{i} -> named_struct('start', {i}.s, 'end', {i}.e, 'form', {i}.v, "
        f"'match', substring({text}, {i}.s + 1, {i}.e - {i}.s)))"))
    runs = turns.select(session, turn, F.inline(F.expr(with_text)))
    return (runs.join(shuffled(memory_variants(memory, session, carry)), [session, "form"])
            .filter(F.col("first_turn") < F.col(turn))
            .select(session, turn, "start", "end", "match", "value", "cat", "first_turn", *carry))


def remembered_leaks(texts: DataFrame, memory: DataFrame, session: str = "conv_id", turn: str = "turn",
                     text: str = "clean", width: int = 4) -> DataFrame:
    """Remembered values that a finished text still holds: session, turn, value, cat, once each.

    Letters and digits only are compared, whole or reversed, wherever they lie (also inside a longer word);
    a form of fewer than ``width`` characters must be a whole token. Placeholders are no text. Values count
    from the turn they were hidden in (``first_turn``).

    A form is keyed by its first ``width`` characters. The distinct pieces of that length of each text,
    which a form in it must start with, join the keys of their own session; Spark filters the pieces
    by a Bloom filter of the keys where the tables are large. Only the pairs that meet are compared exactly.
    """
    bare = F.regexp_replace(F.lower("value"), "[^a-z0-9]", "")
    key = lambda form: F.when(F.length(form) < width, F.concat(F.lit("="), form)).otherwise(
        F.substring(form, 1, width))
    forms = (memory.select(session, "value", "cat", "first_turn", F.explode(F.array(bare, F.reverse(bare))).alias("form"))
             .filter(F.length("form") > 0).withColumn("key", key(F.col("form"))))
    # A placeholder becomes a sign that no form holds, so nothing is found across it.
    low = F.lower(F.regexp_replace(text, PLACEHOLDER, "|"))
    flat = F.regexp_replace(low, "[^a-z0-9|]", "")
    # Pieces at every place, read by one look-ahead.
    pieces = F.regexp_extract_all("flat", F.lit(f"(?=([a-z0-9]{{{width}}}))"), F.lit(1))
    tokens = F.transform(F.filter(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)),
                                  lambda t: F.length(t) < width), lambda t: F.concat(F.lit("="), t))
    read = texts.select(session, turn, flat.alias("flat"), tokens.alias("tokens"))
    keys = read.select(session, turn, F.explode(F.array_distinct(F.concat(
        F.coalesce(pieces, F.array()), "tokens"))).alias("key"))
    met = keys.join(shuffled(forms), [session, "key"]).filter(F.col("first_turn") <= F.col(turn))
    exact = met.join(shuffled(read.select(session, turn, "flat")), [session, turn]).filter(
        F.col("key").startswith("=") | F.contains("flat", "form"))
    return exact.select(session, turn, "value", "cat").distinct()
