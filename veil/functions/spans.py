"""Span algebra on one text: find, resolve, apply.

Everything here returns Spark SQL expression text for ``F.expr``. The detectors nest a few hundred
higher-order functions; as text they reach Catalyst in one call, where the same tree built from
Column objects takes half a minute of round trips to the JVM before the first row is read.
Arguments are expressions too: a column name, a lambda variable, or another expression.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from veil.schema import ITEMS, NUMBERED, PLACEHOLDER, SPANS

NO_SPANS = f"cast(array() AS {SPANS})"
NO_ITEMS = f"cast(array() AS {ITEMS})"

_names = itertools.count()


def var(stem: str = "x") -> str:
    """A lambda variable name that no enclosing lambda uses."""
    return f"{stem}_{next(_names)}"


def lit(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    x = var("let")
    return f"element_at(transform(array({value}), {x} -> {body(x)}), 1)"


class Gated(str):
    """``if(gate, body, empty)``. What is made of the array later moves inside, so that the gate stays outermost,
    where Spark compiles it: the higher-order functions of the body are interpreted."""

    gate: str
    body: str
    empty: str


def gated(gate: str, body: str, empty: str) -> Gated:
    out = Gated(f"if({gate}, {body}, {empty})")
    out.gate, out.body, out.empty = gate, body, empty
    return out


def inside(array: str, change: Callable[[str], str], empty: str | None = None) -> str:
    """``change`` of the array, behind its gate if it has one; an empty array has to stay empty."""
    if isinstance(array, Gated):
        return gated(array.gate, change(array.body), empty or array.empty)
    return change(array)


def keep(array: str, test: Callable[[str], str]) -> str:
    x = var("k")
    return inside(array, lambda a: f"filter({a}, {x} -> {test(x)})")


def gaps(text: str, pattern: str) -> str:
    """What stands between the matches. ``split`` by a pattern would compile it for every row; by one sign that no
    text holds it does not."""
    p, sign = lit(pattern), lit("\uffff")
    return (f"if(contains({text}, {sign}), split({text}, {p}, -1), "
            f"split(regexp_replace({text}, {p}, {sign}), {sign}, -1))")


def find_spans(text: str, pattern: str, gate: str = "true") -> str:
    """Every match of ``pattern`` as ``array<struct<s,e,v>>``; one pass of running lengths.

    The gaps and the matches come from the same pattern, so the offsets are exact; a single match whose
    characters stand nowhere else in the text needs no gaps. Texts without a match cost one early-out scan, or none
    where the cheaper ``gate`` (a necessary condition) already rules them out.
    """
    p, z, x, g, m, o = lit(pattern), var("z"), var("x"), var("g"), var("m"), var("o")
    hit = (f"named_struct('s', {z}.pos + {x}.g, 'e', {z}.pos + {x}.g + length({x}.m), 'v', {x}.m)")
    at = lambda v: f"instr({text}, {v})"

    def placed(found: str) -> str:
        only = f"{found}[0]"
        return (
            f"if(size({found}) = 1 AND {at(only)} > 0 AND locate({only}, {text}, {at(only)} + 1) = 0, "
            f"transform({found}, {o} -> named_struct('s', {at(o)} - 1, 'e', {at(o)} - 1 + length({o}), 'v', {o})), "
            f"aggregate(zip_with({gaps(text, pattern)}, {found}, "
            f"({g}, {m}) -> named_struct('g', length({g}), 'm', {m})), "
            f"named_struct('pos', 0, 'out', {NO_SPANS}), "
            f"({z}, {x}) -> if({x}.m IS NULL, {z}, named_struct("
            f"'pos', {z}.pos + {x}.g + length({x}.m), 'out', concat({z}.out, array({hit})))), "
            f"{z} -> {z}.out))")

    tests = f"rlike({text}, {p})" if gate == "true" else f"({gate}) AND rlike({text}, {p})"
    return gated(tests, let(f"regexp_extract_all({text}, {p}, 0)", placed), NO_SPANS)


def find_groups(text: str, pattern: str, gate: str = "true") -> str:
    """Like :func:`find_spans` for a pattern ``(lead)(value)…``: the span of the value group.

    The pattern is read again on the matched piece alone, so anything it looks at must lie inside
    the match or be a negative look-around.
    """
    p, m = lit(pattern), var("m")
    lead = f"{m}.s + length(regexp_extract({m}.v, {p}, 1))"
    parts = let(f"named_struct('s', {lead}, 'v', regexp_extract({m}.v, {p}, 2))",
                lambda x: f"named_struct('s', {x}.s, 'e', {x}.s + length({x}.v), 'v', {x}.v)")
    return inside(find_spans(text, pattern, gate), lambda a: f"transform({a}, {m} -> {parts})")


def to_items(spans: str, *, cat: str, kind: str, level: str, layer: str, ev: str,
             ph: str) -> str:
    """Spans as items of one category. ``[SECRET]`` and numbered placeholders are filled in by
    :func:`finish_items` once the overlaps are resolved."""
    s = var("s")
    return inside(spans, lambda a: (
        f"transform({a}, {s} -> named_struct('start', {s}.s, 'end', {s}.e, "
        f"'match', {s}.v, 'value', {s}.v, 'cat', {lit(cat)}, 'kind', {lit(kind)}, "
        f"'level', {lit(level)}, 'layer', {lit(layer)}, 'ev', {lit(ev)}, 'ph', {lit(ph)}))"), NO_ITEMS)


def level_rank(level: str) -> str:
    return f"if({level} = 'high', 0, if({level} = 'medium', 1, 2))"


def order_items(items: str) -> str:
    """By start, then level (high first), then longer first, then remembered values; the password of a
    URL comes before an e-mail address read from the same place.

    The key goes in front of each item, so the natural struct order does the sorting.
    """
    i, k = var("i"), var("k")
    keyed = (f"transform({items}, {i} -> named_struct('a', {i}.start, 'b', "
             f"if({i}.kind = 'Password in a URL', -1, {level_rank(i + '.level')}), 'c', -{i}.`end`, "
             f"'m', if({i}.layer = 'memory', 0, 1), 'd', {i}.cat, 'f', {i}.kind, 'i', {i}))")
    return f"transform(array_sort({keyed}), {k} -> {k}.i)"


def resolve_overlaps(items: str) -> str:
    """Greedy left to right: an item that starts before the last kept end is dropped."""
    k, i = var("k"), var("i")
    last = f"coalesce(try_element_at({k}, -1).`end`, 0)"
    return (f"aggregate({order_items(items)}, {NO_ITEMS}, ({k}, {i}) -> "
            f"if({last} <= {i}.start, concat({k}, array({i})), {k}))")


def protected_spans(text: str) -> str:
    """Placeholders already in the text; nothing inside them is ever scanned again."""
    return find_spans(text, PLACEHOLDER, f"contains({text}, '[')")


def outside(items: str, spans: str) -> str:
    """Items that touch none of ``spans``."""
    def clear(held: str) -> str:
        i, p = var("i"), var("p")
        return (f"filter({items}, {i} -> NOT exists({held}, {p} -> "
                f"{i}.start < {p}.e AND {i}.`end` > {p}.s))")

    return let(spans, clear)


def each(array: str) -> str:
    """The array as generator input. A bare column would make Catalyst infer a size filter and push
    it below the projection that computes the array, which would then be computed twice."""
    x = var("x")
    return f"transform({array}, {x} -> {x})"


def masks_by_default(item: str) -> str:
    """Everything except ``low`` is hidden."""
    return f"{item}.level <> 'low'"


def apply_items(text: str, items: str, masked: Callable[[str], str] = masks_by_default) -> str:
    """Rebuild the text with each masked item replaced by its placeholder.

    ``items`` must be resolved (ordered, free of overlaps).
    """
    z, i = var("z"), var("i")
    return (f"aggregate({keep(items, masked)}, named_struct('o', '', 'c', 0), "
            f"({z}, {i}) -> named_struct('o', concat({z}.o, substring({text}, {z}.c + 1, "
            f"{i}.start - {z}.c), {i}.ph), 'c', {i}.`end`), "
            f"{z} -> concat({z}.o, substring({text}, {z}.c + 1)))")


def find_tokens(text: str, pattern: str, block: int = 16) -> str:
    """:func:`find_spans` for patterns with very many matches.

    Appending to an array copies it, so the running lengths are worked out block by block.
    """
    p, g, m, b, k, n, z, x = (lit(pattern), *(var(v) for v in "gmbknzx"))
    pairs = (f"filter(zip_with({gaps(text, pattern)}, regexp_extract_all({text}, {p}, 0), "
             f"({g}, {m}) -> named_struct('g', length({g}), 'm', {m})), {g} -> {g}.m IS NOT NULL)")

    def blocks(a: str) -> str:
        return (f"if(size({a}) = 0, array(), transform(sequence(0, (size({a}) - 1) div {block}), "
                f"{b} -> slice({a}, {b} * {block} + 1, {block})))")

    def placed(bs: str) -> str:
        total = f"aggregate({k}, 0, ({z}, {x}) -> {z} + {x}.g + length({x}.m))"

        def all_(totals: str) -> str:
            start = f"aggregate(slice({totals}, 1, {n}), 0, ({z}, {x}) -> {z} + {x})"
            hit = (f"named_struct('s', {z}.pos + {x}.g, 'e', {z}.pos + {x}.g + length({x}.m), "
                   f"'v', {x}.m)")
            return (f"flatten(transform({bs}, ({k}, {n}) -> aggregate({k}, named_struct('pos', "
                    f"{start}, 'out', {NO_SPANS}), ({z}, {x}) -> named_struct("
                    f"'pos', {z}.pos + {x}.g + length({x}.m), 'out', concat({z}.out, array({hit}))), "
                    f"{z} -> {z}.out)))")

        return let(f"transform({bs}, {k} -> {total})", all_)

    return let(let(pairs, blocks), placed)
