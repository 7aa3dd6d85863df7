"""Readings of a text before detection (expression text)."""

from __future__ import annotations

from veil.functions.secrets import lower_ascii
from veil.functions.spans import let, lit, var

# Characters that print nothing.
INVISIBLE = r"[\u00AD\u180E\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFEFF]"

# Letters of other scripts that look like Latin ones, and the Latin letter each
# looks like (Cyrillic first, then Greek).
LOOKALIKE = "аеорсухіјѕАВЕКМНОРСТХІοαΑΒΕΗΙΚΜΝΟΡΤΧΥΖ"
LATIN = "aeopcyxijsABEKMHOPCTXIoaABEHIKMNOPTXYZ"

# Digit words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
               "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def strip_invisible(t: str) -> str:
    p = lit(INVISIBLE)
    return f"if(rlike({t}, {p}), regexp_replace({t}, {p}, ''), {t})"


def fold_lookalikes(t: str) -> str:
    """Look-alike letters to Latin, one to one, so offsets stay valid."""
    return f"translate({t}, {lit(LOOKALIKE)}, {lit(LATIN)})"


def normalize(t: str) -> str:
    """Plain ASCII, and texts without any of these characters, are left as they are."""
    odd = lit(f"(?=[^\\x00-\\xAC])[{INVISIBLE[1:-1]}\\u0391-\\u03BF\\u0405-\\u0458]")
    return let(t, lambda x: (f"if(octet_length({x}) = length({x}) OR NOT rlike({x}, {odd}), {x}, "
                             f"{fold_lookalikes(strip_invisible(x))})"))


def spelled_digits(v: str) -> str:
    """`nine eight double seven` to `9877`; null when a word is not a digit word."""
    z, w = var("z"), var("w")
    table = "map(" + ", ".join(f"{lit(k)}, {lit(d)}" for k, d in DIGIT_WORDS.items()) + ")"
    digit = f"if(rlike({w}, '^[0-9]$'), {w}, try_element_at({table}, {w}))"
    state = lambda o, n: f"named_struct('o', {o}, 'n', {n})"
    return (f"aggregate(regexp_extract_all({lower_ascii(v)}, '[a-z0-9]+', 0), {state(lit(''), 1)}, "
            f"({z}, {w}) -> CASE {w} WHEN 'double' THEN {state(z + '.o', 2)} "
            f"WHEN 'triple' THEN {state(z + '.o', 3)} "
            f"ELSE {state(f'concat({z}.o, repeat({digit}, {z}.n))', 1)} END, {z} -> {z}.o)")


def unspace(v: str) -> str:
    """`a d i 1 2 3` to `adi123` when the text is single characters only."""
    return (f"if(rlike({v}, '^[A-Za-z0-9]([ .-][A-Za-z0-9])+$'), "
            f"regexp_replace({v}, '[ .-]', ''), {v})")
