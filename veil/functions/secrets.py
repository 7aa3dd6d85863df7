"""Secrets have no pattern: approximate trigger words on one side, value strength on the other.

Expression text, like :mod:`veil.functions.spans`.
"""

from __future__ import annotations

from collections.abc import Callable

from veil.functions.spans import NO_SPANS, find_spans, keep, let, lit, var
from veil.schema import NUMBERED

# The words that announce a secret, and words near them that do not.
CUES = ("password", "passcode", "passphrase")
NOT_CUES = ("passport", "passports", "passed", "password's")

# Within two edits of a cue one of its three pieces stays whole; a whole last piece with both
# others damaged uses up the edits, so it must end the word. Anything else cannot match; words of
# other lengths are passed over.
CANDIDATE = (r"(?<![a-z])(?=[a-z]{6,12}+(?![a-z]))(?:[a-z]{0,9}(?:pas|swo|sco|sph|ras)[a-z]{0,9}|[a-z]{4,8}(?:rd|de))"
             r"(?![a-z])")
# Two neighbours joined, at most one edit: one half is whole, the other nearly so.
TWO_TOKENS = (r"(?<![a-z])(?=[a-z]{2,6}+[ _.-][wcp])(?:(?:p?ass?|pa?ss|[a-z]ass|p[a-z]ss|pa[a-z]s|pas[a-z]|[a-z]?pass[a-z]?)"
              r"[ _.-](?:w[a-z]{2,4}|c[a-z]{2,4}|phrase)|[a-z]{3,5}[ _.-](?:word|code|phrase))(?![a-z])")
# The exact letters with separators among them.
SPLIT = (r"(?<![a-z])p[ _.-]?a[ _.-]?s[ _.-]?s[ _.-]?"
         r"(?:w[ _.-]?o[ _.-]?r[ _.-]?d|c[ _.-]?o[ _.-]?d[ _.-]?e)(?![a-z])")

# Words that follow "is" or "to" in ordinary sentences about passwords.
ORDINARY = ("something", "anything", "nothing", "empty", "wrong", "weak", "strong", "stronger",
            "better", "required", "needed", "incorrect", "invalid", "expired", "correct", "blank",
            "missing", "forgotten", "lost", "hidden", "shown", "case-sensitive", "case", "saved",
            "stored", "changed", "reset", "used", "good", "safe", "secure", "recommended", "what",
            "that", "this", "there", "your", "their", "kept", "private", "very", "really", "still",
            "never", "always", "known", "here", "sent", "different", "longer", "short", "long",
            "simple", "easy", "hard", "unique", "manager", "field", "policy", "please", "gmail",
            "where", "which", "how", "who", "being", "been", "with", "also", "only", "just", "about", "from", "when", "must")



def lower_ascii(c: str) -> str:
    """Lower-case A-Z only: keeps the length, so offsets stay valid."""
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def fold_leet(c: str) -> str:
    """`p@ssw0rd` to `password`; one to one on lower-case text. ``translate`` would look up every character."""
    for sign, letter in zip("@0135$7", "aolesst"):
        c = f"replace({c}, '{sign}', '{letter}')"
    return c


def is_ordinary(v: str) -> str:
    return f"{lower_ascii(v)} IN ({', '.join(lit(w) for w in ORDINARY)})"


def edit_cap(length: str) -> str:
    """Allowed edits for a word: none under 4 letters, one up to 5, else two."""
    return f"if({length} < 4, 0, if({length} <= 5, 1, 2))"


def is_cue(word: str, cap: int = 2) -> str:
    near = " OR ".join(f"levenshtein({word}, '{cue}', {cap}) >= 0" for cue in CUES)
    return f"(({near}) AND {word} NOT IN ({', '.join(lit(w) for w in NOT_CUES)}))"


def folded(text: str) -> str:
    """The reading in which trigger words are looked for. One-to-one folding keeps offsets; both translations only
    where there is something to fold."""
    lowered = f"if(contains({text}, 'İ'), {lower_ascii(text)}, lower({text}))"
    return let(lowered, lambda x: f"if(rlike({x}, '[@0135$7]'), {fold_leet(x)}, {x})")


def _cue_searches(low: str) -> list[tuple[str, Callable[[str], str], str]]:
    """Pattern, test of a match and cheaper gate of the three forms of a trigger word, for a folded text."""
    def joined(w: str) -> str:
        return let(f"regexp_replace({w}, '[ _.-]', '')", lambda x: is_cue(x, 1))

    halves = " OR ".join(f"contains({low}, '{half}')" for half in (
        "pas", "ass", "pss", " word", " code", " phra", "-word", "-code", "_word", "_code"))
    separated = f"rlike({low}, 'p[ _.-]?a[ _.-]?s[ _.-]?s[ _.-]?[wc]')"
    parted = lambda w: f"({joined(w)} AND rlike({w}, '[ _.-]'))"
    return [(CANDIDATE, is_cue, "true"), (TWO_TOKENS, parted, halves), (SPLIT, parted, separated)]


def _cue_test(low: str, pattern: str, test: Callable[[str], str], gate: str) -> str:
    # The words alone are cheap; offsets are worked out only where one passes the test.
    w = var("w")
    return f"(({gate}) AND exists(regexp_extract_all({low}, {lit(pattern)}, 0), {w} -> {test(w)}))"


def has_cue(low: str) -> str:
    """Would :func:`find_cues` find anything in the text of this folded reading?"""
    return f"({' OR '.join(_cue_test(low, *search) for search in _cue_searches(low))})"


def find_cues(text: str) -> str:
    """Spans of approximate trigger words: one token, or up to three neighbours joined."""
    def search(low: str) -> str:
        def of(pattern: str, test: Callable[[str], str], gate: str) -> str:
            spans = keep(find_spans(low, pattern), lambda s: test(f"{s}.v"))
            return f"if({_cue_test(low, pattern, test, gate)}, {spans}, {NO_SPANS})"

        return f"concat({', '.join(of(*s) for s in _cue_searches(low))})"

    return let(folded(text), search)


def entropy(v: str) -> str:
    """Shannon entropy in bits per character."""
    c, a, q = var("c"), var("a"), var("q")
    freq = (f"transform(array_distinct(split({v}, '')), {c} -> "
            f"(length({v}) - length(replace({v}, {c}, ''))) / length({v}))")
    return (f"if(length({v}) = 0, 0D, aggregate({freq}, 0D, "
            f"({a}, {q}) -> if({q} > 0, {a} - {q} * log2({q}), {a})))")


def class_flags(v: str) -> dict[str, str]:
    return {"lowercase": f"rlike({v}, '[a-z]')", "uppercase": f"rlike({v}, '[A-Z]')",
            "digits": f"rlike({v}, '[0-9]')", "symbols": f"rlike({v}, '[^A-Za-z0-9]')"}


def looks_like_word(v: str) -> str:
    """Letters only, with a vowel and no run of four consonants."""
    return let(lower_ascii(v), lambda w: (
        f"(rlike({w}, '^[a-z]{{3,}}$') AND rlike({w}, '[aeiouy]') "
        f"AND NOT rlike({w}, '[^aeiouy]{{4}}'))"))


def is_hex(v: str) -> str:
    """Eight or more hexadecimal digits: no word, though `faccafbea` has the vowels of one."""
    return f"rlike({v}, '^[0-9A-Fa-f]{{8,}}$')"


def strength(v: str) -> str:
    """0..10: character classes, length, entropy and mix; ordinary words score low."""
    flags = class_flags(v)
    letters = f"({flags['lowercase']} OR {flags['uppercase']})"
    points = [*flags.values(), f"length({v}) >= 8", f"length({v}) >= 12", f"{entropy(v)} >= 2.5",
              f"{letters} AND {flags['digits']}", f"{letters} AND {flags['symbols']}"]
    total = " + ".join(f"int({p})" for p in points)
    return f"greatest(0, {total} - if({looks_like_word(v)}, 3, 0))"


def describe_secret(v: str) -> str:
    """`[SECRET: 9 chars; lowercase+digits; letters then digits]`: enough to judge, not to know."""
    def text(x: str) -> str:
        classes = ", ".join(f"if({c}, '{n}', NULL)" for n, c in class_flags(x).items())
        word = looks_like_word(f"regexp_extract({x}, '^([A-Za-z]+)', 1)")
        shape = (f"CASE WHEN rlike({x}, '^[0-9]+$') THEN 'digits only' "
                 f"WHEN rlike({x}, '^[A-Za-z]+$') THEN if({word}, 'one word', 'letters only') "
                 f"WHEN rlike({x}, '^[A-Za-z]+[0-9]+$') "
                 f"THEN if({word}, 'word then digits', 'letters then digits') "
                 f"WHEN rlike({x}, '^[0-9]+[A-Za-z]+$') THEN 'digits then letters' "
                 f"WHEN rlike({x}, '^[A-Za-z]+[^A-Za-z0-9]+[0-9]+$') "
                 f"THEN if({word}, 'word, symbols, digits', 'letters, symbols, digits') "
                 f"ELSE 'mixed' END")
        return (f"concat('[SECRET: ', length({x}), ' chars; ', concat_ws('+', {classes}), '; ', "
                f"{shape}, if(length({x}) < 8, ', shorter than 8 characters', ''), ']')")

    return let(v, text)


def finish_items(items: str) -> str:
    """Fill in the placeholders that depend on the value or on the other items.

    Secrets get their description; `[PERSON]` becomes `[PERSON_1]`, `[PERSON_2]` … by first
    appearance in this text.
    """
    word = "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in NUMBERED.items()) + ")"
    norm = lambda v: f"lower(trim(regexp_replace({v}, '\\\\s+', ' ')))"

    def numbered(own: str) -> str:
        i, o = var("i"), var("o")
        place = (f"array_position(array_distinct(transform(filter({own}, {o} -> {o}.cat = {i}.cat), "
                 f"{o} -> {norm(o + '.value')})), {norm(i + '.value')})")
        plain = f"if(rlike({i}.value, '^[A-Za-z0-9]( [A-Za-z0-9])+$'), replace({i}.value, ' ', ''), {i}.value)"
        ph = (f"CASE WHEN {i}.ph = '[SECRET]' THEN {describe_secret(plain)} "
              f"WHEN map_contains_key({word}, {i}.cat) "
              f"THEN concat('[', try_element_at({word}, {i}.cat), '_', {place}, ']') ELSE {i}.ph END")
        fields = ", ".join(f"'{f}', {i}.`{f}`" for f in
                           ("start", "end", "match", "value", "cat", "kind", "level", "layer", "ev"))
        return f"transform({own}, {i} -> named_struct({fields}, 'ph', {ph}))"

    return let(items, numbered)
