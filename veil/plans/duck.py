"""Pieces of checking SQL (DuckDB dialect), written apart from the Spark side.

The checking engine has no look-around in regular expressions, so tokens are taken whole and then
filtered by shape.
"""

from __future__ import annotations


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spans(source: str, key: str, text: str, pattern: str) -> str:
    """Rows (key, s, e, v) for every match of a pattern."""
    return f"""SELECT {key}, CAST(b AS INT) AS s, CAST(b + length(v) AS INT) AS e, v FROM (
  SELECT {key}, m[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS b
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT {key}, regexp_extract_all({text}, {q(pattern)}) AS m,
      string_split_regex({text}, {q(pattern)}) AS g FROM {source}) WHERE len(m) > 0))"""


def luhn(v: str) -> str:
    digit = f"CAST(substr(reverse({v}), i, 1) AS INT)"
    return (f"list_sum(list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN i % 2 = 1 "
            f"THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0")


def entropy(v: str) -> str:
    p = f"(length({v}) - length(replace({v}, c, ''))) / length({v})"
    return f"list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: -({p}) * log2({p})))"


def word_like(v: str) -> str:
    w = f"lower({v})"
    return (f"(regexp_full_match({w}, '[a-z]{{3,}}') AND regexp_matches({w}, '[aeiouy]') "
            f"AND NOT regexp_matches({w}, '[^aeiouy]{{4}}'))")


def describe(v: str) -> str:
    head = f"regexp_extract({v}, '^([A-Za-z]+)', 1)"
    return f"""('[SECRET: ' || length({v}) || ' chars; ' || concat_ws('+',
  CASE WHEN regexp_matches({v}, '[a-z]') THEN 'lowercase' END,
  CASE WHEN regexp_matches({v}, '[A-Z]') THEN 'uppercase' END,
  CASE WHEN regexp_matches({v}, '[0-9]') THEN 'digits' END,
  CASE WHEN regexp_matches({v}, '[^A-Za-z0-9]') THEN 'symbols' END) || '; ' || CASE
  WHEN regexp_full_match({v}, '[0-9]+') THEN 'digits only'
  WHEN regexp_full_match({v}, '[A-Za-z]+') THEN CASE WHEN {word_like(v)} THEN 'one word' ELSE 'letters only' END
  WHEN regexp_full_match({v}, '[A-Za-z]+[0-9]+') THEN CASE WHEN {word_like(head)} THEN 'word then digits' ELSE 'letters then digits' END
  WHEN regexp_full_match({v}, '[0-9]+[A-Za-z]+') THEN 'digits then letters'
  ELSE 'mixed' END || CASE WHEN length({v}) < 8 THEN ', shorter than 8 characters' ELSE '' END || ']')"""


def item(source: str, key: str, where: str, cat: str, kind: str, level: str, ph: str) -> str:
    """Rows (key, s, e, v, cat, kind, level, ph) of one detector."""
    return (f"SELECT {key}, s, e, v, {q(cat)} AS cat, {q(kind)} AS kind, {q(level)} AS level, "
            f"{ph} AS ph FROM ({source}) WHERE {where}")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
LONG = r"[A-Za-z0-9_+/=-]{20,}"
ASSIGN = r'[A-Za-z_][A-Za-z0-9_]* ?[=:] ?"[^"\n]+"'
IS_IP = (r"regexp_full_match(v, '[0-9]{1,3}(\.[0-9]{1,3}){3}') AND list_max(list_transform("
         r"string_split(v, '.'), lambda x: TRY_CAST(x AS INT))) <= 255")


def items(source: str, key: str, text: str = "text", accounts: bool = True) -> str:
    """Everything that the detectors find in the given texts, as rows.

    Only the layers that find something in these tables are spelled out here.
    """
    of = lambda p: spans(source, key, text, p)
    value = "regexp_extract(v, '\"([^\"]+)\"$', 1)"
    named = (f"SELECT {key}, CAST(e - 1 - length({value}) AS INT) AS s, CAST(e - 1 AS INT) AS e, "
             f"{value} AS v FROM ({of(ASSIGN)}) WHERE regexp_matches(lower(regexp_extract(v, "
             f"'^[A-Za-z0-9_]+')), 'password|passwd|pwd|secret|token|api_?key|credential|auth')")
    parts = [
        item(of(EMAIL), key, "true", "EMAIL", "E-mail address", "high", "'[EMAIL]'"),
        item(of("[0-9]+"), key, f"length(v) BETWEEN 13 AND 19 AND {luhn('v')}", "CARD",
             "Payment card", "high", "'[CARD]'"),
        item(of(PHONE), key, "true", "PHONE", "Phone number", "high", "'[PHONE]'"),
        item(of(r"[0-9]+(?:\.[0-9]+)+"), key, IS_IP, "IP", "IP address", "high", "'[IP]'"),
        item(named, key, "true", "SECRET", "Named secret", "high", describe("v")),
        item(of(LONG), key, f"regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') "
             f"AND {entropy('v')} >= 3.0", "SECRET", "High-entropy string", "high", describe("v")),
    ]
    if accounts:
        parts.append(item(of("[0-9]+"), key, "length(v) >= 11", "ACCOUNT",
                          "Long number", "medium", "'[ACCOUNT]'"))
    return "\nUNION ALL ".join(parts)


def kept(items_name: str, key: str) -> str:
    """Greedy overlap resolution of item rows: one list ``k`` per key."""
    one = ("struct_pack(s := s, r := CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, "
           "n := -e, cat := cat, kind := kind, e := e, v := v, ph := ph, level := level)")
    typed = ("[]::STRUCT(s INTEGER, r INTEGER, n INTEGER, cat VARCHAR, kind VARCHAR, e INTEGER, "
             "v VARCHAR, ph VARCHAR, level VARCHAR)[]")
    return f"""SELECT {key}, list_reduce(list_sort(list({one})), lambda k, i: CASE
  WHEN len(k) = 0 OR k[-1].e <= i.s THEN list_append(k, i) ELSE k END, {typed}) AS k
  FROM {items_name} GROUP BY {key}"""


def rebuilt(text: str, k: str) -> str:
    """The text with the kept items replaced."""
    done = (f"list_reduce({k}, lambda z, i: struct_pack(o := z.o || substr({text}, z.c + 1, i.s - z.c) "
            f"|| i.ph, c := i.e), struct_pack(o := '', c := 0))")
    return f"(({done}).o || substr({text}, ({done}).c + 1))"


def clean_ctes(source: str, key: str, text: str = "text", accounts: bool = True) -> str:
    """CTEs items, kept and clean(key, text, k) over one source."""
    return f"""items AS ({items(source, key, text, accounts)}),
kept AS ({kept('items', key)}),
clean AS (SELECT t.{key}, coalesce({rebuilt('t.' + text, 'k')}, t.{text}, '') AS clean,
  t.{text} AS raw, k FROM {source} t LEFT JOIN kept USING ({key}))"""


PLACEHOLDER_CLASS = (r"CASE WHEN ph LIKE '[SECRET:%' THEN '[SECRET]' "
                     r"ELSE regexp_replace(ph, '_[0-9]+\]$', ']') END")
