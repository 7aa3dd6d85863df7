"""Terms found by one pattern of their first words, against a plain scan."""

import re

from veil.operators import terms

TEXTS = [(1, "Project Falcon two and project  falcon. C++ and c, xC++, C++x, @home a@home @homes"), (2, ""), (3, None),
         (4, "ab ab-ab abab AB"), (5, "falcon " * 300 + "project falcon"), (6, "new york new york city, (new york)")]
TERMS = ["Project Falcon", "project falcon two", "falcon", "c++", "@home", "ab", "ab-ab", "new york", "York New",
         "new york city", "x", "--", None, "ab", "(new york)"]


def brute(texts, wanted):
    out = set()
    for key, text in texts:
        low = (text or "").lower()
        for term in {t.lower() for t in wanted if t and len(t) >= 2 and re.search("[A-Za-z0-9]", t)}:
            for at in range(len(low)):
                end = at + len(term)
                if low.startswith(term, at) and not re.match("[a-z0-9]", low[at - 1:at]) and not re.match(
                        "[a-z0-9]", low[end:end + 1]):
                    out.add((key, term, at, end))
    return out


def test_terms_by_trie_and_by_semi_join(spark):
    texts = spark.createDataFrame(TEXTS, "doc_id int, text string")
    wanted = spark.createDataFrame([(t,) for t in TERMS], "term string")
    expected = brute(TEXTS, TERMS)
    for most_first in (2000, 1):
        got = [tuple(r) for r in terms.match_terms(texts, wanted, most_first=most_first).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_texts_meet_only_the_terms(spark):
    texts = spark.createDataFrame(TEXTS, "doc_id int, text string")
    wanted = spark.createDataFrame([("new york",)], "term string")
    plan = terms.match_terms(texts, wanted)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_no_terms_no_texts(spark):
    none = spark.createDataFrame([], "term string")
    texts = spark.createDataFrame(TEXTS, "doc_id int, text string")
    assert terms.match_terms(texts, none).count() == 0
    assert terms.match_terms(texts.limit(0), none.union(spark.createDataFrame([("ab",)], "term string"))).count() == 0


def test_trie_pattern_takes_the_longest():
    pattern = re.compile(f"(?:{terms.trie_pattern(['car', 'cart', 'c.t', 'dog'])})")
    assert pattern.findall("cart car c.t cat dog") == ["cart", "car", "c.t", "dog"]


def test_places_do_not_count_from_the_start_of_the_text(spark):
    texts = spark.createDataFrame(TEXTS, "doc_id int, text string")
    for term in ("york", "new york", "new york!"):
        wanted = spark.createDataFrame([(term,)], "term string")
        for most_first in (2000, 0):
            plan = terms.match_terms(texts, wanted, most_first=most_first)._jdf.queryExecution().analyzed().toString()
            assert "substring(lower" not in plan and "substring(lambda" not in plan


def test_code_points_beside_terms(spark):
    rows = [(1, "😀new\n york😀 new york x😀york"), (2, "😀" * 50 + " york? new york?")]
    texts = spark.createDataFrame(rows, "doc_id int, text string")
    for wanted in (["york", "new"], ["new york", "york?", "york"]):
        df = spark.createDataFrame([(t,) for t in wanted], "term string")
        for most_first in (2000, 0):
            assert {tuple(r) for r in terms.match_terms(texts, df, most_first=most_first).collect()} == brute(rows, wanted)
