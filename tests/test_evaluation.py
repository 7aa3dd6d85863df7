"""Span matching against a plain greedy version."""

import random

from veil.operators.evaluation import span_outcomes, span_scores

SCHEMA = "doc_id int, start int, end int, cat string"


def plain(found, truth):
    out = []
    for doc in sorted({r[0] for r in found + truth}):
        fs = sorted({r[1:] for r in found if r[0] == doc})
        ts = sorted({r[1:] for r in truth if r[0] == doc})
        pairs = sorted((a[:2] != b[:2], a[2] != b[2], max(a[0], b[0]) - min(a[1], b[1]), i, j)
                       for i, a in enumerate(ts) for j, b in enumerate(fs) if max(a[0], b[0]) < min(a[1], b[1]))
        mine, theirs = {}, set()
        for *_, i, j in pairs:
            if i not in mine and j not in theirs:
                mine[i] = fs[j]
                theirs.add(j)
        for i, (s, e, c) in enumerate(ts):
            b = mine.get(i)
            what = ("missed" if b is None else "cut_short" if b[0] > s or b[1] < e else
                    "wrong_category" if b[2] != c else "caught" if b[:2] == (s, e) else "wide")
            out.append((doc, s, e, c, what))
        out += [(doc, *f, "false_alarm") for j, f in enumerate(fs) if j not in theirs]
    return sorted(out)


def test_outcomes_against_plain(spark):
    rng = random.Random(5)

    def some(n):
        rows = []
        for _ in range(n):
            s = rng.randrange(60)
            rows.append((rng.randrange(12), s, s + rng.randrange(1, 12), rng.choice("AB")))
        return rows

    found, truth = some(150), some(150)
    found += truth[:40] + found[:5]
    got = span_outcomes(spark.createDataFrame(found, SCHEMA), spark.createDataFrame(truth, SCHEMA), ("doc_id",))
    assert sorted(tuple(r) for r in got.collect()) == plain(found, truth)
    scores = {r["cat"]: r for r in span_scores(got).collect()}
    rows = plain(found, truth)
    for cat in "AB":
        assert scores[cat]["positives"] == sum(r[3] == cat and r[4] != "false_alarm" for r in rows)
        assert scores[cat]["missed"] == sum(r[3] == cat and r[4] == "missed" for r in rows)


def test_nulls_and_empty(spark):
    one = spark.createDataFrame([(1, 2, 5, None), (1, None, 5, "A"), (None, 1, 2, "A"), (2, 4, 4, "A")], SCHEMA)
    none = one.limit(0)
    rows = lambda a, b: [tuple(r) for r in span_outcomes(a, b, ("doc_id",)).collect()]
    assert rows(none, none) == []
    assert rows(one, none) == [(1, 2, 5, None, "false_alarm")]
    assert rows(none, one) == [(1, 2, 5, None, "missed")]
    assert rows(one, one) == [(1, 2, 5, None, "caught")]
