"""Merkle manifest against a brute-force tree, and folding by retained states against rebuilding."""

import hashlib
import random
import zlib

import pytest

from veil.llm.merkle import Level, manifest, resume


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grow(nodes, fan_out):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i:i + fan_out]) for i in range(0, len(out[-1]), fan_out)])
    return out


def siblings(tree, i, fan_out):
    out = []
    for nodes in tree[:-1]:
        run = i - i % fan_out
        out += [n for j, n in enumerate(nodes[run:run + fan_out], run) if j != i]
        i //= fan_out
    return out


def brute(rows, fan_out):
    """rows: (id, grp, leaf, changed)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, r[2],
                                       r[3] is not None, r[3] or ""))
    names = sorted({r[1] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    members = {g: [r for r in rows if r[1] == g] for g in names}
    trees = {g: grow([r[2] for r in members[g]], fan_out) for g in names}
    top = grow([trees[g][-1][0] for g in names], fan_out)
    out = []
    for at, g in enumerate(names):
        for i, r in enumerate(members[g]):
            changed = [x[2] for x in members[g]]
            changed[i] = r[3] or r[2]
            subs = [trees[n][-1][0] for n in names]
            subs[at] = grow(changed, fan_out)[-1][0]
            folded, root = grow(subs, fan_out)[-1][0], top[-1][0]
            proof = h(siblings(trees[g], i, fan_out) + siblings(top, at, fan_out))
            out.append((r[0], r[2], trees[g][-1][0], root, proof, folded, folded == root))
    return out


FIELDS = "doc_id long, grp string, leaf string, changed string, root string, pos long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], FIELDS).repartition(5)


@pytest.mark.parametrize("fan_out, most", [(2, 4), (2, 1024), (3, 9), (3, 27)])
def test_brute_force(spark, fan_out, most):
    rnd = random.Random(fan_out * most)
    groups = ["en"] * 60 + ["de"] * 17 + ["", None, None, None, "é", "z", "ß", "\U0001f600", "￿"]
    rows = [(i if i % 11 else None, g, h([str(i)]), h(["x", str(i)]) if i % 7 == 0 else None)
            for i, g in enumerate(groups)]
    rows += [rows[3]] * 4 + [(5, "en", h(["other"]), None)]  # repeated rows, one id twice
    rnd.shuffle(rows)
    got = [tuple(r) for r in manifest(table(spark, rows), fan_out=fan_out, most=most).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, fan_out), key=repr)


@pytest.mark.parametrize("rows", [[(1, "a", h("1"), None)], [(1, None, h("1"), h("2"))],
                                  [(1, "a", h("1"), None), (2, "a", h("2"), h("3"))]])
def test_small_tables(spark, rows):
    assert sorted(map(tuple, manifest(table(spark, rows)).collect())) == sorted(brute(rows, 2))


def test_empty_table(spark):
    assert manifest(table(spark, [(1, "a", "b", None)]).limit(0)).collect() == []


def test_states_fold_like_a_rebuild():
    children = [h([str(i)]) for i in range(11)]
    level = Level(children, 4)
    for i in range(11):
        left, right = level.siblings(i)
        assert resume(level.states[i], "new", "".join(right).encode()) == h([*left, "new", *right])
        assert resume(level.states[i], children[i], "".join(right).encode()) == level.parents[i // 4]


def test_leaf_fields(spark):
    from veil.llm.merkle import row_digest
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None, "", "é€"), (None, "s", None, None)], "a long, b string, c string, d string")
    got = [r[0] for r in df.select(row_digest([F.col(c) for c in "abcd"])).collect()]
    assert got == [h("1:1-0:5:é€"), h("-1:s--")]
    assert zlib.crc32(b"14") == df.select(F.crc32(F.lit("14"))).first()[0]
