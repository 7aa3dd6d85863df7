"""Whitening against dense eigendecomposition, inertia counts, FEAST on ties and bad tables."""

import numpy as np
import pytest

from veil.llm.whitening import above, feast, intervals, leading, whiten

FIELDS = "vec_id long, embedding array<float>, n int, x string, i int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], FIELDS).repartition(4)


def vectors():
    rng = np.random.default_rng(2)
    data = (rng.standard_normal((300, 12)) * np.linspace(0.1, 1, 12)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third are copies
    bad = [(2000, None), (2001, [None] + [0.5] * 11), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11),
           (2004, [1.0] * 5), (2005, []), (2006, [3e38] * 12)]
    rows += [(3000, [0.0] * 12), (None, rows[1][1]), (3, rows[4][1]), (3, rows[4][1])]
    return rows, bad


def test_dense_reference(spark):
    rows, bad = vectors()
    got = whiten(frame(spark, rows + bad), components=8).collect()
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    e, q = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, q = e[::-1], q[:, ::-1]
    want = ((x - sums / n) @ q[:, :8]) / np.sqrt(e[:8])
    assert len(got) == 8 * len(rows) and {r["n"] for r in got} == {n}
    signs = {}
    spread = ((n * x - sums) ** 2).sum(axis=1)
    expected = sorted(((-1 if i is None else i), int(s), tuple(w)) for (i, _), s, w in zip(rows, spread, want, strict=True))
    by_row = {}
    for r in got:
        by_row.setdefault((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"]), {}).setdefault(
            r["component"], set()).add(r["whitened"])
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-12 and r["identity_error"] < 1e-9
    for key, s, w in expected:
        for c in range(1, 9):
            value, = by_row[key, s][c]
            signs.setdefault(c, np.sign(value * w[c - 1]))
            assert value * signs[c] == pytest.approx(w[c - 1], abs=1e-9)


@pytest.mark.parametrize("values", [
    [5.0] * 10 + [3.0] * 10 + [0.0] * 10, [1.0] * 12, [1e4] + [1 + 1e-9 * i for i in range(20)] + [1e-3] * 9,
    list(np.geomspace(1e6, 1e-6, 25)), [7.0]])
def test_inertia_and_ties(spark, values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    want = np.sort(values)[::-1]
    for s in np.linspace(-1.017, want[0] * 1.01 + 0.3, 23):
        assert above(v, s) == (want > s).sum()
    parts = intervals(v, 16)
    assert all(len(feast(v, *p)[0]) == p[2] for p in parts)
    e, axes = leading(spark, v, 16)
    assert np.allclose(e, [w for w in want if w > 1e-9][:16], atol=1e-13 * d * want[0], rtol=0)
    assert np.abs(axes.T @ axes - np.eye(len(e))).max() < 1e-12
    assert np.abs(v @ axes - axes * e).max() < 1e-12 * d * want[0]


def test_no_spread_and_empty(spark):
    same = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    for df in (same, same.limit(0), same.where("vec_id = 1"), frame(spark, vectors()[1][:4])):
        out = whiten(df)
        assert out.collect() == [] and "whitened" in out.columns


def test_low_rank(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]
    out = whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in out} == {1} and len(out) == 9 and out[0]["explained"] == pytest.approx(1)


def test_large_deviation_is_null(spark):
    rows = [(i, [2.0 ** 44 * (i + 1), float(i)]) for i in range(4)]
    out = whiten(frame(spark, rows).drop("n")).collect()
    assert {r["vec_id"]: r["deviation"] for r in out} == {0: None, 1: 0, 2: None}  # 3: an entry of 53 bits
