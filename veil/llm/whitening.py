"""Whitening of embeddings by FEAST: eigenpairs of the covariance from contour integrals.

Vectors become integers and are made distinct; counts, sums and centred products are summed per input batch and
then over all, so only numbers of the size of the dimension squared reach the driver, whatever the number of
rows. The eigenvalues asked for are enclosed by intervals: the inertia of ``V - s I`` (signs of an LDL'
factorisation) counts those above s, and bisection by these counts finds ends between eigenvalues. Each
interval is one Spark task: Gauss-Legendre nodes on the circle over it give complex shifted solves, whose
weighted sum projects a block of vectors onto the interval's eigenspace; Rayleigh-Ritz in that space gives
Ritz pairs, and the projection repeats until their residuals are at rounding level and as many lie in the
interval as the inertia says. Otherwise it goes on with a wider block, so no component is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veil.llm.store import keep, table

BATCH = 4096


def negative_pivots(a: np.ndarray) -> int:
    """Negative eigenvalues of a symmetric matrix: signs of D in LDL' with Bunch-Kaufman pivots of order 1 and 2."""
    a, edge, below = np.array(a, dtype=np.float64), (1 + 17 ** 0.5) / 8, 0
    while len(a):
        n = len(a)
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if n > 1 else 0
        most = column[r - 1] if n > 1 else 0.0
        if most == 0:
            below += a[0, 0] < 0
            a = a[1:, 1:]
            continue
        swap, pair = 0, False
        if abs(a[0, 0]) < edge * most:
            others = np.abs(a[r])
            others[r] = 0
            other = others.max()
            if abs(a[0, 0]) * other >= edge * most * most:
                pass
            elif abs(a[r, r]) >= edge * other:
                swap = r
            else:
                pair = True
        order = np.arange(n)
        if pair:
            order[[1, r]] = order[[r, 1]]
        elif swap:
            order[[0, swap]] = order[[swap, 0]]
        a = a[np.ix_(order, order)]
        k = 2 if pair else 1
        if pair:
            below += 1 if a[0, 0] * a[1, 1] - a[0, 1] ** 2 < 0 else 2 * (a[0, 0] < 0)
        else:
            below += a[0, 0] < 0
        side = a[k:, :k]
        a = a[k:, k:] - side @ np.linalg.solve(a[:k, :k], side.T)
        a = (a + a.T) / 2
    return int(below)


def above(v: np.ndarray, s: float) -> int:
    """Eigenvalues of v above s."""
    return negative_pivots(s * np.eye(len(v)) - v)


def border(v: np.ndarray, low: float, high: float, slack: float) -> tuple[float, int] | None:
    """A point between low and high, away from all eigenvalues by ``slack``, and the number above it."""
    for share in (0.5, 0.382, 0.618, 0.25, 0.75, 0.146, 0.854):
        s = low + share * (high - low)
        if (n := above(v, s + slack)) == above(v, s - slack):
            return s, n
    return None


def intervals(v: np.ndarray, wanted: int, most: int = 6) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), falling: the largest ``wanted`` eigenvalues and maybe some below.

    Halves by inertia until an interval has at most ``most`` eigenvalues or is too narrow to be split.
    """
    top = float(np.abs(v).sum(axis=1).max())
    slack = 1e-13 * top
    todo, out, found = [(-top / 8, top * 1.125, 0, len(v))], [], 0
    while todo and found < wanted:
        low, high, n_high, n_low = todo.pop()
        if n_low == n_high:
            continue
        at = border(v, low, high, slack) if n_low - n_high > most and high - low > 64 * slack else None
        if at is None:
            out.append((low, high, n_low - n_high))
            found += n_low - n_high
        else:
            todo += [(low, at[0], at[1], n_low), (at[0], high, n_high, at[1])]
    return out


def feast(v: np.ndarray, low: float, high: float, inside: int, nodes: int = 8, rounds: int = 60,
          seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of v in [low, high], which holds ``inside``."""
    d, norm = len(v), max(float(np.abs(v).sum(axis=1).max()), np.finfo(float).tiny)
    centre, radius = (low + high) / 2, (high - low) / 2
    x, weight = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(1j * np.pi / 2 * (1 + x))
    inverses = [np.linalg.inv((centre + radius * t) * np.eye(d) - v) for t in turn]
    rng = np.random.default_rng(seed)
    wide = min(d, 2 * inside + 4)
    y = rng.standard_normal((d, wide))
    for r in range(rounds):
        q = sum(w / 2 * radius * (t * (inv @ y)).real for t, w, inv in zip(turn, weight, inverses, strict=True))
        u, s, _ = np.linalg.svd(q, full_matrices=False)
        u = u[:, s > s[0] * 1e-13] if s[0] > 0 else u
        values, ritz = np.linalg.eigh(u.T @ v @ u)
        vectors = u @ ritz
        within = (values >= low) & (values <= high)
        residual = np.linalg.norm(v @ vectors - vectors * values, axis=0)
        if within.sum() == inside and residual[within].max(initial=0) <= 8 * d ** 0.5 * np.finfo(float).eps * norm:
            return values[within][::-1], vectors[:, within][:, ::-1]
        if r % 4 == 3:  # too narrow a block, or one that lost directions
            wide = min(d, wide + max(2, wide // 2))
        y = np.concatenate([vectors, rng.standard_normal((d, max(0, wide - vectors.shape[1])))], axis=1)
    raise ArithmeticError(f"eigenvalues in [{low}, {high}]: {int(within.sum())} of {inside} found")


def leading(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (falling) and eigenvectors (columns) of v; one Spark task per interval.

    Values at rounding level of the trace count as zero and are left out.
    """
    parts = intervals(v, min(wanted, len(v)))
    if not parts or not v.any():
        return np.zeros(0), np.zeros((len(v), 0))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.itertuples():
                values, vectors = feast(v, p.low, p.high, p.inside)
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    asked = spark.createDataFrame(parts, "low double, high double, inside int").repartition(len(parts), "low")
    got = asked.mapInPandas(solve, "value double, vector array<double>").collect()
    # One Ritz step over all intervals: vectors of close intervals become orthogonal to rounding.
    basis, _ = np.linalg.qr(np.array([r["vector"] for r in got]).T)
    values, ritz = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-values, kind="stable")[:wanted]
    order = order[values[order] > 8 * len(v) * np.finfo(float).eps * np.trace(v)]
    return values[order], (basis @ ritz)[:, order]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            yield b.slice(at, BATCH)


def _summed(of, count: int):
    """Per task the sum of ``of(x)``, a matrix of ``count`` columns, as rows (i, values)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in _slices(batches):
            one = of(_matrix(b.column(0)))
            total = one if total is None else total + one
        if total is not None:
            for at in range(0, len(total), 256):
                some = total[at:at + 256]
                i = np.repeat(np.arange(at, at + len(some)), count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i, pa.int32()), pa.array(np.tile(np.arange(count), len(some)), pa.int32()),
                     pa.array(some.ravel())], names=["i", "j", "value"])

    return run


def _total(x: DataFrame, of, rows: int, count: int, kind: str) -> np.ndarray:
    """The sum over all rows, rows x count numbers; added up by Spark per number."""
    wide = "decimal(38,0)" if kind == "long" else "double"
    got = (x.mapInArrow(_summed(of, count), f"i int, j int, value {kind}")
           .groupBy("i", "j").agg(F.sum(F.col("value").cast(wide)).alias("value")).collect())
    out = np.zeros((rows, count), dtype=object if kind == "long" else np.float64)
    for r in got:
        out[r["i"], r["j"]] = int(r["value"]) if kind == "long" else r["value"]
    return out


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int, shift: int) -> DataFrame:
    """id and x, floor(scale * c) + shift of each entry c, of rows whose vector is usable.

    A vector is not usable if it is null, holds a null or an entry whose x does not fit 53 bits (also one
    that is not finite).
    """
    c = lambda e: F.floor(e.cast("double") * scale)
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * scale) < 2.0 ** 52)
    return (vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
            .where(F.col("v").isNotNull() & F.forall("v", fine) & (F.size("v") > 0))
            .select("id", F.transform("v", lambda e: c(e) + shift).alias("x")))


def _spread(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n x - S) ** 2 by row, exact; null where it does not fit a long."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    most = max(abs(n * v - int(s)) for s in (sums.min(), sums.max()) for v in (low, high))
    if len(sums) * most * most < 2 ** 63:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
    return [int(v) if v < 2 ** 63 else None for v in exact]


def _whiten(n: int, sums: np.ndarray, basis: np.ndarray, explained: np.ndarray, error: float, id_type: pa.DataType):
    """(id, x) batches to one row per row and component."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = (sums / n).astype(np.float64)
        for b in _slices(batches):
            x = _matrix(b.column(1))
            each = np.repeat(np.arange(b.num_rows), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)).cast(id_type),
                 pa.array(np.tile(np.arange(1, k + 1), b.num_rows), pa.int32()),
                 pa.array(np.full(len(each), n), pa.int64()),
                 pa.array(_spread(x, n, sums), pa.int64()).take(pa.array(each)),
                 pa.array(((x - mean) @ basis).ravel()), pa.array(np.tile(explained, b.num_rows)),
                 pa.array(np.full(len(each), error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16,
           scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error by row and component.

    Each entry c becomes x = floor(scale * c) + shift. Mean and covariance are over the distinct x vectors
    (n of them, sums S); components are unit eigenvectors by falling eigenvalue, at most ``components`` and
    as many as the covariance's numerical rank: with one distinct vector there are none and no row is given.
    ``deviation`` is the sum over dimensions of (n x - S) ** 2, null where it exceeds a long. ``whitened``
    is x - S / n on the component over the root of its eigenvalue, ``explained`` the eigenvalue over the trace,
    ``identity_error`` the largest entry of whitened's measured covariance minus the identity. Rows whose
    vector is null, empty or holds a null or non-finite entry are left out, and so are vectors of another
    length than the commonest (of equally common ones the longest). Null ids and repeated rows are kept; other
    columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vec_col, scale, shift)
    fit = keep(rows.select("x").distinct(), "fit")
    kind = vectors.schema[id_col].dataType
    columns = (f"id {kind.simpleString()}, component int, n long, deviation long, whitened double, "
               "explained double, identity_error double")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    rows, fit = rows.where(F.size("x") == d), fit.where(F.size("x") == d)
    n = fit.count()
    basis = np.zeros((d, 0))
    if n:
        sums = _total(fit, lambda x: x.sum(axis=0, keepdims=True).T, d, 1, "long")[:, 0]
        mean = (sums / n).astype(np.float64)
        products = _total(fit, lambda x: (x - mean).T @ (x - mean), d, d, "double")
        v = (products + products.T) / (2 * n)
        values, axes = leading(spark, v, components)
        basis = axes / np.sqrt(values)
    if not basis.shape[1]:
        return spark.createDataFrame([], columns).withColumnRenamed("id", id_col)
    k = basis.shape[1]

    def whitened(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ basis
        return np.concatenate([w.sum(axis=0, keepdims=True), w.T @ w])

    seen = _total(fit, whitened, k + 1, k, "double") / n
    error = float(np.abs(seen[1:] - np.outer(seen[0], seen[0]) - np.eye(k)).max())
    return rows.mapInArrow(_whiten(n, sums, basis, values / np.trace(v), error, to_arrow_type(kind)),
                           columns).withColumnRenamed("id", id_col)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
