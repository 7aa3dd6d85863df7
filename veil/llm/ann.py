"""Nearest neighbours by collision counting over query-aware single-projection hashes.

Vectors are dealt into blocks by id. In a block every random projection is one sorted array of values.
A query's bucket in a projection is a window centred on its own value; at radius R its half width is
w * R / 2, and R grows by a factor (virtual rehashing) without any new hashing. A vector collides in a
projection when it lies in the window; one that collides in at least ``threshold`` projections is
verified with its exact distance in double precision. A query is done in a block when the k-th verified
distance is at most the radius that the windows guarantee (``reach`` * R), or all vectors are verified,
so there is no cap on candidates. The k nearest per block are merged over blocks.

Queries travel to the blocks, in groups of bounded size; nothing is broadcast and no block or group
grows with the table. Equal vectors have equal projections and all collide together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veil.llm.store import table


class Projections:
    """Sorted projection arrays of one block of vectors."""

    def __init__(self, vectors: np.ndarray, m: int, seed: int = 7):
        self.vectors = vectors
        self.axes = np.random.default_rng(seed).standard_normal((m, vectors.shape[1]))
        values = self.axes @ vectors.T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=1)

    def search(self, query: np.ndarray, k: int, width: float, threshold: int, start: float, grow: float,
               reach: float, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the verified vectors, all within the k-th nearest found included."""
        m, n = self.sorted.shape
        centre = self.axes @ query
        hits = np.zeros(n, dtype=np.int32)
        dist = np.full(n, np.inf)
        done = np.zeros(n, dtype=bool)
        if skip is not None:
            done[skip] = True
        low = np.array([np.searchsorted(self.sorted[j], centre[j]) for j in range(m)])
        high, radius = low.copy(), start
        wanted = min(k, n - int(done.sum()))
        while True:
            half = width * radius / 2
            new = []
            for j in range(m):
                a = int(np.searchsorted(self.sorted[j], centre[j] - half, side="left"))
                b = int(np.searchsorted(self.sorted[j], centre[j] + half, side="right"))
                a, b = min(a, low[j]), max(b, high[j])
                new += [self.order[j, a:low[j]], self.order[j, high[j]:b]]
                low[j], high[j] = a, b
            hits += np.bincount(np.concatenate(new), minlength=n).astype(np.int32)
            fresh = np.flatnonzero((hits >= threshold) & ~done)
            if len(fresh):
                dist[fresh] = np.sqrt(((self.vectors[fresh] - query) ** 2).sum(axis=1))
                done[fresh] = True
            found = np.isfinite(dist)
            if found.sum() >= wanted and (
                    wanted == 0 or np.partition(dist, wanted - 1)[wanted - 1] <= reach * radius):
                break
            if done.all():
                break
            radius *= grow
        at = np.flatnonzero(found)
        return at, dist[at]


def _search_block(k: int, m: int, threshold: int, width: float, grow: float, reach: float):
    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if vectors.empty or queries.empty:
            return pd.DataFrame({c: [] for c in columns}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"})
        data = np.array(vectors["vector"].tolist(), dtype=np.float64)
        ids = vectors["row_id"].to_numpy()
        asked = np.array(queries["vector"].tolist(), dtype=np.float64)
        index = Projections(data, m)
        # The first radius: a tenth of the spread that two vectors of this block have.
        start = max(1e-9, 0.1 * float(np.sqrt(2 * data.var(axis=0).sum())))
        own = {int(i): p for p, i in enumerate(ids)}
        out = []
        for q, vector in zip(queries["row_id"].to_numpy(), asked, strict=True):
            at, dist = index.search(vector, k, width, threshold, start, grow, reach, own.get(int(q)))
            best = np.lexsort((ids[at], dist))[:k]
            out.append(pd.DataFrame({"query_id": np.full(len(best), q), "vec_id": ids[at][best],
                                     "score": dist[best]}))
        return pd.concat(out)[columns]

    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """row_id and vector of rows with an id and a non-zero vector of finite components."""
    v = F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.select(F.col(id_col).cast("long").alias("row_id"), v.alias("vector")).where(
        F.col("row_id").isNotNull() & F.col("vector").isNotNull()
        & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
            k: int = 10, block_rows: int = 8192, query_rows: int = 1024, m: int = 48, threshold: int = 31,
            width: float = 2.0, grow: float = 1.3, reach: float = 1.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every query row, nearest first.

    ``is_query`` is a condition on ``row_id``. Ties go to the smaller id. Vectors that are null, zero or
    hold null or non-finite components, rows with a null id, take no part; neither does the query's own
    row. Of vectors of different lengths those of the commonest length take part (of equally common ones the
    longest). Rows that repeat an id are one row (the first by value).
    Fewer candidates than k: all of them. An empty table gives no rows.
    """
    rows = usable(vectors, id_col, vec_col).groupBy("row_id").agg(F.min("vector").alias("vector"))
    counted = (rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"))
               .orderBy(F.desc("n"), F.desc("d")).first())
    d, n, q = (counted["d"], counted["n"], counted["q"]) if counted else (0, 0, 0)
    rows = rows.where(F.size("vector") == d)
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-q // query_rows))
    spread = F.xxhash64("row_id")
    data = (rows.withColumn("block", F.pmod(spread, F.lit(blocks)))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    asked = (rows.where(is_query).withColumn("part", F.pmod(spread, F.lit(groups)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    found = data.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(
        _search_block(k, m, threshold, width, grow, reach), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("row_id") % 100 == 0)
