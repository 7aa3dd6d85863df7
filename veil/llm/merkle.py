"""Merkle manifest of a table from retained SHA-256 states.

Rows are leaves of one tree per group; the group roots are the leaves of one more tree. The tree is built in
blocks of ``fan_out ** k`` consecutive nodes (4,096 for a fan-out of two): a block lies in one task, its root is
a node of the next round, and a few rounds reach one root. A parent absorbs its children one after the other
and retains a copy of its hash state before each child slot. Folding a node resumes its parent's state at
that slot with the replacement and absorbs the right siblings only, so a changed leaf costs one resumed
state a level, whatever lies to its left.

Ways down are handed from the top: a block gets, for every level above it, the siblings to its left and right
(left ones are absorbed once per block, and the state is copied for each fold). Positions come from a range
sort and counts per (group, partition); no group is sorted in one task, and a group with a third of all rows
is as many blocks as its rows need. Texts are read once; after that only digests move.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veil.llm.store import keep, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
GROUP, NODE_COLUMNS = ["has_grp", "grp"], ["has_grp", "grp", "pos", "node", "n"]
NODE = "has_grp boolean, grp string, pos long, node string, n long"


class Level:
    """Parents of one level: each retains its hash state before every child slot."""

    def __init__(self, children: list[str], fan_out: int):
        self.children, self.fan_out, self.states, self.parents = children, fan_out, [], []
        for at in range(0, len(children), fan_out):
            state = hashlib.sha256()
            for child in children[at:at + fan_out]:
                self.states.append(state.copy())
                state.update(child.encode())
            self.parents.append(state.hexdigest())

    def siblings(self, slot: int) -> tuple[list[str], list[str]]:
        """Children of the same parent to the left and to the right."""
        run = slot - slot % self.fan_out
        return self.children[run:slot], self.children[slot + 1:run + self.fan_out]


def levels(nodes: list[str], fan_out: int, rounds: int, alone: bool) -> list[Level]:
    """Levels above the nodes of a block: up to one node if the block is the whole tree, else ``rounds``."""
    out = []
    while (len(nodes) > 1) if alone else (len(out) < rounds):
        out.append(Level(nodes, fan_out))
        nodes = out[-1].parents
    return out


class Way:
    """The levels above one block: per level the state after the left siblings, and the right ones.

    As text: levels joined by commas, each the digests to the left, a colon, and those to the right.
    """

    def __init__(self, path: str):
        steps = [step.split(":") for step in path.split(",") if step]
        self.steps = [(hashlib.sha256(left.encode()), right.encode()) for left, right in steps]
        self.proof = "".join(left + right for left, right in steps).encode()

    def fold(self, node: str) -> str:
        for state, right in self.steps:
            node = resume(state, node, right)
        return node


def resume(state, node: str, right: bytes) -> str:
    """A retained state that goes on with the replacement and the right siblings."""
    state = state.copy()
    state.update(node.encode())
    state.update(right)
    return state.hexdigest()


def _block_levels(block: pd.DataFrame, fan_out: int, rounds: int) -> list[Level]:
    return levels(block["node"].tolist(), fan_out, rounds, bool(block["alone"].iloc[0]))


def _up(fan_out: int, rounds: int):
    """One block to its root: the node of the next round, where its group has ``n`` nodes."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        made = _block_levels(block, fan_out, rounds)
        first = block[["has_grp", "grp", "pos", "node", "n"]].head(1)
        root = made[-1].parents[0] if made else first["node"].iloc[0]
        size = fan_out ** rounds
        return first.assign(pos=first["pos"] // size, node=root, n=-(-first["n"] // size))

    return run


def _down(fan_out: int, rounds: int):
    """One block and the way above it to the ways above its nodes."""
    def run(key: tuple, block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        made = _block_levels(block, fan_out, rounds)
        paths = []
        for i in range(len(block)):
            path = []
            for level in made:
                left, right = level.siblings(i)
                path.append("".join(left) + ":" + "".join(right))
                i //= fan_out
            paths.append(",".join([*path, above["path"].iloc[0]]))
        return block[["has_grp", "grp", "pos"]].assign(path=paths)

    return run


def _fold(fan_out: int, rounds: int):
    """One block of leaves and the way above it: proof and folded root of every leaf."""
    def run(key: tuple, block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        made = _block_levels(block, fan_out, rounds)
        way = Way(above["path"].iloc[0])
        proofs, folded = [], []
        for i, (leaf, changed) in enumerate(zip(block["node"], block["changed"], strict=True)):
            node, own = changed if isinstance(changed, str) else leaf, []
            for level in made:
                left, right = level.siblings(i)
                own += left
                own += right
                node = resume(level.states[i], node, "".join(right).encode())
                i //= fan_out
            proofs.append(hashlib.sha256("".join(own).encode() + way.proof).hexdigest())
            folded.append(way.fold(node))
        return block[["id"]].assign(leaf=block["node"], subroot=above["subroot"].iloc[0], proof_sha256=proofs,
                                    folded_root=folded)

    return run


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    """Nodes with their block, and whether it is the only one of its group (``n``: nodes of the group)."""
    return nodes.withColumn("block", F.floor(F.col("pos") / size)).withColumn("alone", F.col("n") <= size)


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``pos`` (from 0 in each group, by ``order``) and ``n``, the rows of the group.

    Rows are sorted by ranges of (group, order) and written in that order; rows that repeat are told apart by
    their number, so that they can be spread. The places before a partition are a running sum over counts per
    (group, partition), one row per partition that a group is in.
    """
    by = [F.asc_nulls_first(c) for c in ("grp", "has_grp", *order, "row")]
    placed = keep(rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*by)
                  .sortWithinPartitions(*by).drop("row").withColumn("place", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    whole = Window.partitionBy(*GROUP)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (placed.groupBy(*GROUP, "part").agg(F.count("*").alias("held"), F.min("place").alias("first"))
             .select(*GROUP, "part", "first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"),
                     F.sum("held").over(whole).alias("n")))
    return (placed.join(parts, [*GROUP, "part"])
            .withColumn("pos", F.col("before") + F.col("place") - F.col("first"))
            .drop("part", "place", "first", "before"))


def _climb(nodes: DataFrame, fan_out: int, rounds: int) -> tuple[list[DataFrame], DataFrame]:
    """(nodes of each round, one root per group): rounds of blocks until every group is one node."""
    size, below = fan_out ** rounds, []
    while True:
        below.append(nodes)
        longest = nodes.agg(F.max("n")).first()[0] or 0
        nodes = keep(_blocks(nodes, size).groupBy(*GROUP, "block").applyInPandas(_up(fan_out, rounds), NODE), "nodes")
        if longest <= size:
            return below, nodes


def _ways(below: list[DataFrame], paths: DataFrame, fan_out: int, rounds: int) -> DataFrame:
    """has_grp, grp, pos, path: ways above the nodes of the lowest of some rounds, from those above the roots."""
    for nodes in reversed(below):
        blocks = _blocks(nodes, fan_out ** rounds).groupBy(*GROUP, "block")
        above = paths.withColumnRenamed("pos", "block").groupBy(*GROUP, "block")
        paths = keep(blocks.cogroup(above).applyInPandas(
            _down(fan_out, rounds), "has_grp boolean, grp string, pos long, path string"), "ways")
    return paths


def manifest(leaves: DataFrame, id_col: str = "doc_id", fan_out: int = 2, most: int = 1024) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf.

    ``leaves``: id_col, grp (string or null), leaf and changed (hex digests; changed is null where nothing was
    tampered with). Leaves of a group ascend by id, nulls first and rows of one id by their digests; groups
    ascend by the bytes of their name, the null group first. Consecutive runs of ``fan_out`` nodes (the last
    may be shorter, even one node) become their digest until one remains. ``proof_sha256`` is the digest of all
    siblings on the way to the root, level by level, left to right (of nothing, for a lone leaf). A block holds
    at most ``most`` nodes. An empty table gives no rows.
    """
    rounds = max(1, int(math.log(most, fan_out) + 1e-9))
    kind = leaves.schema[id_col].dataType.simpleString()
    rows = keep(leaves.select(F.col("grp").isNotNull().alias("has_grp"), F.coalesce("grp", F.lit("")).alias("grp"),
                              F.col(id_col).alias("id"), F.col("leaf").alias("node"), "changed"), "digests")
    rows = keep(positions(rows, ["id", "node", "changed"]), "ordered")
    below, tops = _climb(rows.select(*NODE_COLUMNS), fan_out, rounds)
    # The tree over the groups: one group, whose leaves are the subroots by name with null first.
    named = tops.select(F.lit(True).alias("has_grp"), F.lit("").alias("grp"), F.col("has_grp").alias("own_has"),
                        F.col("grp").alias("own"), "node")
    groups = keep(positions(named, ["own_has", "own"]), "groups")
    over, top = _climb(groups.select(*NODE_COLUMNS), fan_out, rounds)
    ways = _ways(over, top.select(*GROUP, "pos", F.lit("").alias("path")), fan_out, rounds)
    tops = keep(groups.join(ways.select("pos", "path"), "pos").select(
        F.col("own_has").alias("has_grp"), F.col("own").alias("grp"), F.lit(0).cast("long").alias("pos"),
        "path", F.col("node").alias("subroot")), "tops")
    paths = _ways(below[1:], tops.select(*GROUP, "pos", "path"), fan_out, rounds)
    above = paths.withColumnRenamed("pos", "block").join(tops.select(*GROUP, "subroot"), GROUP)
    root = top.first()
    made = (_blocks(rows.withColumn("id", F.col("id").cast("string")), fan_out ** rounds)
            .groupBy(*GROUP, "block").cogroup(above.groupBy(*GROUP, "block"))
            .applyInPandas(_fold(fan_out, rounds), "id string, leaf string, subroot string, proof_sha256 string, "
                                                   "folded_root string"))
    return made.select(F.col("id").cast(kind).alias(id_col), "leaf", "subroot",
                       F.lit(root["node"] if root else None).cast("string").alias("root"), "proof_sha256",
                       "folded_root").withColumn("verified", F.col("folded_root") == F.col("root"))


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    changed = row_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    return manifest(docs.select("doc_id", F.col("lang").alias("grp"), row_digest([F.col(c) for c in FIELDS]).alias("leaf"),
                                F.when(tampered, changed).alias("changed")))


#: Recursive levels of both trees, the siblings of every row on every level, and the fold level by level.
SQL = """
WITH RECURSIVE bits AS (
  SELECT doc_id, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''),
    lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
fields AS (
  SELECT d.doc_id, d.lang, d.n_chars IS NOT NULL AND xor(b.crc, 4294967295) % 7 = 0 AS tampered, d.n_chars,
    coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z
  FROM documents d LEFT JOIN bits b ON d.doc_id = b.doc_id),
hashed AS (
  SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
    CASE WHEN tampered THEN sha256(a || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || z) END AS changed
  FROM fields),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
low AS (
  SELECT g, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT g, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2)
  FROM low WHERE n > 1 GROUP BY g, lvl, pos // 2),
subroots AS (SELECT g, h FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, g - 1 AS pos, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2)
  FROM high WHERE n > 1 GROUP BY lvl, pos // 2),
heights AS (SELECT g, max(lvl) AS top FROM low GROUP BY g),
way AS (
  SELECT l.g, l.pos AS leaf_pos, s.lvl, (l.pos >> s.lvl) & 1 AS side, s.h AS sibling
  FROM leaves l JOIN low s ON s.g = l.g AND s.n > 1 AND s.pos = xor(l.pos >> s.lvl, 1)
  UNION ALL
  SELECT l.g, l.pos, t.top + s.lvl, ((l.g - 1) >> s.lvl) & 1, s.h
  FROM leaves l JOIN heights t ON t.g = l.g JOIN high s ON s.n > 1 AND s.pos = xor((l.g - 1) >> s.lvl, 1)),
proofs AS (SELECT g, leaf_pos, string_agg(sibling, '' ORDER BY lvl) AS s FROM way GROUP BY g, leaf_pos),
steps AS (SELECT g, top + (SELECT max(lvl) FROM high) AS last FROM heights),
fold AS (
  SELECT l.g, l.pos, 0 AS lvl, coalesce(changed, leaf) AS h, last FROM leaves l JOIN steps USING (g)
  UNION ALL
  SELECT f.g, f.pos, f.lvl + 1,
    sha256(CASE w.side WHEN 1 THEN w.sibling || f.h WHEN 0 THEN f.h || w.sibling ELSE f.h END), f.last
  FROM fold f LEFT JOIN way w ON w.g = f.g AND w.leaf_pos = f.pos AND w.lvl = f.lvl WHERE f.lvl < f.last)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(p.s, '')) AS proof_sha256,
  f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN subroots s ON s.g = l.g JOIN high r ON r.n = 1
  LEFT JOIN proofs p ON p.g = l.g AND p.leaf_pos = l.pos
  JOIN fold f ON f.g = l.g AND f.pos = l.pos AND f.lvl = f.last
"""
