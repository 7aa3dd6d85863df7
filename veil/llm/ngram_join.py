"""N-gram Jaccard self-join with rare-first prefixes, and the components of its links.

1. A pass over the texts counts every shingle in a table of fixed size (2**sketch_bits counters by hash;
   all documents, no cap). It only sets the order of shingles, rarest first with the hash as tie-break;
   any order gives the same links, a good one keeps common shingles out of the prefixes.
2. A second pass gives each document its set's size, digest and prefix: its first n - ceil(t n) + 1
   shingles in that order. Two sets with Jaccard >= t share a shingle of their prefixes. Equal sets are one
   node from here on.
3. Prefixes are counted per shingle (with partial sums, so a hot one sends a row per task) and only
   shingles of two or more nodes are kept.
4. Nodes that share a shingle are candidates if they pass the length filter, the positional filter (what
   is left after the shared shingle's positions) and the suffix filter: both sets are cut into 512 hash
   ranges, and each range in which one holds an odd and the other an even number of shingles proves a
   shingle that only one of them has. Candidates are verified once per pair, also over the two rounds
   below.

Within a group of near copies all pairs would be candidates. Links matter only for reachability, so a
first round verifies each node against one hub per shingle (the one that holds it earliest in its prefix:
the least edited copy). Nodes linked to the same hub need no further pair among them; the second round
joins only nodes that are not yet known to be connected, and is exhaustive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.graph import components
from veil.llm.store import drop, save, table
from veil.llm.words import shingle_sets

#: Hash ranges of the suffix filter (2**RANGE_BITS).
RANGE_BITS, SEGMENTS = 9, 256


def count_table(docs: DataFrame, text_col: str, k: int, bits: int) -> np.ndarray:
    """Shingle occurrences over all documents in 2**bits counters by hash; a task sends its own table."""
    size = 1 << bits
    step = max(1, size // SEGMENTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.uint32)
        for b in batches:
            held, n = [], 0
            for _, s in shingle_sets(b.column(0), k):
                held.append(s)
                n += len(s)
                if n >= 1 << 20:
                    np.add(total, np.bincount(_slot(np.concatenate(held), bits), minlength=size), out=total,
                           casting="unsafe")
                    held, n = [], 0
            if held:
                np.add(total, np.bincount(_slot(np.concatenate(held), bits), minlength=size), out=total,
                       casting="unsafe")
        yield _segments(total, step)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for seg, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(data.as_py(), dtype=np.uint32).astype(np.uint64)
                sums[seg] = sums[seg] + part if seg in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()),
             pa.array([np.minimum(s, (1 << 32) - 1).astype(np.uint32).tobytes() for s in sums.values()],
                      pa.binary())], names=["seg", "counts"])

    kind = "seg int, counts binary"
    rows = (docs.select(text_col).mapInArrow(count, kind).repartition(F.col("seg"))
            .mapInArrow(add, kind).collect())
    out = np.zeros(size, dtype=np.uint32)
    for r in rows:
        out[r["seg"] * step:(r["seg"] + 1) * step] = np.frombuffer(r["counts"], dtype=np.uint32)
    return out


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _segments(total: np.ndarray, step: int) -> pa.RecordBatch:
    n = len(total) // step
    return pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int32()),
         pa.array([total[i * step:(i + 1) * step].tobytes() for i in range(n)], pa.binary())],
        names=["seg", "counts"])


def signatures(docs: DataFrame, counts: np.ndarray, bits: int, k: int, num: int, den: int,
               id_col: str, text_col: str) -> DataFrame:
    """uid, doc, n, sid (digest of the set; null if empty), prefix (rarest first), parts (64 hash
    ranges a number: the bit is set where the range holds an odd number of shingles) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, uid = shared.value, TaskContext.get().partitionId() << 36
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                n, sid, prefix, parts = [], [], [], []
                for _, s in shingle_sets(b.column(1), k):
                    n.append(len(s))
                    sid.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    order = np.argsort(often[_slot(s, bits)], kind="stable")
                    most = len(s) - -(-num * len(s) // den) + 1
                    prefix.append(s[order[:most]].view(np.int64))
                    odd = np.bincount(_slot(s, RANGE_BITS), minlength=1 << RANGE_BITS) & 1
                    parts.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(uid, uid + len(n)), pa.int64()), b.column(0), pa.array(n, pa.int64()),
                     pa.array(sid, pa.binary()), pa.array(prefix, pa.list_(pa.int64())),
                     pa.array(parts, pa.list_(pa.int64()))],
                    names=["uid", "doc", "n", "sid", "prefix", "parts"])
                uid += len(n)

    return docs.select(F.col(id_col).cast("long").alias("doc"), text_col).mapInArrow(
        run, "uid long, doc long, n long, sid binary, prefix array<long>, parts array<long>")


def whole_sets(docs: DataFrame, nodes: DataFrame, rows: DataFrame, k: int, id_col: str, text_col: str,
               bits: int = 24) -> str:
    """Path of a table (node, grams) of the sets of ``nodes``, read from the texts again.

    Texts are not shuffled for that. The wanted ids mark a bit map of fixed size (2**bits bits), which
    the tasks that read the texts hold; sets of unmarked rows are not sent. What is sent meets its node
    by the set's digest, so a bit shared by two ids costs a row, not a wrong result.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    wanted = rows.join(nodes, F.col("uid") == F.col("node")).select("node", "doc", "sid")
    # The bitmap functions count from 1: number b + 1 is bit b mod 32768 of bucket b div 32768 + 1.
    maps = wanted.select((bit(F.col("doc")) + 1).alias("bit")).select(
        F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("at")).groupBy(
        "bucket").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    marked = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in maps:
        marked[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(shared.value, bitorder="little")
        for whole in batches:
            at = held[whole.column(0).to_numpy(zero_copy_only=False)].astype(bool)
            whole = whole.filter(pa.array(at))
            for i in range(0, whole.num_rows, 512):
                sets = [s for _, s in shingle_sets(whole.slice(i, 512).column(1), k) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["sid", "grams"])

    sent = docs.select(bit(F.col(id_col).cast("long")).alias("bit"), text_col).mapInArrow(
        run, "sid binary, grams array<long>")
    return save(sent.join(wanted.select("sid", "node"), "sid").select("node", "grams"), "sets")


def need(na: Column, nb: Column, num: int, den: int) -> Column:
    """Smallest overlap of two sets of these sizes with Jaccard >= num / den."""
    return F.ceil((na + nb) * F.lit(num) / F.lit(num + den) - F.lit(1e-9))


def may_link(num: int, den: int) -> Column:
    """Length, positional and suffix filter over the columns of two members a_ and b_."""
    na, nb = F.col("na"), F.col("nb")
    left = F.least(na - F.col("pa"), nb - F.col("pb"))
    apart = F.aggregate(F.zip_with("ga", "gb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
                        lambda s, x: s + x)
    least = need(na, nb, num, den)
    return ((F.least(na, nb) * den >= F.greatest(na, nb) * num) & (left >= least)
            & (apart <= na + nb - 2 * least))


def verify(candidates: DataFrame, docs: DataFrame, rows: DataFrame, k: int, num: int, den: int,
           id_col: str, text_col: str, known: str | None = None) -> tuple[str, str]:
    """Paths of two tables: the candidate pairs (a, b, na, nb; either order), and those (a, b) that link.

    Pairs of the table at ``known``, verified before, are left out.
    """
    spark = candidates.sparkSession
    swap = F.col("a") > F.col("b")
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    candidates = candidates.select(pick("a", "b", "a"), pick("b", "a", "b"), pick("na", "nb", "na"),
                                   pick("nb", "na", "nb")).distinct()
    if known:
        candidates = candidates.join(spark.read.parquet(known).select("a", "b"), ["a", "b"], "left_anti")
    pair_at = save(candidates, "pairs")
    pairs = spark.read.parquet(pair_at)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    set_at = whole_sets(docs, nodes, rows, k, id_col, text_col)
    sets = spark.read.parquet(set_at)
    a = sets.select(F.col("node").alias("a"), F.col("grams").alias("xa"))
    b = sets.select(F.col("node").alias("b"), F.col("grams").alias("xb"))
    links = (pairs.join(a, "a").join(b, "b")
             .withColumn("both", F.size(F.array_intersect("xa", "xb")).cast("long"))
             .where(F.col("both") * den >= (F.col("na") + F.col("nb") - F.col("both")) * num)
             .select("a", "b").distinct())
    link_at = save(links, "links")
    drop(spark, set_at)
    return pair_at, link_at


def _side(members: DataFrame, s: str, *more: str) -> DataFrame:
    return members.select("token", F.col("node").alias(s), F.col("n").alias(f"n{s}"),
                          F.col("pos").alias(f"p{s}"), F.col("parts").alias(f"g{s}"),
                          *(F.col(c).alias(f"{c}_{s}") for c in more))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                      num: int = 85, den: int = 100, sketch_bits: int = 20) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links).

    A document's set: its distinct k-word shingles, or its whole word sequence if shorter. Sets with
    Jaccard >= num / den link. A text without words (or null) has 0 shingles and its own id. Rows that
    share an id are separate texts with that id; a row with a null id can connect others, but never
    names a component unless all its ids are null. Other columns are not read. Sets are compared by
    64-bit shingle hashes and 128-bit set digests.
    """
    spark = docs.sparkSession
    often = count_table(docs, text_col, k, sketch_bits)
    sig_at = save(signatures(docs, often, sketch_bits, k, num, den, id_col, text_col), "signatures")
    sigs = spark.read.parquet(sig_at)

    nodes = (sigs.where(F.col("sid").isNotNull()).groupBy("sid")
             .agg(F.min("uid").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix")))
    posts = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token")).select(
        "token", "node", (F.col("n") * F.lit(1 << 31) + F.col("pos")).alias("at"))
    often_met = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    post_at = save(posts.join(often_met, "token").select(
        "token", "node", F.shiftright("at", 31).alias("n"), (F.col("at") % F.lit(1 << 31)).alias("pos")),
        "postings")
    posts = spark.read.parquet(post_at)
    rows_at = save(sigs.drop("prefix", "parts"), "rows")
    rows = spark.read.parquet(rows_at)
    members_at = save(posts.join(sigs.select(F.col("uid").alias("node"), "parts"), "node"), "members")
    members = spark.read.parquet(members_at)
    drop(spark, sig_at, post_at)

    hubs = members.groupBy("token").agg(F.min(F.struct("pos", "node", "n", "parts")).alias("h"))
    hub_side = hubs.select("token", F.col("h.node").alias("a"), F.col("h.n").alias("na"),
                           F.col("h.pos").alias("pa"), F.col("h.parts").alias("ga"))
    first = (_side(members, "b").join(hub_side, "token").where((F.col("a") != F.col("b")) & may_link(num, den))
             .select("a", "b", "na", "nb"))
    whole = (docs, rows, k, num, den, id_col, text_col)
    tried, linked = verify(first, *whole)
    first_links = spark.read.parquet(linked)
    near = components(first_links)

    grouped = members.join(near, "node", "left").withColumn("known", F.coalesce("root", "node"))
    rest = (_side(grouped, "a", "known").join(_side(grouped, "b", "known"), "token")
            .where((F.col("a") < F.col("b")) & (F.col("known_a") != F.col("known_b")) & may_link(num, den))
            .select("a", "b", "na", "nb"))
    tried_next, linked_next = verify(rest, *whole, known=tried)
    roots = components(first_links.union(spark.read.parquet(linked_next)))
    drop(spark, members_at, tried, tried_next)

    named = (rows.where(F.col("sid").isNotNull()).groupBy("sid").agg(
        F.min("uid").alias("node"), F.min("doc").alias("least")).join(roots, "node", "left")
        .select("sid", F.coalesce("root", "node").alias("root"), "least"))
    tops = named.groupBy("root").agg(F.min("least").alias("top"))
    classes = named.join(tops, "root").select("sid", "top")
    return rows.select("doc", "n", "sid").join(classes, "sid", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("doc")).otherwise(F.col("top")).alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
