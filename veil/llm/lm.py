"""Language-model scores by prediction with partial matching over a byte-context trie.

A text is its words, lower-cased, each closed by a space, and then one end symbol. Every byte is coded in
the context of the ``order`` bytes before it (a space stands before the first word). A context predicts a
byte with (count - 1/2) / total or escapes with (distinct / 2) / total (escape method D) to the context
that is one byte shorter, where the bytes that the longer one could have predicted are excluded; below
order 0 the bytes that are left are equally likely. The trie is pretrained on all training documents.

Nothing of corpus size is held in one place. A task turns its texts into blocks: the block's distinct
words and (context, byte) pairs with their counts in its training documents, and each document as
positions in the word list. Counts are summed over blocks by key, and the trie is built and priced by joins
of its orders. Counts and prices go back to the blocks that asked for them (a hot word or context is asked
for once per block), where the documents are put together again and summed. Words are keyed by 64-bit
hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.store import drop, save, table
from veil.llm.words import hash_words, split_words, text_chunks

#: The end symbol's key among words, and its byte in the trie (white space never occurs in a word).
END_KEY, END_BYTE = -1, 10
BLOCK = 1 << 24
SCHEMA = ("kind string, block long, key array<long>, trained array<long>, data binary, offsets array<int>, "
          "doc long, held boolean, places array<int>")


def held_out(doc) -> bool:
    """Whether a document is kept out of training: crc32 of its id as text, mod 7, is 2."""
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


def coded_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray,
                order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte, packed in one number, of every coded byte of some documents.

    The words of document i are data[starts[w]:starts[w] + lengths[w]] for w in first[i] to first[i + 1].
    Returns (keys, ends): those of document i are keys[ends[i]:ends[i + 1]]. In a key the byte is lowest,
    above it the context with its newest byte lowest; before the text's first space there are zeros.
    """
    n, words = len(first) - 1, len(starts)
    past = np.concatenate([[0], np.cumsum(lengths + 1)])
    place = past[:-1] + 2 * np.repeat(np.arange(n), np.diff(first)) + 1
    begin = past[first[:-1]] + 2 * np.arange(n)
    finish = past[first[1:]] + 2 * np.arange(n) + 1
    stream = np.full(int(past[-1]) + 2 * n, 32, dtype=np.uint64)
    if words:
        inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        stream[inner + np.repeat(place, lengths)] = data[inner + np.repeat(starts, lengths)]
    stream[finish] = END_BYTE
    keys = stream.copy()
    for back in range(1, order + 1):
        keys[back:] |= stream[:-back] << np.uint64(8 * back)
    for depth in range(1, order + 1):  # near the beginning of a document the context is shorter
        at = begin + depth
        at = at[at <= finish]
        keys[at] &= np.uint64((1 << 8 * (depth + 1)) - 1)
    coded = np.ones(len(stream), dtype=bool)
    coded[begin] = False
    return keys[coded].astype(np.int64), np.concatenate([begin, [len(stream)]]) - np.arange(n + 1)


def tally(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of several (keys, counts) into one with distinct keys."""
    keys, at = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
    total = np.zeros(len(keys), dtype=np.int64)
    np.add.at(total, at, np.concatenate([c for _, c in pairs]))
    return keys, total


def _blocks(order: int):
    def block_rows(block: int, docs: list, words: list, tries: list) -> Iterator[dict]:
        """docs: (id, held, words); words: (hashes, starts, ends, bytes) and tries: (keys, counts) of
        consecutive chunks."""
        h = np.concatenate([w[0] for w in words])
        uniq, at, place = np.unique(h, return_index=True, return_inverse=True)
        held = np.array([d[1] for d in docs], dtype=bool)
        sizes = np.array([d[2] for d in docs])
        weight = np.repeat(~held, sizes).astype(np.int64)
        trained = np.bincount(place, weights=weight, minlength=len(uniq)).astype(np.int64)
        shift = np.cumsum([0, *(len(w[3]) for w in words)])
        starts = np.concatenate([w[1] + s for w, s in zip(words, shift, strict=False)])[at]
        lengths = np.concatenate([w[2] - w[1] for w in words])[at]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        low = np.concatenate([w[3] for w in words])
        take = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, lengths)
        data = low[take] if len(take) else low[:0]
        base = dict.fromkeys(("key", "trained", "data", "offsets", "doc", "held", "places"))
        # The end symbol is one more word.
        yield base | {"kind": "words", "block": block, "key": np.append(uniq.view(np.int64), END_KEY),
                      "trained": np.append(trained, int((~held).sum()))}
        symbols, counts = tally(tries)
        yield base | {"kind": "trie", "block": block, "key": symbols, "trained": counts}
        yield base | {"kind": "bytes", "block": block, "data": data.tobytes(),
                      "offsets": offsets.astype(np.int32)}
        where = 0
        for doc, is_held, n in docs:
            yield base | {"kind": "doc", "block": block, "doc": doc, "held": is_held,
                          "places": place[where:where + n].astype(np.int32)}
            where += n

    types = {"kind": pa.string(), "block": pa.int64(), "key": pa.list_(pa.int64()),
             "trained": pa.list_(pa.int64()), "data": pa.binary(), "offsets": pa.list_(pa.int32()),
             "doc": pa.int64(), "held": pa.bool_(), "places": pa.list_(pa.int32())}

    def as_batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()],
                                          names=list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        docs, words, tries = [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            rows = []
            for row in block_rows(block, docs, words, tries):
                rows.append(row)
                if row["kind"] != "doc" or len(rows) >= 500:
                    yield as_batch(rows)
                    rows = []
            if rows:
                yield as_batch(rows)

        for b in batches:
            ids = b.column(0).to_pylist()
            for row, offsets, data in text_chunks(b.column(1)):
                first, starts, ends, low = split_words(offsets, data)
                held = np.array([held_out(x) for x in ids[row:row + len(offsets) - 1]], dtype=bool)
                for i in range(len(held)):
                    docs.append((ids[row + i], bool(held[i]), int(first[i + 1] - first[i])))
                keys, at = coded_bytes(low, starts, ends - starts, first, order)
                out = np.repeat(held, np.diff(at))
                tries.append(np.unique(keys[~out], return_counts=True))
                asked = np.unique(keys[out])
                tries.append((asked, np.zeros(len(asked), dtype=np.int64)))
                words.append((hash_words(starts, ends, low), starts, ends, low))
                size += len(data)
                if size >= BLOCK:
                    yield from close()
                    block, size = block + 1, 0
                    docs, words, tries = [], [], []
        if docs:
            yield from close()

    return run


def _small(table: DataFrame, width: int) -> DataFrame:
    """A table of one row per key of ``width`` bytes: sent to all tasks where it has at most 65,536 rows."""
    return F.broadcast(table) if width <= 2 else table


def price_trie(counts: DataFrame, order: int) -> DataFrame:
    """key, cost: log10 of the probability of each (context, symbol) key of ``counts`` (key, n).

    ``n`` may be 0 (a key that only held-out documents have). ``key`` is as in :func:`coded_bytes`.

    Contexts of few bytes are few but stand in all keys, so a shuffle by them would end in few tasks. Tables
    keyed by at most two bytes (65,536 rows, about 2 MB) are sent to the keys. A shuffle is then by three
    bytes or more, which at most 256 ** (order - 2) of the distinct keys share (65,536 at order 4).
    """
    spark = counts.sparkSession
    paths = [save(counts.select("key", "n"), "keys")]
    counts = spark.read.parquet(paths[0])
    # Per order, the longest first: what was trained. Keys of the longest are those of ``counts``.
    levels: list[DataFrame] = [counts.where("n > 0")]
    for j in range(order - 1, -1, -1):
        mask = (1 << 8 * (j + 1)) - 1
        level = (levels[-1].groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key"))
                 .agg(F.sum("n").alias("n")))
        paths.append(save(level, "level"))
        levels.append(spark.read.parquet(paths[-1]))
    price, before = counts.select("key", F.lit(0.0).alias("cost"), F.lit(False).alias("found")), None
    for step, level in enumerate(levels):
        j = order - step
        ctx = F.shiftright("key", 8)
        totals = level.groupBy(ctx.alias("ctx")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        if step:
            # What the longer context has seen is excluded here: its count in this order, and its kinds.
            mask = (1 << 8 * (j + 1)) - 1
            longer = levels[step - 1].select(F.shiftright("key", 8).alias("longer"),
                                             F.col("key").bitwiseAND(F.lit(mask)).alias("key"))
            barred = longer.join(_small(level, j + 1), "key").groupBy("longer").agg(
                F.sum("n").alias("barred"), F.count("*").alias("barred_kinds"))
        keys = price.select("key", "cost", "found",
                            F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("short"),
                            F.shiftright(F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)), 8).alias("ctx"),
                            F.shiftright(F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 2)) - 1)), 8)
                            .alias("longer"))
        keys = (keys.join(_small(level.select(F.col("key").alias("short"), "n"), j + 1), "short", "left")
                .join(_small(totals, j), "ctx", "left"))
        if step:
            keys = keys.join(_small(barred, j + 1), "longer", "left")
        else:
            keys = keys.withColumn("barred", F.lit(0)).withColumn("barred_kinds", F.lit(0))
        total = F.coalesce("total", F.lit(0)) - F.coalesce("barred", F.lit(0))
        kinds = F.coalesce("kinds", F.lit(0)) - F.coalesce("barred_kinds", F.lit(0))
        hit = ~F.col("found") & F.col("n").isNotNull()
        gain = F.when(F.col("found") | (kinds == 0), F.lit(0.0)).when(
            hit, F.log10((F.col("n") - 0.5) / total)).otherwise(F.log10(0.5 * kinds / total))
        price = keys.select("key", (F.col("cost") + gain).alias("cost"), (F.col("found") | hit).alias("found"))
        now = save(price, "price")
        price = spark.read.parquet(now)
        # The next order reads the written prices alone, so those before them can go.
        drop(spark, *[before] if before else [])
        before = now
    known = levels[-1].agg(F.count("*")).first()[0]
    drop(spark, *paths)
    out = price.select("key", F.when(F.col("found"), F.col("cost")).otherwise(
        F.col("cost") - F.log10(F.lit(float(256 - known)))).alias("cost"))
    return out


def _score(order: int, total: int, kinds: int, group: int = 64):
    def run(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        docs = batch[batch["kind"] == "doc"]
        blob = batch[batch["kind"] == "bytes"].iloc[0]
        data, begin = np.frombuffer(blob["data"], dtype=np.uint8), np.asarray(blob["offsets"], dtype=np.int64)
        word = answers["word"].to_numpy(dtype=bool)
        key = answers["key"].to_numpy(dtype=np.int64)
        # The block's words were listed by their hash as an unsigned number; the end symbol is the largest.
        by = np.argsort(key[word].view(np.uint64), kind="stable")
        count = answers["n"].to_numpy(dtype=np.int64)[word][by]
        known, base = count > 0, np.log10((count + 1) / (total + kinds + 1))
        by = np.argsort(key[~word], kind="stable")
        trie, cost = key[~word][by], answers["cost"].to_numpy(dtype=np.float64)[~word][by]
        places = [np.asarray(p, dtype=np.int64) for p in docs["places"]]
        score = []
        for i in range(0, len(places), group):
            some = places[i:i + group]
            at = np.concatenate(some)
            first = np.cumsum([0, *map(len, some)])
            keys, ends = coded_bytes(data, begin[at], begin[at + 1] - begin[at], first, order)
            score.append(np.add.reduceat(cost[np.searchsorted(trie, keys)], ends[:-1]))
        return pd.DataFrame({
            "doc": docs["doc"].astype("Int64").to_numpy(), "held_out": docs["held"].to_numpy(dtype=bool),
            "n_tokens": [len(p) + 1 for p in places],
            "n_known": [int(known[p].sum()) + int(known[-1]) for p in places],
            "train_tokens": total, "base_score": [float(base[p].sum() + base[-1]) for p in places],
            "score": np.concatenate(score)})

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 4) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the add-one unigram score of the words and the end, ``score`` the log10 probability
    of the same tokens under the trie. A null or empty text is one end token. Rows that repeat an id
    are texts of their own; a null id counts as an empty id text (training). Other columns are not read.
    """
    spark = docs.sparkSession
    at = save(docs.select(F.col(id_col).cast("long").alias("doc"), text_col).mapInArrow(_blocks(order), SCHEMA),
              "blocks", by="kind", codec="zstd")
    blocks = spark.read.schema(SCHEMA).parquet(at)
    asked = blocks.where(F.col("kind").isin("words", "trie")).select(
        "kind", "block", F.explode(F.arrays_zip("key", "trained")).alias("x")).select(
        "kind", "block", "x.key", F.col("x.trained").alias("n"))
    listed = asked.where("kind = 'words'")
    # A hot word has a row in every block: one row per word and the blocks of 64 splits, so that no row and no
    # task holds all of them; the sums over these few rows are joined back by the word.
    runs = spark.read.parquet(save(listed.groupBy("key", F.shiftright("block", 38).alias("run")).agg(
        F.sum("n").alias("n"), F.collect_list("block").alias("blocks")), "runs"))
    counted = runs.groupBy("key").agg(F.sum("n").alias("n"))
    sums = counted.where("n > 0").agg(F.sum("n"), F.count("*")).first()
    words = runs.select("key", F.explode("blocks").alias("block")).join(counted, "key")
    total, kinds = int(sums[0] or 0), int(sums[1])
    tries = asked.where("kind = 'trie'")
    prices = price_trie(tries.groupBy("key").agg(F.sum("n").alias("n")), order)
    answers = words.select(F.col("block").alias("block"), F.lit(True).alias("word"), "key", "n", F.lit(0.0).alias("cost")).unionByName(
        tries.select("block", "key").join(prices, "key").select(
            "block", F.lit(False).alias("word"), "key", F.lit(0).cast("long").alias("n"), "cost"))
    texts = blocks.where(F.col("kind").isin("bytes", "doc")).select(
        "kind", "block", "data", "offsets", "doc", "held", "places")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _score(order, total, kinds),
        "doc long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double").withColumnRenamed("doc", id_col)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
