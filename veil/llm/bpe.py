"""Byte-level BPE encoding and decoding by a tree reduction over a monoid.

The elements are token lists; joining two of them gives the encoding of their joined bytes. A stretch
of bytes is halved until it is short, the halves are encoded, and neighbours are joined on the way up:
a window of tokens around the seam is decoded, encoded again, and doubled until both of its outer
borders are *stable*. A border between tokens s and t is stable when s + t, encoded on its own, gives
[s, t] again; a sequence of known tokens in which every adjacent pair is stable is the one the merge
rule produces, so tokens outside the window can no longer change. Decoding joins bytes up the same tree.
A text is the tree over its pattern matches, whose seams never merge; long matches (base64, repeated
letters) are the ones for which the windows matter. Halves are cut at multiples of the leaf, so that the runs of
one or of two letters, whose tokens are as long as powers of two, meet at stable borders at once; where a
window grows long after all, the merge rule works through a heap.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from veil.llm.store import table
from veil.llm.vocab import ranks


class Monoid:
    """Token lists under joining, for one rank file."""

    def __init__(self, rank: dict[bytes, int], leaf: int = 128, window: int = 4):
        self.rank, self.leaf, self.window = rank, leaf, window
        self.bytes = [b""] * (max(rank.values()) + 1)
        for token, i in rank.items():
            self.bytes[i] = token
        self.stable = functools.lru_cache(maxsize=1 << 16)(self._stable)

    def merge(self, data: bytes) -> list[int]:
        """The merge rule itself: join the leftmost pair of lowest rank until none is left."""
        if (whole := self.rank.get(data)) is not None:
            return [whole]
        if len(data) > 2 * self.leaf:
            return self._merge_long(data)
        parts = [data[i:i + 1] for i in range(len(data))]
        get, none = self.rank.get, len(self.bytes)
        pair = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pair and (low := min(pair)) < none:
            i = pair.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.rank[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same through a heap of (rank, place of the left part) and a linked list of parts."""
        n, get = len(data), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # parts by their first byte
        wanted: dict[int, int] = {}  # rank of the pair that begins at a part
        heap = []

        def offer(i: int) -> None:
            if i < 0:
                return
            if (j := after[i]) < n and (r := get(data[i:after[j]])) is not None:
                wanted[i] = r
                heapq.heappush(heap, (r, i))
            else:
                wanted.pop(i, None)

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i = heapq.heappop(heap)
            if wanted.get(i) != r:
                continue
            j = after[i]
            wanted.pop(j, None)
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.rank[data[i:after[i]]])
            i = after[i]
        return out

    def _stable(self, s: int, t: int) -> bool:
        return self.merge(self.bytes[s] + self.bytes[t]) == [s, t]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        k = self.window
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            middle = self.merge(self.decode(left[a:] + right[:b]))
            if ((a == 0 or self.stable(left[a - 1], middle[0]))
                    and (b == len(right) or self.stable(middle[-1], right[b]))):
                return left[:a] + middle + right[b:]
            k *= 2

    def encode(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.merge(data) if data else []
        half = max(1, len(data) // (2 * self.leaf)) * self.leaf
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def decode(self, ids: Sequence[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class Encoder:
    """Texts to ids: pattern matches, each through the tree; those of at most ``short`` letters are remembered."""

    def __init__(self, rank: dict[bytes, int], pattern: str, most: int = 1 << 18, short: int = 48):
        self.tree, self.most, self.short = Monoid(rank), most, short
        self.find = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        matches, known = self.find(text), self.known
        if len(known) > self.most:  # a bound on memory; what is dropped is encoded again
            known.clear()
        long: dict[str, list[int]] = {}
        for m in set(matches).difference(known):
            (known if len(m) <= self.short else long)[m] = self.tree.encode(m.encode())
        get = (lambda m: long.get(m) or known[m]) if long else known.__getitem__
        return list(chain.from_iterable(map(get, matches)))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(ranks(path), pattern)


def _round_trip(path: str, pattern: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        name = [str(i) for i in range(len(enc.tree.bytes))].__getitem__
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                counts, hashes, back = [], [], []
                for text in b.column(1).to_pylist():
                    ids = enc.encode(text or "")
                    counts.append(len(ids))
                    hashes.append(hashlib.sha256(" ".join(map(name, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(enc.tree.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).cast(id_type), pa.array(counts, pa.int64()),
                     pa.array(hashes, pa.string()), pa.array(back, pa.string())],
                    names=["doc", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str, pattern: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids = [enc.encode(t or "") for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).cast(id_type), pa.array(ids, pa.list_(pa.int32()))], names=["doc", "ids"])

    return run


def _decoded(path: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Monoid(ranks(path))
        for b in batches:
            data = [tree.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), pa.array(data, pa.binary())],
                                             names=["doc", "data"])

    return run


def _over(docs: DataFrame, id_col: str, col: str, fn, fields: str) -> DataFrame:
    kind = docs.schema[id_col].dataType
    return (docs.select(id_col, col)
            .mapInArrow(fn(to_arrow_type(kind)), f"doc {kind.simpleString()}, {fields}")
            .withColumnRenamed("doc", id_col))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """id, ids array<int>. Null texts are empty and give an empty list; rows are kept one to one."""
    return _over(docs, id_col, text_col, lambda t: _encoded(path, pattern, t), "ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id",
                     ids_col: str = "ids") -> DataFrame:
    """id, data binary: the bytes of the ids. Null lists give empty data."""
    return _over(encoded, id_col, ids_col, lambda t: _decoded(path, t), "data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every text; null texts count as empty."""
    return _over(docs, id_col, text_col, lambda t: _round_trip(path, pattern, t),
                 "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                      public_tokenizers.PATTERN)
