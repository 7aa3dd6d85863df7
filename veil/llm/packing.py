"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

Each input split packs its own documents in one pass. ``count[h]`` is the number of open windows that
hold h tokens; a document of s tokens goes to the level h (0: a new window) for which moving one window
from h to h + s makes the sum of ``count ** 2`` smallest. Documents longer than a window first fill
whole windows. At the end of the split its open windows, few by design of the rule, are laid end to end
and cut at the window size; the last stretch is cut into powers of two, which need no padding.
Nothing is shuffled, and a lost task repeats its split with the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from veil.llm.store import table
from veil.llm.vocab import encoding

#: Text of the vocabulary's one special token and its id: matched in texts, and put after each document.
END_TEXT, END_ID = "<|endoftext|>", 50256
SCHEMA = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


class Levels:
    """Open windows by fill level; a window is the list of its pieces."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(size)]

    def place(self, piece, length: int) -> list | None:
        """Put a piece shorter than a window into the best level; the window if that fills it."""
        levels = np.arange(self.size - length + 1)
        gain = 2 * self.count[levels + length] + 1
        gain[-1] = 0  # a full window is no longer a level
        lost = 2 * self.count[levels] - 1
        lost[0] = 0
        cost = np.where((self.count[levels] > 0) | (levels == 0), gain - lost, np.iinfo(np.int64).max)
        level = self.size - length - int(cost[::-1].argmin())  # of equal levels the fullest
        if level:
            self.count[level] -= 1
            window = self.open[level].pop()
        else:
            window = []
        window.append(piece)
        if level + length == self.size:
            return window
        self.count[level + length] += 1
        self.open[level + length].append(window)
        return None

    def rest(self) -> list:
        """Pieces of the windows that are still open, fullest window first."""
        return [p for level in reversed(self.open) for window in level for p in window]


def powers(n: int) -> Iterator[int]:
    """n as falling powers of two."""
    while n:
        yield (top := 1 << (n.bit_length() - 1))
        n -= top


def pack(sizes: Iterator[tuple[object, int]], size: int) -> Iterator[list[tuple[object, int, int]]]:
    """Windows of (document, start, length) for a stream of (document, tokens)."""
    levels = Levels(size)
    for doc, n in sizes:
        whole = n - n % size
        for start in range(0, whole, size):
            yield [(doc, start, size)]
        if n > whole and (full := levels.place((doc, whole, n - whole), n - whole)):
            yield full
    rest = levels.rest()
    left = sum(p[2] for p in rest)
    cuts = [size] * (left // size) + list(powers(left % size))
    window, at = [], 0
    for doc, start, n in rest:
        while n:
            take = min(n, cuts[at] - sum(p[2] for p in window))
            window.append((doc, start, take))
            start, n = start + take, n - take
            if sum(p[2] for p in window) == cuts[at]:
                yield window
                window, at = [], at + 1


def packer(ranks_path: str, pattern: str, size: int, id_type: pa.DataType, batch: int = 20000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern, ((END_TEXT, END_ID),))
        # A document carries its id and, per window-sized stretch it may be cut to, only its ids.
        docs = ((key, enc.encode_to_numpy(text or "", allowed_special="all"))
                for b in batches for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                                      strict=True))
        sized = ((((key, np.append(ids, np.uint32(0)).astype("<u4"))), len(ids) + 1) for key, ids in docs)
        number = TaskContext.get().partitionId() << 40
        out: list[list] = [[] for _ in range(7)]

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(out[0], id_type), *(pa.array(c, pa.int64()) for c in out[1:])],
                names=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            for c in out:
                c.clear()
            return made

        for window in pack(sized, size):
            offset = 0
            for (key, ids), start, n in window:
                for column, value in zip(out, (key, start, n, zlib.crc32(ids[start:start + n].tobytes()),
                                               len(ids), number, offset), strict=True):
                    column.append(value)
                offset += n
            number += 1
            if len(out[0]) >= batch:
                yield flush()
        if out[0]:
            yield flush()

    return run


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                   text_col: str = "text", size: int = 1024) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then id 0, so a null or empty text is one token. The ids are those
    of the byte-level BPE with its special token matched in texts. Every id lies in one piece; pieces
    of a sequence are gapless from offset 0; a sequence is full, or its length is a power of two.
    Repeated rows and null ids are packed like any other row; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    out = docs.select(id_col, text_col).mapInArrow(
        packer(ranks_path, pattern, size, to_arrow_type(kind)),
        f"doc {kind.simpleString()}, {SCHEMA}")
    return out.withColumnRenamed("doc", id_col)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
