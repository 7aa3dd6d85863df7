"""Packing of documents into few sequences by sums of squares over residual gaps.

A document is its token ids and one end id; only longer ones are cut, into pieces of a whole sequence with the
shorter one first. A whole piece is a sequence. The others are dealt by row number to tasks of about
``task_pieces``; a task holds ``count[g]``, the open bins with g free tokens, and puts each piece, largest first,
where the sum of ``count ** 2`` becomes smallest (of equal ones, in the smaller gap), so that no gap is left
by many bins. A bin without a gap is done. The pieces of the bins that a task leaves open are dealt once more, over all
tasks, and placed largest first into the smallest gap that takes them; with few pieces of each size left the
sum of squares no longer tells gaps apart.

Texts are read once and never shuffled: what moves is one small row per piece. A task's rows are sorted by length
and row number and the tables between the rounds are written, so a repeated task gives the same sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veil.llm.packing import END_ID, END_TEXT
from veil.llm.store import keep, table
from veil.llm.vocab import encoding

PIECE = "piece int, start long, length long, ids_crc32 long, doc_tokens long"
OUT = ["piece", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Gaps:
    """Open bins by their free tokens; a bin is the list of its pieces."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list[int]]] = [[] for _ in range(size + 1)]

    def least_squares(self, length: int) -> int:
        """Gap of the bin to use (``size``: a new one) so that the sum of squared counts is smallest."""
        count, size = self.count, self.size
        more = 2 * count[:size - length + 1] + 1  # one more bin with this gap afterwards
        more[0] = 0
        fewer = 2 * count[length:] - 1
        cost = np.where(count[length:] > 0, more - fewer, np.iinfo(np.int64).max)
        cost[-1] = more[-1]
        return length + int(cost.argmin())

    def tightest(self, length: int) -> int:
        """The smallest gap that takes the piece, else a new bin."""
        fits = self.count[length:self.size] > 0
        at = int(fits.argmax()) if len(fits) else 0
        return length + at if len(fits) and fits[at] else self.size

    def place(self, piece: int, length: int, gap: int) -> list[int] | None:
        """Put the piece into a bin of that gap; the bin if this fills it."""
        if gap < self.size:
            self.count[gap] -= 1
            bin_ = self.open[gap].pop()
        else:
            bin_ = []
        bin_.append(piece)
        if gap == length:
            return bin_
        self.count[gap - length] += 1
        self.open[gap - length].append(bin_)
        return None

    def rest(self) -> Iterator[list[int]]:
        return (bin_ for bins in self.open for bin_ in bins)


def by_squares(lengths: Iterable[int], size: int) -> tuple[list[list[int]], list[list[int]]]:
    """(filled bins, open bins) of positions, placed in the given order."""
    gaps, done = Gaps(size), []
    for i, n in enumerate(lengths):
        if full := gaps.place(i, n, gaps.least_squares(n)):
            done.append(full)
    return done, list(gaps.rest())


def by_fit(lengths: Iterable[int], size: int) -> tuple[list[list[int]], list[list[int]]]:
    """All bins of positions, in the given order into the smallest gap; none stays open."""
    gaps, done = Gaps(size), []
    for i, n in enumerate(lengths):
        if full := gaps.place(i, n, gaps.tightest(n)):
            done.append(full)
    return done + list(gaps.rest()), []


def cut_texts(ranks_path: str, pattern: str, size: int, end_id: int, id_type: pa.DataType, batch: int = 16384):
    """(id, text) batches to one row per piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern, ((END_TEXT, END_ID),))
        out: list[list] = [[] for _ in range(6)]

        def flush() -> pa.RecordBatch:
            types = [id_type, pa.int32(), *[pa.int64()] * 4]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)],
                                              names=["doc", "piece", *OUT[1:5]])
            for c in out:
                c.clear()
            return made

        for b in batches:
            for at in range(b.num_rows):
                text = b.column(1)[at].as_py() or ""
                ids = np.append(enc.encode_to_numpy(text, allowed_special="all"), np.uint32(end_id)).astype("<u4")
                ends = range(len(ids) % size or size, len(ids) + 1, size)
                start = 0
                for piece, end in enumerate(ends):
                    row = (b.column(0)[at].as_py(), piece, start, end - start,
                           zlib.crc32(ids[start:end].tobytes()), len(ids))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start = end
                if len(out[0]) >= batch:
                    yield flush()
        if out[0]:
            yield flush()

    return run


def _packed(rule: Callable, size: int):
    """A task's rows (all its batches) with sequence_id, the row number of a bin's first piece, and offset;
    both are null for pieces of bins that the rule leaves open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        lengths, number = rows["length"].to_pylist(), rows["row"].to_numpy()
        sequence, offset = np.full(len(lengths), -1), np.zeros(len(lengths), dtype=np.int64)
        for bin_ in rule(lengths, size)[0]:
            at = 0
            for i in bin_:
                sequence[i], offset[i] = number[bin_[0]], at
                at += lengths[i]
        for name, values in (("sequence_id", sequence), ("offset", offset)):
            at = rows.schema.get_field_index(name)
            rows = rows.set_column(at, name, pa.array(values, pa.int64(), mask=sequence < 0))
        yield from rows.to_batches()

    return run


def _deal(pieces: DataFrame, rows: int, task_pieces: int) -> DataFrame:
    """Pieces by row number over tasks of about ``task_pieces``, largest first and then by number."""
    return pieces.repartition(max(1, -(-rows // task_pieces)), "row").sortWithinPartitions(F.desc("length"), "row")


def pack_into_gaps(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   size: int = 1024, end_id: int = 2, task_pieces: int = 1 << 15) -> DataFrame:
    """One row per piece: id, piece (from 0), start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids (the vocabulary's special token is matched in texts) and ``end_id``, so a null
    or empty text is one token. One of at most ``size`` tokens is one piece; of a longer one the first piece
    holds what is left over by whole sequences. Pieces of a sequence are gapless from offset 0. Repeated rows
    and null ids are packed like any other row; other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    pieces = (docs.select(F.col(id_col).alias("doc"), text_col)
              .mapInArrow(cut_texts(ranks_path, pattern, size, end_id, to_arrow_type(kind)),
                          f"doc {kind.simpleString()}, {PIECE}")
              .withColumn("row", F.monotonically_increasing_id())
              .withColumn("sequence_id", F.when(F.col("length") == size, F.col("row")))
              .withColumn("offset", F.when(F.col("length") == size, F.lit(0).cast("long"))))
    pieces = keep(pieces, "pieces")
    short, whole = pieces.where(F.col("length") < size), pieces.where(F.col("length") == size)
    first = keep(_deal(short, short.count(), task_pieces)
                 .mapInArrow(_packed(by_squares, size), pieces.schema), "bins")
    loose = first.where("sequence_id IS NULL")
    second = _deal(loose, loose.count(), task_pieces).mapInArrow(_packed(by_fit, size), pieces.schema)
    packed = whole.unionByName(first.where("sequence_id IS NOT NULL")).unionByName(second)
    return packed.select(F.col("doc").alias(id_col), *OUT)


def op11_gap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_into_gaps(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
