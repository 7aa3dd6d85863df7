"""Sum-of-squares packing against brute force: every id once, the placement rule, few sequences."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tests.llm.test_llm import RANKS, corpus, frame
from veil.llm.gap_packing import Gaps, by_fit, by_squares, pack_into_gaps


def ids_of(texts):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [e.ids + [2] for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, docs, size):
    """All pieces tile their documents, hold their ids, and lie gapless in sequences of at most ``size``."""
    want = []
    for (key, text), ids in zip(docs, ids_of([t for _, t in docs]), strict=True):
        start, piece = 0, 0
        for end in range(len(ids) % size or size, len(ids) + 1, size):
            crc = zlib.crc32(np.array(ids[start:end], dtype="<u4").tobytes())
            want.append((key, piece, start, end - start, crc, len(ids)))
            start, piece = end, piece + 1
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


@pytest.mark.parametrize("size, task", [(16, 50), (64, 7), (1024, 1 << 15)])
def test_pieces_and_sequences(spark, size, task):
    docs = corpus() + [(400, "a <|endoftext|> b  c \U0001f600ﬁ"), (401, "word " * 3000), (402, "a" * 1023)]
    out = pack_into_gaps(frame(spark, docs), RANKS, P.PATTERN, size=size, task_pieces=task).collect()
    n = check(out, docs, size)
    total = sum(r["length"] for r in out)
    assert n >= -(-total // size)
    if task > 1000:
        assert n <= -(-total // size) + 3


def test_rule_is_the_least_sum_of_squares():
    rnd, size = random.Random(1), 20
    for _ in range(30):
        gaps = Gaps(size)
        for i in range(60):
            n = rnd.randint(1, size - 1)
            best = None
            for gap in range(n, size + 1):
                if gap < size and not gaps.count[gap]:
                    continue
                after = gaps.count[:size].copy()
                after[0] = 0
                if gap < size:
                    after[gap] -= 1
                if gap > n:
                    after[gap - n] += 1
                cost = int((after ** 2).sum())
                if best is None or cost < best[0]:
                    best = (cost, gap)
            gap = gaps.least_squares(n)
            assert gap == best[1]
            gaps.place(i, n, gap)


def test_loose_pieces_take_the_smallest_gap():
    lengths = [9, 7, 5, 5, 3, 2, 1]
    bins, left = by_fit(lengths, 10)
    assert not left and sorted(i for b in bins for i in b) == list(range(7))
    assert sorted(sorted(lengths[i] for i in b) for b in bins) == [[1, 9], [2], [3, 7], [5, 5]]
    full, open_ = by_squares([5, 5, 4], 10)
    assert full == [[0, 1]] and open_ == [[2]]


def test_few_sequences_at_scale():
    rng = np.random.default_rng(3)
    lengths = sorted(rng.integers(1, 1024, 20000).tolist(), reverse=True)
    full, open_ = by_squares(lengths, 1024)
    loose = sorted((lengths[i] for b in open_ for i in b), reverse=True)
    n = len(full) + len(by_fit(loose, 1024)[0])
    assert n <= 1.01 * sum(lengths) / 1024


def test_empty_table(spark):
    assert pack_into_gaps(frame(spark, corpus()).limit(0), RANKS, P.PATTERN).collect() == []
