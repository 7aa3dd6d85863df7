"""Words and shingles of whole batches of texts as hash arrays (numpy, inside tasks).

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return, after lower-casing A-Z. Its hash mixes two polynomial hashes of its bytes with different bases
and byte tables. The arrays of one call cover at most ``CHUNK`` bytes of text (or one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21
U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_tables = np.random.default_rng(1).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0][0]) < n:
        n = max(n, CHUNK)
        _powers.clear()
        for base in BASES:
            both = []
            for x in (base, pow(base, -1, 1 << 64)):
                p = np.full(n, x, dtype=np.uint64)
                p[0] = 1
                both.append(np.cumprod(p))
            _powers.append(tuple(both))
    return _powers


def text_chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of stretches of rows; null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, offsets[row:end + 1] - offsets[row], data[offsets[row]:offsets[end]]
        row = end


def split_words(offsets: np.ndarray, data: np.ndarray):
    """(first, starts, ends, low): words by position in the lower-cased bytes; those of text i are
    first[i] to first[i + 1]."""
    low, n = LOWER[data], len(data)
    space = SPACE[data]
    after, before = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    after[1:] = space[:-1]
    before[:-1] = space[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    after[inner] = True
    before[inner - 1] = True
    starts, ends = np.flatnonzero(~space & after), np.flatnonzero(~space & before) + 1
    return np.searchsorted(starts, offsets), starts, ends, low


def hash_words(starts: np.ndarray, ends: np.ndarray, low: np.ndarray) -> np.ndarray:
    out = (ends - starts).astype(np.uint64)
    for (up, down), values in zip(powers(len(low) + 1), _tables, strict=True):
        total = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum(values[low] * up[:len(low)], out=total[1:])
        out = mix(out ^ ((total[ends] - total[starts]) * down[starts]))
    return out


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles); a shorter text is one shingle."""
    for row, offsets, data in text_chunks(texts):
        first, starts, ends, low = split_words(offsets, data)
        h = hash_words(starts, ends, low)
        if len(h) >= k:
            s = h[:len(h) - k + 1]
            for j in range(1, k):
                s = mix(s * U(3) + h[j:len(h) - k + 1 + j])
        for i in range(len(offsets) - 1):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= k:
                one = np.sort(s[a:b - k + 1])
                yield row + i, one[np.r_[True, one[1:] != one[:-1]]]
            elif b > a:
                x = h[a:a + 1]
                for j in range(a + 1, b):
                    x = mix(x * U(3) + h[j:j + 1])
                yield row + i, x
            else:
                yield row + i, h[:0]
