"""Vectorised byte-level text kernels shared by the operators of this subpackage.

Texts arrive as Arrow string columns, whose UTF-8 bytes are already one contiguous
buffer.  Everything here works on that buffer with numpy: no Python string is made.
All hashes are 64-bit, seeded by constants and equal on every machine and run.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.  Temporaries take about 100 bytes per text byte.
SLICE_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE_CODES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (shift-multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (sizes are rounded up, so few are kept)."""
    up = 1 << max(16, (max(n, 1) - 1).bit_length())
    a, b = _powers(up)
    return a[:n], b[:n]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of an Arrow string or binary array; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null("" if "string" in str(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-space bytes, and each text's first word.

    The third array has one entry per text and one more: words of text i are [f[i], f[i+1]).
    """
    word = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) if len(raw) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(raw) else word
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = the polynomial of raw[i:j], times BASE**i."""
    up, _ = powers(len(raw) + 1)
    h = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODES[raw] * up[:-1], out=h[1:])
    return h


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte string raw[start:end]."""
    h = prefix_hashes(raw)
    _, down = powers(len(raw) + 1)
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries of `words` (k <= 64)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out += words[j:j + n] * PLACE_CODES[j]
    return mix(out)


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text, the hashes of its k-word shingles in order, repeats included.

    A-Z is lower-cased; words are runs of non-space bytes.  A text of fewer than k words has
    its whole sequence as one shingle; one without words has none.
    """
    for i, j in slices(offsets):
        part = LOWER[raw[offsets[i]:offsets[j]]]
        starts, ends, first = word_spans(part, offsets[i:j + 1] - offsets[i])
        words = span_hashes(part, starts, ends)
        grams = gram_hashes(words, k)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                yield grams[a:b - k + 1]
            elif b > a:
                yield gram_hashes(words[a:b], int(b - a))
            else:
                yield grams[:0]


