"""Hashes of the words and shingles of many texts at once, straight from their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are read together in blocks of so many bytes, or of one text; words are hashed in such blocks, or one by one.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.random.default_rng(21).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts without nulls: first, one past the last, their bytes end to end, and where each starts (and the end)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def split_words(code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in texts that lie end to end; 0 stands between words, and no word spans two texts."""
    inside = code != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    seams = offsets[(offsets > 0) & (offsets < len(code))]
    first[seams], last[seams - 1] = inside[seams], inside[seams - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def hash_words(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``code[start:end]``: polynomials of their bytes, from running sums."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        low, n = starts[at], int(ends[to - 1] - starts[at])
        up, down = _powers(max(n, BLOCK) + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(code[low : low + n] * up[:n], out=run[1:])
        first = starts[at:to] - low
        out[at:to] = (run[ends[at:to] - low] - run[first]) * down[first]
        at = to
    return out


def hash_shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words, from the words' hashes."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        x = words[i : n + i] * _MIX[i]
        out = (out ^ (x >> np.uint64(29)) ^ x) * _MIX[0]
    return out ^ (out >> np.uint64(32))
