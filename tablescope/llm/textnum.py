"""Byte-level helpers on Arrow string columns: words, 64-bit hashes and ragged indexing with numpy.

A batch is cut into chunks of whole texts of about ``CHUNK`` bytes, so the arrays of a task are
bounded by the chunk or by the longest single text, not by the batch.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64
_RNG = np.random.default_rng(20240607)
_BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE_LOWER = _TABLE[LOWER]
#: White space of the word definition ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def release() -> None:
    """Give memory that is no longer used back to the system: Python workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base^i`` and ``base^-i`` modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), CHUNK // 4)
        for k, b in enumerate((_BASE, _INVERSE)):
            step = np.full(size, b & (2**64 - 1), np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def chunks(text: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets with one more entry than rows); null is the empty text."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    if not n:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        end = min(end, n)
        yield start, end, data[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
        start = end


def prefix_hash(b: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` of them is a hash of any span."""
    p, _ = powers(len(b) + 1)
    out = np.empty(len(b) + 1, np.uint64)
    out[0] = 0
    np.cumsum((_TABLE_LOWER if lower else _TABLE)[b] * p[:len(b)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(prefix))
    return (prefix[end] - prefix[start]) * inv[start]


def words(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every word of every text."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SPACE[b]
    edge = np.ones(len(b) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    keep = word[start]
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the words with A-Z lower-cased."""
    start, end, doc = words(b, offsets)
    return mix(span_hash(prefix_hash(b, lower=True), start, end)), doc


def counts_to_offsets(n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``start[i] .. start[i] + length[i] - 1``."""
    total = int(length.sum())
    first = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - first, length)


def sum_by(cell: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Sums modulo 2^64 of 64-bit values by cell."""
    low = np.bincount(cell, (value & U64(0xFFFFFFFF)).astype(np.float64), size)
    high = np.bincount(cell, (value >> U64(32)).astype(np.float64), size)
    return low.astype(np.uint64) + (high.astype(np.uint64) << U64(32))
