"""Elias-Fano sequences in flat arrays that can be memory-mapped, with vectorised access and successor search."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

import numpy as np

U64 = np.uint64


class Sequence:
    """A non-decreasing sequence of numbers below ``universe``: low bits packed, high parts in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.l = n, low_bits
        self.low, self.high, self.ones = low, high, ones  # bytes, 64-bit words, ones before each word

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> Sequence:
        n = len(values)
        values = values.astype(np.uint64)
        low_bits = min(56, max(0, (universe // max(1, n)).bit_length() - 1))
        bits = np.zeros((n, low_bits), np.uint8)
        for j in range(low_bits):
            bits[:, j] = (values >> U64(j)).astype(np.uint8) & 1
        low = np.concatenate([np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8)])
        place = (values >> U64(low_bits)).astype(np.int64) + np.arange(n)
        size = ((universe >> low_bits) + n + 64) // 64 + 1
        high = np.zeros(size, np.uint64)
        np.bitwise_or.at(high, place >> 6, U64(1) << (place & 63).astype(np.uint64))
        ones = np.zeros(size + 1, np.uint32)
        np.cumsum(np.bitwise_count(high), out=ones[1:], dtype=np.uint32)
        return cls(n, low_bits, low, high, ones)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"meta": np.array([self.n, self.l], np.int64), "low": self.low, "high": self.high, "ones": self.ones}

    @classmethod
    def load(cls, a: dict[str, np.ndarray]) -> Sequence:
        return cls(int(a["meta"][0]), int(a["meta"][1]), a["low"], a["high"], a["ones"])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        bit = i * self.l
        every = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        return (every[bit >> 3] >> (bit & 7).astype(np.uint64)) & U64((1 << self.l) - 1)

    @staticmethod
    def _in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of the r-th set bit (from 0) of each word."""
        at = np.zeros(len(word), np.int64)
        word, r = word.copy(), r.astype(np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(word & U64((1 << width) - 1)).astype(np.int64)
            skip = r >= c
            r = np.where(skip, r - c, r)
            at += np.where(skip, width, 0)
            word = np.where(skip, word >> U64(width), word)
        return at

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + self._in_word(self.high[word], i - self.ones[word])
        return ((at - i).astype(np.uint64) << U64(self.l)) | self._low(i)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """Number of elements whose high part is below h (h of at least 1)."""
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(zeros, h - 1, "right") - 1
        return word * 64 + self._in_word(~self.high[word], h - 1 - zeros[word]) - (h - 1)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each number, -1 where the sequence lacks it: a successor search inside the bucket of its high part."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        h = (x >> U64(self.l)).astype(np.int64)
        inside = h < len(self.high) * 64 - self.n - 1
        if not inside.all():
            out[inside] = self.find(x[inside])
            return out
        lo = np.where(h > 0, self._before(np.maximum(h, 1)), 0)
        hi = self._before(h + 1)
        want = x & U64((1 << self.l) - 1)
        end = hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        there = np.flatnonzero(lo < end)
        hit = there[self._low(lo[there]) == want[there]]
        out[hit] = lo[hit]
        return out


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Named arrays in one file, each aligned to 64 bytes behind a JSON index; renamed into place when complete."""
    index, at = {}, 0
    for k, a in arrays.items():
        index[k] = [a.dtype.str, list(a.shape), at]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(index).encode()
    start = -(-(8 + len(head)) // 64) * 64
    blob = bytearray(start + at)
    blob[:8] = len(head).to_bytes(8, "little")
    blob[8:8 + len(head)] = head
    for k, a in arrays.items():
        p = start + index[k][2]
        blob[p:p + a.nbytes] = np.ascontiguousarray(a).tobytes()
    fs, path = _filesystem(path)
    if fs is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(blob)
        os.replace(part, path)
    else:
        fs.create_dir(os.path.dirname(path), recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(bytes(blob))
        fs.move(part, path)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of ``save``, memory-mapped where the folder is mounted, read where it is in another store."""
    fs, path = _filesystem(path)
    blob = np.memmap(path, np.uint8, "r") if fs is None else np.frombuffer(fs.open_input_file(path).read(), np.uint8)
    n = int.from_bytes(blob[:8].tobytes(), "little")
    index = json.loads(blob[8:8 + n].tobytes())
    start = -(-(8 + n) // 64) * 64
    out = {}
    for k, (kind, shape, at) in index.items():
        dtype = np.dtype(kind)
        size = dtype.itemsize * int(np.prod(shape))
        out[k] = blob[start + at:start + at + size].view(dtype).reshape(shape)
    return out


def _filesystem(uri: str):
    """(None, path) of a mounted folder, else (file system, path)."""
    if "://" not in uri and not uri.startswith("file:"):
        return None, uri
    if uri.startswith("file:"):
        return None, "/" + uri[5:].lstrip("/")
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)
