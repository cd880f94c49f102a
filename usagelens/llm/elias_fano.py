"""Elias-Fano sequences in numpy arrays, and files of arrays that are mapped into memory."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

U = np.uint64


class EliasFano:
    """A monotone sequence of n integers below u: low bits packed, high bits as a unary bit vector with counts per word.

    All queries take arrays. Parts: low, high (words of 64 bits), ones (set bits before each word of high).
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self._zeros = None

    @classmethod
    def of(cls, values: np.ndarray, u: int) -> EliasFano:
        values, n = values.astype(U), len(values)
        width = max(0, (u // max(1, n)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, U)
        if width and n:
            part = values & U((1 << width) - 1)
            bit = np.arange(n, dtype=np.int64) * width
            word, shift = bit >> 6, (bit & 63).astype(U)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low[word[first]] |= np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero((bit & 63) + width > 64)
            low[word[over] + 1] |= part[over] >> (U(64) - shift[over])
        at = (values >> U(width)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) >> 6) + 2 if n else 1, U)
        if n:
            word = at >> 6
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            high[word[first]] = np.bitwise_or.reduceat(U(1) << (at & 63).astype(U), first)
        ones = np.zeros(len(high), np.int64)
        np.cumsum(np.bitwise_count(high)[:-1], out=ones[1:])
        return cls(n, width, low, high, ones)

    @staticmethod
    def _select(word: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The place of the r-th set bit (from 0) of each word."""
        place = np.zeros(len(word), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            part = word & U((1 << step) - 1)
            c = np.bitwise_count(part).astype(np.int64)
            go = r >= c
            r = r - c * go
            place += step * go
            word = np.where(go, word >> U(step), part)
        return place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(U)
        upper = np.where(shift > 0, self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return (self.low[word] >> shift | upper) & U((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = self._select(self.high[word], i - self.ones[word]) + (word << 6)
        return ((place - i).astype(U) << U(self.width)) | self._low(i)

    def two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and at i + 1, with one search for both: the next set bit mostly stands in the same word."""
        word = np.searchsorted(self.ones, i, "right") - 1
        bits, r = self.high[word], i - self.ones[word]
        spot = self._select(bits, r)
        place = spot + (word << 6)
        rest = bits & ~((U(2) << spot.astype(U)) - U(1))
        low = rest & (~rest + U(1))
        after = np.bitwise_count(low - U(1)).astype(np.int64) + (word << 6)
        far = np.flatnonzero(rest == 0)
        if len(far):
            j = i[far] + 1
            w = np.searchsorted(self.ones, j, "right") - 1
            after[far] = self._select(self.high[w], j - self.ones[w]) + (w << 6)
        return ((place - i).astype(U) << U(self.width)) | self._low(i), ((after - i - 1).astype(U) << U(self.width)) | self._low(i + 1)

    def all(self) -> np.ndarray:
        bits = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((bits - i).astype(U) << U(self.width)) | self._low(i)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part below h."""
        if self._zeros is None:
            self._zeros = (np.arange(len(self.high), dtype=np.int64) << 6) - self.ones
        last = (len(self.high) << 6) - (int(self.ones[-1]) + int(np.bitwise_count(self.high[-1]))) if len(self.high) else 0
        out = np.full(len(h), self.n, np.int64)
        out[h == 0] = 0
        ok = np.flatnonzero((h > 0) & (h <= last))
        k = h[ok] - 1  # the zero that ends the values of high part h - 1
        word = np.searchsorted(self._zeros, k, "right") - 1
        place = self._select(~self.high[word], k - self._zeros[word]) + (word << 6)
        out[ok] = place - k
        return np.minimum(out, self.n)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The place of the first value >= x within [first, last) of each query; last if there is none."""
        h = (x >> U(self.width)).astype(np.int64)
        lo, hi = self._before(h), self._before(h + 1)
        if first is not None:
            lo, hi = np.clip(lo, first, last), np.clip(hi, first, last)
        part = x & U((1 << self.width) - 1)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < part[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.head": np.array([self.n, self.width], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def read(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = (int(x) for x in arrays[f"{name}.head"])
        return cls(n, width, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])

    def dump(self) -> bytes:
        return b"".join((np.array([self.n, self.width, len(self.low), len(self.high)], np.int64).tobytes(), self.low.tobytes(), self.high.tobytes()))

    @classmethod
    def load(cls, raw: bytes) -> EliasFano:
        n, width, a, b = (int(x) for x in np.frombuffer(raw, np.int64, 4))
        words = np.frombuffer(raw, U, a + b, 32)
        high = words[a:]
        ones = np.zeros(b, np.int64)
        np.cumsum(np.bitwise_count(high)[:-1], out=ones[1:])
        return cls(n, width, words[:a], high, ones)


def _store(uri: str):
    """(file system or None for a mounted folder, path in it) of a path or URI."""
    if uri.startswith("file:"):
        return None, "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return None, uri
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file that open_arrays maps. It appears whole or not at all, so a task may be run twice."""
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = (v.dtype.str, len(v), at)
        at += -(-v.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    store, path = _store(path)
    part = f"{path}.{uuid.uuid4().hex}"
    if store is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        f = open(part, "wb")
    else:
        store.create_dir(os.path.dirname(path), recursive=True)
        f = store.open_output_stream(part)
    with f:
        f.write(np.array([len(text)], np.int64).tobytes() + text)
        for v in arrays.values():
            f.write(v.tobytes())
            f.write(b"\0" * (-v.nbytes % 8))
    if store is None:
        os.replace(part, path)
    else:
        store.move(part, path)


def open_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory; from a store that isn't mounted by way of a copy that vanishes with the process."""
    store, path = _store(path)
    if store is None:
        raw = np.memmap(path, np.uint8, "r")
    else:
        import shutil
        import tempfile

        with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(path) as f:
            shutil.copyfileobj(f, copy)
            copy.flush()
            raw = np.memmap(copy.name, np.uint8, "r")
    raw = np.asarray(raw)  # a plain view of the mapped bytes: results of it are plain arrays
    size = int(raw[:8].view(np.int64)[0])
    head = json.loads(raw[8 : 8 + size].tobytes())
    return {k: raw[8 + size + at : 8 + size + at + np.dtype(kind).itemsize * n].view(kind) for k, (kind, n, at) in head.items()}
