"""Small numpy helpers that run inside tasks: cutting Arrow batches, mixing hashes, packing columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Characters that one numpy step takes at a time; a longer text is a step of its own.
STEP = 1_000_000


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP) -> Iterator[tuple[int, int, list]]:
    """(first row, past the last row, values) of consecutive runs of rows of about ``most`` characters."""
    values = batch.column(column).to_pylist()
    lo = size = 0
    for i, v in enumerate(values):
        n = len(v or "")
        if i > lo and size + n > most:
            yield lo, i, values[lo:i]
            lo, size = i, 0
        size += n
    if lo < len(values):
        yield lo, len(values), values[lo:]


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values, so that their leading bits are uniform."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def pack(a: np.ndarray) -> bytes:
    """An integer column as compressed byte planes: equal high bytes cost next to nothing."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(b: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    flat = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(flat.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours in ``a``."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    return starts, np.append(starts[1:], len(a))


def within(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges, range after range."""
    n = ends - starts
    total = int(n.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    full = n > 0
    s, n = starts[full], n[full]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


#: Eight-byte steps of a word's hash; what a word has beyond them is digested at once.
LANES = 64


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of several texts as numpy columns.

    data: all texts as UTF-8 with one space after each; start, end: byte places of the words;
    doc: each word's text; first: each text's first word, with one more entry for the end.
    """

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        white = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], white)).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        sizes = np.array([len(r) + 1 for r in raw], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes: eight bytes at a time go into a one-to-one scrambling.
        Hashes of another ``seed`` collide independently."""
        left = self.end - self.start
        h = mixed(left.astype(np.uint64) + np.uint64(seed))
        eight = np.ndarray(len(self.data), "<u8", self.data.tobytes() + bytes(8), strides=(1,))
        live, at = np.arange(len(left)), self.start
        for _ in range(LANES):
            if not len(live):
                return h
            lane = eight[at]
            short = left < 8
            lane[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
            h[live] = mixed(h[live] ^ lane)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        for k in live.tolist():  # what is left of very long words
            rest = hashlib.blake2b(self.word(k)[8 * LANES :], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
            h[k] = mixed(h[k : k + 1] ^ np.frombuffer(rest, np.uint64))[0]
        return h

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


_POWERS: list[np.ndarray] = []
BASE = 0x5851F42D4C957F2D


def _powers(n: int) -> list[np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64)))) for b in (BASE, inverse)]
    return _POWERS


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n neighbouring values (64-bit, wrapping)."""
    m = len(values)
    if m < n:
        return np.empty(0, np.uint64)
    power = _powers(m + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(power[0][:m] * (values.astype(np.uint64) + np.uint64(1)))))
    return mixed((total[n:] - total[: m - n + 1]) * power[1][: m - n + 1])
