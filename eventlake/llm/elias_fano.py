"""Elias-Fano sequences over flat buffers: rising integers as packed low bits and unary high bits, searched in place.

All look-ups take arrays of queries. A sequence is a list of arrays that `pack` lays one behind the other, each padded to
eight bytes, and `views` finds again in any buffer, a memory map as well, without a copy.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Number of arrays, then (type, length) of each, then their bytes."""
    heads = [len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), len(a))]
    return np.array(heads, np.int64).tobytes() + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)


def views(buffer) -> list[np.ndarray]:  # noqa: ANN001
    count = int(np.frombuffer(buffer, np.int64, 1)[0])
    heads, at, out = np.frombuffer(buffer, np.int64, 2 * count, 8).reshape(-1, 2).tolist(), 8 + 16 * count, []
    for kind, n in heads:
        out.append(np.frombuffer(buffer, chr(kind), n, at))
        at += out[-1].nbytes + -out[-1].nbytes % 8
    return out


def _select_in(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th set bit (from 0) of each 64-bit word."""
    place, words, r = np.zeros(len(words), np.int64), words.copy(), r.astype(np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & np.uint64((1 << half) - 1)).astype(np.int64)
        up = r >= low
        r -= low * up
        place += half * up
        words >>= (half * up).astype(np.uint64)
    return place


class EliasFano:
    """n integers that never fall, below `limit`."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.head, self.low, self.high, self.ones = head, low, high, ones
        self.n, self.bits = int(head[0]), int(head[1])
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray, limit: int) -> EliasFano:
        """Of sorted uint64 values."""
        n = len(values)
        bits = max(0, (limit // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if n and bits:
            rest, at = values & np.uint64((1 << bits) - 1), np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[starts]] |= np.bitwise_or.reduceat(rest << shift, starts)
            over = (at & 63) + bits > 64
            low[word[over] + 1] |= rest[over] >> (np.uint64(64) - shift[over])
        size = n + (int(limit) >> bits) + 2
        marks = np.zeros(-(-size // 64) * 64, bool)
        marks[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(marks, bitorder="little").view(np.uint64)
        ones = np.zeros(len(high) + 1, np.int64)
        np.cumsum(np.bitwise_count(high), out=ones[1:])
        return cls(np.array([n, bits], np.int64), low, high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [self.head, self.low, self.high, self.ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        # a shift by 64 is two of at most 63
        over = (self.low[word + 1] << (np.uint64(63) - shift)) << ONE
        return (self.low[word] >> shift | over) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in(self.high[word], i - self.ones[word])
        return (place - i).astype(np.uint64) << np.uint64(self.bits) | self._low(i)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have high bits below these."""
        out = np.zeros(len(high), np.int64)
        some = high > 0
        k = high[some] - 1
        word = np.searchsorted(self.zeros, k, "right") - 1
        out[some] = word * 64 + _select_in(~self.high[word], k - self.zeros[word]) - k
        return out

    def successor(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The place of the first value >= x within begin:end (end if there is none)."""
        high, low = (x >> np.uint64(self.bits)).astype(np.int64), x & np.uint64((1 << self.bits) - 1)
        lo, hi = self._below(high), self._below(high + 1)
        if begin is not None:
            lo, hi = np.clip(lo, begin, end), np.clip(hi, begin, end)
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) // 2
            less = self._low(middle) < low[open_]
            lo[open_] = np.where(less, middle + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle)
        return lo
