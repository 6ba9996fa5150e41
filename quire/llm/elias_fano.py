"""Monotone integer sequences in Elias-Fano form, with vectorised access and search.

The low ``l`` bits of each value are stored as they are; the high parts as a
bit vector in which each value is a one after as many zeros as its high part.
A directory of ones before each 64-bit word serves ``select``.  Arrays are
plain buffers, so a sequence can live in a memory map.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

# place of the k-th one in a byte
_PLACE = np.zeros((256, 8), np.int64)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _PLACE[_b, _k] = _p


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, l: int, low: np.ndarray, bits: np.ndarray, ones: np.ndarray):  # noqa: E741
        self.n, self.l, self.low, self.bits, self.ones = n, l, low, bits, ones

    @cached_property
    def zeros(self) -> np.ndarray:
        """Zeros before each 64-bit word."""
        return np.arange(len(self.ones)) * 64 - self.ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        l = max(0, int(top // max(n, 1)).bit_length() - 1)  # noqa: E741
        high = (values >> np.uint64(l)).astype(np.int64)
        kind = np.uint8 if l <= 8 else np.uint16 if l <= 16 else np.uint32 if l <= 32 else np.uint64
        low = (values & np.uint64((1 << l) - 1)).astype(kind)
        bits = np.zeros(((int(high[-1]) if n else 0) + n + 2) // 64 + 1, np.uint64)
        at = high + np.arange(n)
        np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))]).astype(np.int64)
        return cls(n, l, low, bits, ones)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.l], np.int64), self.low, self.bits, self.ones]

    @classmethod
    def from_parts(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero."""
        before = self.zeros if zeros else self.ones
        word = np.minimum(np.searchsorted(before, k, side="right") - 1, len(self.bits) - 1)
        x = ~self.bits[word] if zeros else self.bits[word]
        k, at = k - before[word], word * 64
        for half in (32, 16, 8):
            ones = np.bitwise_count(x & np.uint64((1 << half) - 1))
            up = k >= ones
            k = k - ones * up
            at += half * up
            x = x >> (up * np.uint64(half))
        return at + _PLACE[x & np.uint64(255), np.clip(k, 0, 7)]

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i`` (each within the sequence)."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, zeros=False) - i) << self.l) | self.low[i].astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of the first equal value, or -1."""
        values = np.asarray(values, np.int64)
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        high, low = values >> self.l, values & ((1 << self.l) - 1)
        ask = np.flatnonzero((values >= 0) & (high <= int(self.bits.size * 64 - self.n) - 1))
        # ones between the zeros number high - 1 and high have that high part
        h = high[ask]
        a = np.where(h > 0, self._select(np.maximum(h - 1, 0), zeros=True) - (h - 1), 0)
        b = np.minimum(self._select(h, zeros=True) - h, self.n)
        lo, hi = np.minimum(a, self.n), b.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.low[mid] < low[ask[live]]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        ok = (lo < b) & (self.low[np.minimum(lo, self.n - 1)].astype(np.int64) == low[ask])
        out[ask[ok]] = lo[ok]
        return out
