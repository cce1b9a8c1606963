"""Elias-Fano sequences: non-decreasing integers in about 2 + log2(universe / n) bits each, with random access
and successor search. All questions are asked for whole arrays; the parts may be mapped files."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _select(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Position of the nth (from 0) one of each word, by halving."""
    words, nth, at = words.copy(), nth.astype(np.int64), np.zeros(len(words), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & np.uint64((1 << half) - 1)).astype(np.int64)
        up = nth >= low
        nth -= low * up
        at += half * up
        words = np.where(up, words >> np.uint64(half), words)
    return at


class EliasFano:
    """Views over the parts that ``build`` makes."""

    def __init__(self, parts: dict, prefix: str = ""):
        self.n, self.width = (int(x) for x in parts[prefix + "shape"])
        self.low, self.high, self.before = (parts[prefix + k] for k in ("low", "high", "before"))
        self.zeros = 64 * np.arange(len(self.before), dtype=np.int64) - self.before
        self.mask = np.uint64((1 << self.width) - 1)

    @staticmethod
    def build(values: np.ndarray, universe: int, prefix: str = "") -> dict[str, np.ndarray]:
        """Of sorted values below ``universe``."""
        n = len(values)
        values = values.astype(np.uint64)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width and n:
            tails = values & np.uint64((1 << width) - 1)
            bit = np.arange(n, dtype=np.int64) * width
            word, off = bit >> 6, (bit & 63).astype(np.uint64)
            spill = tails >> _ONE >> (np.uint64(63) - off)
            for at, part in ((word, tails << off), (word + 1, spill)):
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                low[at[first]] |= np.bitwise_or.reduceat(part, first)
        bits = np.zeros(-(-((universe >> width) + n + 2) // 64) * 64, np.uint8)
        bits[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype("<u4")
        return {prefix + "shape": np.array([n, width], "<i8"), prefix + "low": low.astype("<u8"), prefix + "high": high, prefix + "before": before}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        return (self.low[word] >> off | self.low[word + 1] << (np.uint64(63) - off) << _ONE) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions."""
        word = np.searchsorted(self.before, i, "right") - 1
        at = word * 64 + _select(self.high[word], i - self.before[word].astype(np.int64))
        return (at - i).astype(np.uint64) << np.uint64(self.width) | self._low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value's first occurrence, -1 where there is none. Values must be below the universe."""
        values = values.astype(np.uint64)
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        top = (values >> np.uint64(self.width)).astype(np.int64)
        tail = values & self.mask
        # What has this top is the run of ones before zero number top: a binary search by tails. Runs of up to 31
        # are measured by leading ones of the 32 bits before, longer ones by the place of the zero before.
        zero = self._zero(top)
        high = zero - top
        word, bit = zero >> 6, (zero & 63).astype(np.uint64)
        bits = self.high[word] << (np.uint64(63) - bit) << _ONE | np.where(word > 0, self.high[np.maximum(word - 1, 0)] >> bit, np.uint64(0))
        gap = ((~bits) >> np.uint64(32)).astype(np.float64)
        run = 32 - np.frexp(gap)[1]
        low = high - run
        long = np.flatnonzero(run >= 32)
        if len(long):
            low[long] = np.where(top[long] == 0, 0, self._zero(np.maximum(top[long] - 1, 0)) + 1 - top[long])
        end = high.copy()
        rows = np.flatnonzero(low < high)
        while len(rows):
            mid = (low[rows] + high[rows]) >> 1
            less = self._low(mid) < tail[rows]
            low[rows] = np.where(less, mid + 1, low[rows])
            high[rows] = np.where(less, high[rows], mid)
            rows = rows[low[rows] < high[rows]]
        rows = np.flatnonzero(low < end)
        hit = rows[self._low(low[rows]) == tail[rows]]
        out[hit] = low[hit]
        return out

    def _zero(self, nth: np.ndarray) -> np.ndarray:
        """Position of zeros by number."""
        word = np.searchsorted(self.zeros, nth, "right") - 1
        return word * 64 + _select(~self.high[word], nth - self.zeros[word])
