"""Elias-Fano sequences: sorted integers in about 2 + log2(universe / n) bits each, with vectorised access and search."""

from __future__ import annotations

import tempfile

import numpy as np

U64 = np.uint64
_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
POP = _bits.sum(1).astype(np.int64)
#: SELECT[byte, k]: the place of the k-th set bit.
SELECT = np.argsort(1 - _bits, axis=1, kind="stable").astype(np.int64)


class EliasFano:
    """n values; the low bits of each stand packed, the high parts in unary in a bitmap with a running count a word."""

    def __init__(self, values: np.ndarray):
        values = values.astype(U64)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.width = w = max(0, min(63, (top // max(1, n)).bit_length() - 1))
        high = (values >> U64(w)).astype(np.int64)
        self.highest = int(high[-1]) if n else -1
        bits = np.zeros((n + self.highest + 3 + 63) // 64 * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        self.high = np.packbits(bits, bitorder="little")
        ones = POP[self.high].reshape(-1, 8).sum(1)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int64)
        self.low = np.zeros(n * w // 64 + 2, U64)
        if w and n:
            low = values & U64((1 << w) - 1)
            at = np.arange(n, dtype=np.int64) * w
            word, off = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(self.low, word, low << off)
            over = (at & 63) + w > 64
            np.bitwise_or.at(self.low, word[over] + 1, low[over] >> (U64(64) - off[over]))

    def arrays(self) -> tuple[str, ...]:
        return ("high", "before", "low")

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        at = i * self.width
        word, off = at >> 6, (at & 63).astype(U64)
        out = self.low[word] >> off
        over = (at & 63) + self.width > 64
        if over.any():
            out[over] |= self.low[word[over] + 1] << (U64(64) - off[over])
        return out & U64((1 << self.width) - 1)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th one (or zero) bit."""
        count = self.before if one else self._zeros
        word = np.searchsorted(count, k, "right") - 1
        rest, place, open_ = k - count[word], np.zeros(len(k), np.int64), np.ones(len(k), bool)
        for j in range(8):
            byte = self.high[word * 8 + j]
            if not one:
                byte = ~byte
            here = POP[byte]
            now = open_ & (rest < here)
            place[now] = j * 8 + SELECT[byte[now], rest[now]]
            open_ &= ~now
            rest = np.where(open_, rest - here, rest)
        return word * 64 + place

    @property
    def _zeros(self) -> np.ndarray:
        if not hasattr(self, "_zero_counts"):
            self._zero_counts = np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        return self._zero_counts

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i).astype(U64) << U64(self.width)) | self._low(i)

    def _buckets(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each high part, how many values have a smaller one, and how many one that is no greater."""
        if 16 * len(high) < self.n:
            return self._below(high), self._below(high + 1)
        # For many questions at once the bitmap's zeros are laid out for the time of the call.
        zeros = np.flatnonzero(np.unpackbits(self.high, bitorder="little") == 0)
        below = zeros - np.arange(len(zeros))
        return np.where(high > 0, below[np.maximum(high, 1) - 1], 0), below[high]

    def _below(self, high: np.ndarray) -> np.ndarray:
        out = np.where(high > self.highest, self.n, 0)
        some = (high > 0) & (high <= self.highest)
        if some.any():
            out[some] = self._select(high[some] - 1, False) - (high[some] - 1)
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The index of the first value that is at least x; n if there is none."""
        return self.find(x)[0]

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """successor(x), and whether the value there is x itself."""
        x = x.astype(U64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = np.minimum((x >> U64(self.width)).astype(np.int64), self.highest + 1)
        lo, end = self._buckets(high)
        hi = end.copy()
        low = x & U64((1 << self.width) - 1) if self.width else np.zeros(len(x), U64)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < low[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        hit = lo < end
        at = np.flatnonzero(hit)
        hit[at] = self._low(lo[at]) == low[at]
        return lo, hit


def mapped(**arrays: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays, moved to an unnamed temporary file and mapped from there; the file goes with the arrays."""
    file = tempfile.TemporaryFile()
    places = {}
    for k, a in arrays.items():
        file.write(bytes(-file.tell() % 64))
        places[k] = file.tell()
        file.write(a.tobytes())
    file.write(bytes(64))
    file.flush()
    return {k: np.memmap(file, a.dtype, "r", places[k], a.shape) if a.size else a for k, a in arrays.items()}
