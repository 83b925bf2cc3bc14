"""A wavelet matrix over token ids: bit-planes with rank directories.

Plane 0 holds the highest bit of each id in text order; each next plane holds
the next bit after the ids were stably parted into zeros first, ones after.
A position is followed down the planes with one rank each, so any id is read,
counted or found in as many steps as there are planes, from the packed bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Bits between entries of the rank directory.
EVERY = 512
#: First bit of each word of an entry, and the lowest 0 to 64 bits of a word.
_PLACES = np.arange(0, EVERY, 64)
_FIRST = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


@dataclass
class WaveletMatrix:
    n: int
    bits: np.ndarray  # (planes, ceil(n / 8)) uint8, bits in little order
    ranks: np.ndarray  # (planes, n // EVERY + 1) uint32: ones before each EVERY-th bit
    zeros: np.ndarray  # (planes,) int64

    @classmethod
    def build(cls, ids: np.ndarray, planes: int | None = None) -> WaveletMatrix:
        n = len(ids)
        depth = planes or max(1, int(ids.max(initial=0)).bit_length())
        seq = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        bits = np.zeros((depth, (n + 7) // 8), np.uint8)
        for p in range(depth):
            one = (seq & seq.dtype.type(1 << (depth - 1 - p))) != 0
            bits[p] = np.packbits(one, bitorder="little")
            seq = np.concatenate((np.compress(~one, seq), np.compress(one, seq)))
        step = EVERY // 8
        padded = np.zeros((depth, (n // EVERY + 1) * step), np.uint8)
        padded[:, : bits.shape[1]] = bits
        each = np.bitwise_count(padded.view(np.uint64)).reshape(depth, -1, step // 8).sum(axis=2, dtype=np.int64)
        total = np.cumsum(each, axis=1)
        return cls(n, bits, (total - each).astype(np.uint32), n - total[:, -1])

    @cached_property
    def words(self) -> np.ndarray:
        """The planes as (planes, entries of the directory, words of 64 bits)."""
        padded = np.zeros((len(self.bits), self.ranks.shape[1] * EVERY // 8), np.uint8)
        padded[:, : self.bits.shape[1]] = self.bits
        return padded.view("<u8").reshape(len(self.bits), -1, EVERY // 64)

    def _ones(self, p: int, i: np.ndarray) -> np.ndarray:
        """Ones before positions ``i`` of plane p: an entry of the directory and the bits since."""
        s = np.minimum(i // EVERY, self.ranks.shape[1] - 1)
        since = np.clip((i - s * EVERY)[:, None] - _PLACES, 0, 64)
        return self.ranks[p, s] + np.bitwise_count(self.words[p, s] & _FIRST[since]).sum(axis=1, dtype=np.int64)

    def accesses(self, i: np.ndarray) -> np.ndarray:
        """The ids at positions ``i``."""
        i = np.asarray(i, np.int64)
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError("no such position")
        value = np.zeros(len(i), np.int64)
        for p in range(len(self.bits)):
            ones, bit = self._ones(p, i), self.bits[p, i >> 3] >> (i & 7).astype(np.uint8) & 1
            value = value << 1 | bit
            i = np.where(bit, self.zeros[p] + ones, i - ones)
        return value

    def _below(self, values: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where what stands before positions ``i`` ends, below the last plane, on the path of each value."""
        depth = len(self.bits)
        for p in range(depth):
            ones = self._ones(p, i)
            i = np.where(values >> (depth - 1 - p) & 1, self.zeros[p] + ones, i - ones)
        return i

    def ranks_of(self, values: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each value before its position."""
        values, i = np.asarray(values, np.int64), np.asarray(i, np.int64)
        known = (values >= 0) & (values >> len(self.bits) == 0)
        own = np.where(known, values, 0)
        return np.where(known, self._below(own, i) - self._below(own, np.zeros(len(i), np.int64)), 0)

    def selects(self, values: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th occurrences (from 0) of values that have as many."""
        values, k = np.asarray(values, np.int64), np.asarray(k, np.int64)
        i, depth = self._below(values, np.zeros(len(k), np.int64)) + k, len(self.bits)
        for p in reversed(range(depth)):
            one = values >> (depth - 1 - p) & 1
            i = self._places(p, one, i - np.where(one, self.zeros[p], 0))
        return i

    def _places(self, p: int, bit: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th bits of their kind in plane p: the entry, the word and the bit where the count is reached."""
        out = np.empty(len(k), np.int64)
        ones = self.ranks[p].astype(np.int64)
        for kind, before in ((1, ones), (0, np.arange(len(ones)) * EVERY - ones)):
            every = np.flatnonzero(bit == kind)
            for own in np.array_split(every, len(every) // 65536 + 1):
                s = np.searchsorted(before, k[own], side="right") - 1
                words = self.words[p, s] if kind else ~self.words[p, s]
                left, upto = k[own] - before[s], np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
                w = (upto <= left[:, None]).sum(axis=1)
                row = np.arange(len(own))
                left = left - np.where(w > 0, upto[row, w - 1], 0)
                bits = np.unpackbits(np.ascontiguousarray(words[row, w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                out[own] = s * EVERY + w * 64 + (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)
        return out

    def access(self, i: int) -> int:
        """The id at position i."""
        return int(self.accesses([i])[0])

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` before position i."""
        return int(self.ranks_of([value], [i])[0])

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of ``value``."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        return int(self.selects([value], [k])[0])

    def occurrences(self, value: int) -> np.ndarray:
        """All positions of ``value``, in order."""
        n = self.count(value)
        return self.selects(np.full(n, value), np.arange(n))

    def decode(self) -> np.ndarray:
        """All ids in order: the planes undone from the last to the first."""
        depth = len(self.bits)
        kind = np.uint16 if depth <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for p in reversed(range(depth)):
            one = np.unpackbits(self.bits[p], count=self.n, bitorder="little").view(bool)
            z, back = int(self.zeros[p]), np.empty_like(seq)
            back[np.flatnonzero(~one)] = seq[:z]
            back[np.flatnonzero(one)] = seq[z:] | kind(1 << (depth - 1 - p))
            seq = back
        return seq
