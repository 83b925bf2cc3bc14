"""Numbers for pieces of bytes inside Arrow tasks: equal numbers mean equal bytes, not equal hashes."""

from __future__ import annotations

import numpy as np

from .blocks import mix


class HashIndex:
    """64-bit keys -> 0, 1, 2, ... in order of arrival; open addressing over arrays."""

    def __init__(self, most: int):
        bits = (4 * most).bit_length()
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros((1 << bits) + (1 << 16), np.uint64)
        self.values = np.zeros(len(self.keys), np.int32)
        self.n = 0

    def _walk(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key, or the free slot where its search ends; and whether it was found."""
        slot = (mix(keys) >> self.shift).astype(np.int64)
        have = self.keys[slot]
        found = have == keys
        odd = np.flatnonzero(~found & (have != 0))
        while len(odd):
            slot[odd] += 1
            have = self.keys[slot[odd]]
            found[odd] = have == keys[odd]
            odd = odd[(have != keys[odd]) & (have != 0)]
        return slot, found

    def number(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each key, and where the keys that are new first stand in ``keys``."""
        keys = np.where(keys == 0, np.uint64(1), keys)
        slot, found = self._walk(keys)
        out = self.values[slot]
        missing = np.flatnonzero(~found)
        new, first = np.unique(keys[missing], return_index=True)
        first = missing[first]
        left = np.arange(len(new))
        while len(left):  # several new keys may end at one free slot: one of them takes it
            at, _ = self._walk(new[left])
            _, one = np.unique(at, return_index=True)
            self.keys[at[one]], self.values[at[one]] = new[left[one]], self.n + left[one]
            left = np.delete(left, one)
        self.n += len(new)
        out[missing] = self.n - len(new) + np.searchsorted(new, keys[missing])
        return out, first


#: Bits of the first 0 to 8 bytes of a word of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes of each piece as a number, and the next eight; what is past its end is zero."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    words_ = np.ndarray((len(data) + 9,), "<u8", padded.data, strides=(1,))
    return words_[starts] & _FIRST[np.minimum(sizes, 8)], words_[np.minimum(starts + 8, len(data))] & _FIRST[np.clip(sizes - 8, 0, 8)]


class PieceIndex:
    """Pieces -> 0, 1, 2, ... in order of arrival, told apart by their bytes.

    Pieces of at most 16 bytes are two numbers, looked up by a hash of both and
    then compared; longer ones, and any whose hash another piece has, are keys
    of a dictionary.
    """

    def __init__(self, most: int):
        self.table, self.n = HashIndex(most), 0
        self.low = self.high = np.zeros(0, np.uint64)
        self.size = self.piece = np.zeros(0, np.int64)
        self.other: dict[bytes, int] = {}

    def number(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Number of each piece of ``data``, and the bytes of those that are new, in order of their numbers."""
        sizes = ends - starts
        out = np.empty(len(starts), np.int64)
        short = np.flatnonzero(sizes <= 16)
        low, high = packed(data, starts[short], sizes[short])
        entry, first = self.table.number(mix(low ^ mix(high + sizes[short].astype(np.uint64))))
        self.low, self.high = np.concatenate((self.low, low[first])), np.concatenate((self.high, high[first]))
        self.size = np.concatenate((self.size, sizes[short[first]]))
        self.piece = np.concatenate((self.piece, self.n + np.arange(len(first))))
        self.n += len(first)
        out[short] = self.piece[entry]
        same = (self.low[entry] == low) & (self.high[entry] == high) & (self.size[entry] == sizes[short])
        odd = np.concatenate((np.flatnonzero(sizes > 16), short[~same]))
        raw = data.tobytes() if len(first) or len(odd) else b""
        new = [raw[a:b] for a, b in zip(starts[short[first]].tolist(), ends[short[first]].tolist(), strict=True)]
        for i, a, b in zip(odd.tolist(), starts[odd].tolist(), ends[odd].tolist(), strict=True):
            found = self.other.get(raw[a:b])
            if found is None:
                found = self.other[raw[a:b]] = self.n
                self.n += 1
                new.append(raw[a:b])
            out[i] = found
        return out, new
