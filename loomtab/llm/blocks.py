"""Vectorised views of text columns inside Arrow tasks.

Spark deals the rows out; inside a task the operators of this package look at
the UTF-8 bytes of many documents at once. ``blocks`` cuts an Arrow string
column into runs of whole documents of about ``BLOCK_BYTES`` bytes, so that
scratch arrays stay small whatever the batch size. A document longer than
that is a block of its own: texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scratch arrays of a block of this size stay in a core's cache.
BLOCK_BYTES = 1 << 18
#: An odd multiplier has an inverse modulo 2**64, so a window's hash follows from prefix sums.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: ASCII white space of the word patterns: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Block:
    """Whole documents side by side: document ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or not data.size:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Runs of whole documents of at most ``most`` bytes (one longer document stands alone)."""
    data, at = text_arrays(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield Block(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; the longest table so far is kept while it is of block size."""
    have = _powers.get(int(base))
    if have is not None and len(have) >= n:
        return have[:n]
    size = max(n, BLOCK_BYTES + 1024)
    table = np.full(size, base, np.uint64)
    table[0] = 1
    np.multiply.accumulate(table, out=table)
    if size <= 4 * BLOCK_BYTES:
        _powers[int(base)] = table
    return table[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums of ``value[j] * BASE**j`` over prefixes, modulo 2**64; one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(values)), out=out[1:])
    return out


def window_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each [start, end): equal contents and lengths give equal hashes wherever they stand."""
    n = len(prefix)
    return mix((prefix[ends] - prefix[starts]) * powers(BASE_INV, n)[starts] + (ends - starts).astype(np.uint64) * _MIX2)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads low and high bits (in a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def words(block: Block, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes outside ``space``, and how many words each document has.

    Words never cross documents.
    """
    data, at = block.data, block.offsets
    inside = ~space[data]
    first = np.zeros(len(data) + 1, bool)  # bytes at which a document starts
    first[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.diff(np.searchsorted(starts, at))


def per_document(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over consecutive groups of the given sizes (0 for empty groups)."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    edges = np.concatenate(([0], np.cumsum(counts)))
    return total[edges[1:]] - total[edges[:-1]]
