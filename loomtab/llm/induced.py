"""Suffix and common-prefix arrays by external induced sorting, in bulk array steps.

Suffixes are S-type if they are smaller than the next suffix, else L-type. The
order of the leftmost S-type suffixes (LMS) induces that of all others: a scan
in ascending order puts each suffix's L-type predecessor into a queue for the
predecessor's first symbol, a scan in descending order the S-type ones. What
enters a symbol's queue enters in order, so a priority queue over (symbol,
rank) is a first-in first-out queue for each symbol; everything that waits for
the least symbol is taken out at once as an array. Queues hold suffix tuples
(position, common prefix with the tuple before) and move to a file when they
outgrow ``memory`` bytes; sorted runs go to files in the same way.

Common-prefix values ride along: the value between two tuples that follow each
other in a queue is one more than the least value between their sources, read
from a sparse table over the scanned batch and a carried minimum a symbol. They
are capped at ``CAP``.

The LMS suffixes themselves are sorted by naming the LMS substrings, which a
first induction sorts, and recursing on the string of names. A string of at most
``base`` names is sorted by prefix doubling, as in a queue for each of so many
symbols there are a tuple or two; beyond that it is sorted like the text. Types
and numbers of positions are arrays in files once they outgrow an eighth of
``memory``, as the text may be.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

CAP = 255
_CHUNK = 1 << 20
NAMES = 1 << 22  # names that prefix doubling sorts in memory, at some 48 bytes each


def _kind(n: int) -> np.dtype:
    """Integers for positions below n."""
    return np.dtype("<i4" if n < 1 << 31 else "<i8")


def _tuple(n: int) -> np.dtype:
    return np.dtype([("at", _kind(n)), ("common", "u1")])


def scratch() -> str:
    """Where Spark itself spills: its local folders, which it clears when a worker goes."""
    folders = os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()
    return min(folders.split(","), key=lambda f: hash((f, os.getpid())))


class Store:
    """Queues of tuples and arrays that share a bound on memory; the rest is in files of a folder of this task."""

    #: Bytes that this worker has put into files so far, for tests and figures.
    spilled = 0

    def __init__(self, memory: int, size: int):
        self.tuple = _tuple(size)
        self.memory, self.used, self.folder, self.files = memory, 0, None, 0
        self.queues: list[Queue] = []

    def queue(self) -> Queue:
        self.queues.append(q := Queue(self))
        return q

    def path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="induced-", dir=scratch())
        self.files += 1
        return os.path.join(self.folder, str(self.files))

    def array(self, n: int, kind) -> np.ndarray:
        """An array of n zeros; in a file, of which the system holds what it has room for, if it is over an eighth of the bound."""
        size = n * np.dtype(kind).itemsize
        if size <= self.memory // 8:
            return np.zeros(n, kind)
        Store.spilled += size
        return np.memmap(self.path(), kind, "w+", shape=(n,))

    def spill(self) -> None:
        for q in sorted(self.queues, key=lambda q: -q.held):
            if self.used <= self.memory // 2 or not q.held:
                break
            q.to_disk()

    def close(self) -> None:
        if self.folder is not None:
            shutil.rmtree(self.folder, ignore_errors=True)


class Queue:
    """First in, first out; parts are arrays of positions and common-prefix values."""

    def __init__(self, store: Store):
        self.store, self.parts, self.held, self.file, self.written, self.read = store, [], 0, None, 0, 0

    def __len__(self) -> int:
        return self.written - self.read + sum(len(p) for p in self.parts)

    def put(self, at: np.ndarray, common: np.ndarray) -> None:
        part = np.empty(len(at), self.store.tuple)
        part["at"], part["common"] = at, common
        self.parts.append(part)
        self.held += part.nbytes
        self.store.used += part.nbytes
        if self.store.used > self.store.memory:
            self.store.spill()

    def to_disk(self) -> None:
        if self.file is None:
            self.file = self.store.path()
        with open(self.file, "ab") as f:
            for part in self.parts:
                part.tofile(f)
                self.written += len(part)
                Store.spilled += part.nbytes
        self._let_go()

    def _let_go(self) -> None:
        self.store.used -= self.held
        self.parts, self.held = [], 0

    def take(self) -> np.ndarray:
        """The next tuples: at most a chunk of those on disk, then all that are in memory."""
        if self.read < self.written:
            n = min(_CHUNK, self.written - self.read)
            out = np.fromfile(self.file, self.store.tuple, n, offset=self.read * self.store.tuple.itemsize)
            self.read += n
            return out
        out = np.concatenate(self.parts) if len(self.parts) != 1 else self.parts[0]
        self._let_go()
        return out

    def backwards(self):
        """All tuples from the last to the first in chunks; the queue stays as it is.

        What is in memory at the start may move to the file meanwhile; it is not read again there.
        """
        left, parts = self.written, list(self.parts)
        for part in reversed(parts):
            yield part[::-1]
        while left:
            n = min(_CHUNK, left)
            left -= n
            yield np.fromfile(self.file, self.store.tuple, n, offset=left * self.store.tuple.itemsize)[::-1]

    def forwards(self):
        left, written, parts = 0, self.written, list(self.parts)
        while left < written:
            n = min(_CHUNK, written - left)
            yield np.fromfile(self.file, self.store.tuple, n, offset=left * self.store.tuple.itemsize)
            left += n
        yield from parts


class _Minima:
    """Least value of ranges of one array of bytes."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half, last = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For ranges [first, stop), none empty."""
        level = np.frexp(stop - first)[1] - 1
        out = np.empty(len(first), np.uint8)
        for k in np.unique(level):
            i = np.flatnonzero(level == k)
            row = self.rows[k]
            out[i] = np.minimum(row[first[i]], row[stop[i] - (1 << int(k))])
        return out


class _Scan:
    """One pass that hands predecessors to the queues of their symbols."""

    def __init__(self, text: np.ndarray, symbols: int, store: Store):
        self.text, self.queues = text, [store.queue() for _ in range(symbols)]
        self.carried = np.zeros(symbols, np.uint8)  # least value scanned since the last push to the symbol
        self.fresh = np.ones(symbols, bool)

    def batch(self, at: np.ndarray, common: np.ndarray, wanted) -> None:
        """``at`` in scan order, ``common[i]`` with the one scanned before; ``wanted``: which predecessors to push."""
        if not len(at):
            return
        source = np.flatnonzero(at > 0)
        before = self.text[at[source] - 1]
        keep = wanted(before)
        source, before = source[keep], before[keep]
        if not len(source):
            np.minimum(self.carried, common.min(), out=self.carried)
            return
        order = np.argsort(before, kind="stable")
        source, before = source[order], before[order]
        head = np.concatenate(([True], before[1:] != before[:-1]))
        value = np.empty(len(source), np.uint8)
        i = np.flatnonzero(~head)
        minima = _Minima(common)
        if len(i):
            value[i] = minima(source[i - 1] + 1, source[i] + 1)
        i = np.flatnonzero(head)
        symbols = before[i].astype(np.int64)
        value[i] = np.minimum(np.minimum.accumulate(common)[source[i]], self.carried[symbols])
        value = np.minimum(value, CAP - 1) + np.uint8(1)
        value[i[self.fresh[symbols]]] = 0
        edges = np.append(i, len(source))
        np.minimum(self.carried, common.min(), out=self.carried)
        last = source[edges[1:] - 1]
        self.carried[symbols] = CAP
        inner = last + 1 < len(common)
        if inner.any():
            self.carried[symbols[inner]] = minima(last[inner] + 1, np.full(inner.sum(), len(common)))
        self.fresh[symbols] = False
        for s, a, b in zip(symbols.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            self.queues[s].put(at[source[a:b]] - 1, value[a:b])


def types(text: np.ndarray, out: np.ndarray | None = None, chunk: int = _CHUNK) -> np.ndarray:
    """Whether each suffix is S-type; the last one is. From the end on, a chunk at a time."""
    n = len(text)
    out = np.empty(n, bool) if out is None else out
    out[n - 1] = True
    for stop in range(n - 1, 0, -chunk):
        start = max(stop - chunk, 0)
        part = np.asarray(text[start : stop + 1])
        own = np.append(part[:-1] < part[1:], bool(out[stop]))
        equal = np.flatnonzero(part[:-1] == part[1:])
        if len(equal):  # a run takes the type of its last position
            last = np.append(np.diff(equal) != 1, True)
            own[equal] = own[np.repeat(equal[last] + 1, np.diff(np.flatnonzero(last), prepend=-1))]
        out[start:stop] = own[:-1]
    return out


def leftmost(s: np.ndarray, kind, chunk: int = _CHUNK) -> np.ndarray:
    """Positions of S-type suffixes whose predecessor is L-type."""
    parts = []
    for a in range(1, len(s), chunk):
        b = min(a + chunk, len(s))
        parts.append((np.flatnonzero(np.asarray(s[a:b]) & ~np.asarray(s[a - 1 : b - 1])) + a).astype(kind))
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _run(text: np.ndarray, i: int) -> int:
    """Equal symbols from position i on, up to CAP."""
    part = text[i : i + CAP]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else min(CAP, len(part))


def induce(text: np.ndarray, symbols: int, seeds: np.ndarray, common: np.ndarray, store: Store) -> tuple[list[Queue], list[Queue]]:
    """Queues of all L-type suffixes (ascending) and all S-type ones (descending), by first symbol.

    ``seeds`` are the LMS positions in order, ``common[i]`` the common prefix of
    seeds i - 1 and i. The last position of ``text`` holds its one least symbol.
    """
    firsts = text[seeds]
    edges = np.searchsorted(firsts, np.arange(symbols + 1))
    ascending = _Scan(text, symbols, store)
    done = [store.queue() for _ in range(symbols)]
    for c in range(symbols):
        queue, out, last = ascending.queues[c], done[c], None
        while len(queue):
            part = queue.take()
            at, lcp = part["at"].copy(), part["common"].copy()
            out.put(at, lcp)
            ascending.batch(at, lcp, lambda before, c=c: before >= c)
            last = int(at[-1])
        a, b = edges[c], edges[c + 1]
        if a < b:
            lcp = common[a:b].copy()
            lcp[0] = 0 if last is None else min(_run(text, last), _run(text, int(seeds[a])), CAP)
            for k in range(0, b - a, _CHUNK):
                ascending.batch(seeds[a + k : min(b, a + k + _CHUNK)], lcp[k : k + _CHUNK], lambda before, c=c: before > c)
        ascending.carried[:] = 0  # the next symbol shares nothing with this one
    descending = _Scan(text, symbols, store)
    small = [store.queue() for _ in range(symbols)]
    for c in range(symbols - 1, -1, -1):
        queue, out, last = descending.queues[c], small[c], None
        while len(queue):
            part = queue.take()
            at, lcp = part["at"].copy(), part["common"].copy()
            out.put(at, lcp)
            descending.batch(at, lcp, lambda before, c=c: before <= c)
            last = int(at[-1])
        shift = None  # going down, a tuple's value belongs to the one scanned after it
        for part in done[c].backwards():
            at, lcp = part["at"].copy(), part["common"].copy()
            moved = np.empty_like(lcp)
            moved[1:] = lcp[:-1]
            moved[0] = shift if shift is not None else 0 if last is None else min(_run(text, last), _run(text, int(at[0])), CAP)
            shift = lcp[-1]
            descending.batch(at, moved, lambda before, c=c: before < c)
        descending.carried[:] = 0
    return done, small


def _equal_substrings(text: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether text[a : a + size] and text[b : b + size] agree where ``both`` sizes do."""
    same = both.copy()
    left, k = np.flatnonzero(same), 0
    while len(left):
        same[left] = text[a[left] + k] == text[b[left] + k]
        k += 1
        left = left[same[left] & (sizes[left] > k)]
    return same


def doubling(names: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Order of the suffixes of a string of integers, in memory; to ``depth`` symbols at least if given."""
    n = len(names)
    _, rank = np.unique(names, return_inverse=True)
    rank = rank.astype(np.int64)
    order, h = np.argsort(rank, kind="stable"), 1
    sorted_rank = rank[order]
    while h < n and (depth is None or h < depth):
        same = sorted_rank[1:] == sorted_rank[:-1]
        if not same.any():
            break
        # only suffixes that share their rank are sorted again
        open_ = np.zeros(n, bool)
        open_[1:] |= same
        open_[:-1] |= same
        slots = np.flatnonzero(open_)
        part = order[slots]
        second = np.where(part + h < n, rank[np.minimum(part + h, n - 1)] + 1, 0)
        key = rank[part] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        part, key = part[by], key[by]
        order[slots] = part
        # ranks: slot of the first suffix with the same key
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[part] = np.repeat(slots[new], np.diff(np.append(np.flatnonzero(new), len(slots))))
        if h == 1:  # from counts of smaller names to slots
            alone = np.flatnonzero(~open_)
            rank[order[alone]] = alone
        sorted_rank = rank[order]
        h *= 2
    return order


def _common_of_neighbours(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefixes of suffixes that follow each other, up to CAP, by eight bytes at a time."""
    n, width = len(text), text.dtype.itemsize
    step = 8 // width
    raw = np.concatenate((text, np.zeros(step, text.dtype))).view(np.uint8)
    words = np.lib.stride_tricks.as_strided(raw, (n, 8), (width, 1))
    out = np.zeros(len(order), np.uint8)
    for first in range(1, len(order), 1 << 17):
        left, k = np.arange(first, min(first + (1 << 17), len(order))), 0
        sums = np.zeros(len(left), np.int64)
        while len(left) and k < CAP:
            a, b = order[left - 1].astype(np.int64) + k, order[left].astype(np.int64) + k
            inside = np.maximum(a, b) < n
            left, a, b = left[inside], a[inside], b[inside]
            x = words[a].view(np.uint64).ravel() ^ words[b].view(np.uint64).ravel()
            low = x & (~x + np.uint64(1))
            equal = np.where(x == 0, 64, np.bitwise_count(low - np.uint64(1)).astype(np.int64)) // (8 * width)
            equal = np.minimum(equal, n - np.maximum(a, b))
            sums[left - first] += equal
            left = left[equal == step]
            k += step
        out[first : first + len(sums)] = np.minimum(sums, CAP)
    return out


def sort_lms(text: np.ndarray, symbols: int, memory: int, base: int, depth: int | None) -> tuple[np.ndarray, np.ndarray]:
    """LMS positions in the order of their suffixes, and common prefixes of neighbours."""
    store = Store(memory, len(text))
    try:
        lms = leftmost(types(text, store.array(len(text), bool)), _kind(len(text)))
    finally:
        store.close()
    if len(lms) <= 1:
        return lms, np.zeros(len(lms), np.uint8)
    sizes = np.append(np.diff(lms) + 1, 1)
    # a first induction, from LMS positions in any order within a symbol, sorts LMS substrings
    store = Store(memory, len(text))
    try:
        order = np.argsort(text[lms], kind="stable")
        _, small = induce(text, symbols, lms[order], np.zeros(len(lms), np.uint8), store)
        number = store.array(len(text), _kind(len(lms) + 1))  # of LMS positions from 1 on
        number[lms] = np.arange(1, len(lms) + 1)
        found = []
        for queue in small:
            own = [x[x > 0] - number.dtype.type(1) for x in (np.asarray(number[part["at"]]) for part in queue.backwards())]
            found += own
        last = np.array([len(lms) - 1], number.dtype)  # nothing induces the last position
        ranked = np.concatenate([last, *found])
    finally:
        store.close()
    del number, found, small, order
    a, b = lms[ranked[:-1]], lms[ranked[1:]]
    same = _equal_substrings(text, a, b, sizes[ranked[1:]], sizes[ranked[:-1]] == sizes[ranked[1:]])
    names = np.empty(len(lms), _kind(len(lms)))
    names[ranked] = np.cumsum(np.concatenate(([0], ~same)))
    del ranked, a, b, same, sizes
    distinct = int(names.max()) + 1
    if distinct == len(lms):
        by = np.argsort(names)
    elif len(names) <= base:
        by = doubling(names, depth)
    else:
        by, _ = suffix_array(names, distinct, memory, base, depth)
    del names
    lms = lms[by]
    return lms, _common_of_neighbours(text, lms)


def suffix_array(text: np.ndarray, symbols: int, memory: int = 256 << 20, base: int = NAMES, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order and the common prefix with the one before, as arrays (for tests and recursion)."""
    parts = list(sorted_suffixes(text, symbols, memory, base, depth))
    return np.concatenate([p["at"] for p in parts]), np.concatenate([p["common"] for p in parts])


def sorted_suffixes(text: np.ndarray, symbols: int, memory: int = 256 << 20, base: int = NAMES, depth: int | None = None):
    """Chunks of (position, common prefix with the one before) in suffix order.

    ``text`` holds symbols below ``symbols`` and ends with a 0 that is its one
    least suffix; earlier zeros may occur, but not right before it. With ``depth``, suffixes that agree
    in so many symbols may come in any order.
    """
    if len(text) == 1:
        yield np.array([(0, 0)], _tuple(1))
        return
    seeds, common = sort_lms(text, symbols, memory, base, depth)
    store = Store(memory, len(text))
    try:
        big, small = induce(text, symbols, seeds, common, store)
        yield np.array([(len(text) - 1, 0)], store.tuple)
        for c in range(symbols):
            last = None
            if c == 0:
                last = len(text) - 1
            for part in big[c].forwards():
                if len(part):
                    last = int(part["at"][-1])
                    yield part
            # S-type suffixes were scanned downwards: turned round, each takes the value of the one after it
            pending = None
            for part in small[c].backwards():
                if not len(part):
                    continue
                part = part.copy()
                value = np.empty(len(part), np.uint8)
                value[1:] = part["common"][:-1]
                value[0] = pending if pending is not None else 0 if last is None else min(_run(text, last), _run(text, int(part["at"][0])), CAP)
                pending = part["common"][-1]
                part["common"] = value
                yield part
    finally:
        store.close()
