"""Exact substring de-duplication with suffix arrays of shards.

A byte is removed if a string of ``LENGTH`` bytes covers it that also starts
earlier: in a document of smaller id, or earlier in the same document.

Which texts have to be sorted together: every string of LENGTH bytes is
represented by its minimizer, the K-gram of least hash within it. Runs of
strings with the same minimizer are one segment. Equal strings have equal
minimizers, so segments whose minimizer occurs once in the corpus can hold no
repeat, and strings need comparing only with those of the same minimizer.
Fingerprints of all segments are dealt by hash (copies within a task are
settled there, so a passage in a third of all rows sends a few entries a
task), and of equal segments only the earliest goes on. Where segments of one
minimizer differ, their bytes are dealt by minimizer; each partition is a shard
that is sorted by external induced sorting, with its queues on disk beyond
``MEMORY`` bytes, and neighbours that share LENGTH bytes or more are the
repeats. Minimizers with over ``HOT`` different segments are dealt by a longer
context, which equal strings share as well.

Rows: a null text is empty; documents of fewer than LENGTH bytes keep all.
Repeated rows (same id and text) are one document and get one result each;
rows of one id with different texts are ordered by a hash of the text; null
ids come first. Matches never cross documents.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BASE_INV, Block, blocks, mix, powers, prefix_hash, text_arrays, window_hash
from .bpe import binary
from .induced import NAMES, Store, scratch, sorted_suffixes
from .tables import bounded_batches, keyed, parallelism, table, written

LENGTH, K = 100, 24
MEMORY = 24 << 20  # bytes of queues and arrays that a shard's task holds before it uses files
PART, SHARD = 64 << 20, 4 << 20  # bytes of fingerprints, and of segments, that a partition is to have
HOT, STEP = 256, 8
_FLUSH = 400_000  # segments that a task holds before it hands them on
_ENTRY = np.dtype([("fp", "<u8"), ("seg", "<u8"), ("seg2", "<u8"), ("k", "<i8"), ("h", "<i8"), ("start", "<i8"), ("n", "<u4")])
_RESULT = "k long, h long, start long, stop long, fp long"


def segments(block: Block, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """For each segment: its document, minimizer position, first string's start and last string's start (in the block)."""
    data, at = block.data, block.offsets
    sizes = np.diff(at)
    each = np.maximum(sizes - length + 1, 0)
    if not each.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    prefix, n = prefix_hash(data), len(data)
    h = mix((prefix[k:] - prefix[:-k]) * powers(BASE_INV, n + 1)[: n - k + 1])
    # least hash and leftmost place: 32 bits of hash above 32 bits of position
    low = np.uint64(0xFFFFFFFF)
    least, span, window = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, length - k + 1
    while 2 * span <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if window > span:
        least = np.minimum(least[: span - window], least[window - span :])
    owner = np.repeat(np.arange(len(sizes)), each)
    starts = np.arange(len(owner)) + np.repeat(at[:-1] - np.cumsum(each) + each, each)
    place = (least[starts] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], place[first], starts[first], starts[last], h[place[first]]


def _merge(rows: np.ndarray) -> np.ndarray:
    """Entries as (k, h, start, n), sorted, with overlapping or touching ones of a document joined."""
    rows = rows[np.lexsort((rows["start"], rows["h"], rows["k"]))]
    if not len(rows):
        return rows
    stop = rows["start"] + rows["n"]
    doc = np.concatenate(([True], (rows["k"][1:] != rows["k"][:-1]) | (rows["h"][1:] != rows["h"][:-1])))
    group = np.cumsum(doc)
    far = np.maximum.accumulate(stop + group * (1 << 36)) - group * (1 << 36)
    head = np.flatnonzero(doc | np.concatenate(([True], rows["start"][1:] > far[:-1])))
    out = rows[head].copy()
    out["n"] = np.maximum.reduceat(stop, head) - out["start"]
    return out


def _settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal segments the earliest is kept, the others are removed; rows come back by fingerprint."""
    rows = rows[np.lexsort((rows["start"], rows["h"], rows["k"], rows["seg2"], rows["seg"], rows["fp"]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows["fp"][1:] != rows["fp"][:-1]) | (rows["seg"][1:] != rows["seg"][:-1]) | (rows["seg2"][1:] != rows["seg2"][:-1])
    lead = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
    same = ~first & (rows["k"] == lead["k"]) & (rows["h"] == lead["h"]) & (rows["start"] == lead["start"])  # repeated rows
    return rows[first], _merge(rows[~first & ~same])


def _digests(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2 of each stretch, in two columns: bytes are removed on equal digests, so no weaker hash will do."""
    made = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
    return np.frombuffer(made, "<u8").reshape(-1, 2).T


def _fingerprints(parts: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            kept, removed = _settle(np.concatenate(held))
            held.clear()
            bucket = (mix(kept["fp"]) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            names, first = np.unique(bucket[order], return_index=True)
            edges = np.append(first, len(order))
            yield _packed(names, kept[order], edges, False)
            if len(removed):
                cut = np.unique(np.append(np.arange(0, len(removed), 5000), len(removed)))
                dealt = mix(cut[:-1].astype(np.uint64) + (kept["fp"][0] | np.uint64(1)))  # anywhere: they meet nothing there
                yield _packed(dealt % np.uint64(parts), removed, cut, True)

        count = 0
        for batch in batches:
            k, h = (batch.column(i).to_numpy() for i in (0, 1))
            for block in blocks(batch.column(2)):
                owner, _, a, b, fp = segments(block)
                if not len(a):
                    continue
                rows = np.empty(len(a), _ENTRY)
                rows["fp"] = fp
                rows["seg"], rows["seg2"] = _digests(block.data.tobytes(), a, b + LENGTH)
                rows["k"], rows["h"] = k[block.first + owner], h[block.first + owner]
                rows["start"], rows["n"] = a - block.offsets[owner], b + LENGTH - a
                held.append(rows)
                count += len(rows)
                if count >= _FLUSH:
                    yield from flush()
                    count = 0
        if held:
            yield from flush()

    return task


def _packed(names: np.ndarray, rows: np.ndarray, edges: np.ndarray, settled: bool) -> pa.RecordBatch:
    cells = binary(rows.view(np.uint8).ravel(), edges * _ENTRY.itemsize)
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(np.full(len(names), settled)), cells], ["bucket", "settled", "cells"])


def _rows(rows: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(x)) for x in (rows["k"], rows["h"], rows["start"], rows["start"] + rows["n"], fp)], [f.split()[0] for f in _RESULT.split(", ")]
    )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition's fingerprints: what is removed (fp 0), and segments to compare (fp, least bit set if hot)."""
    held: list[np.ndarray] = []
    for batch in batches:
        for settled, cell in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            rows = np.frombuffer(cell.as_buffer(), _ENTRY)
            if settled:
                yield _rows(rows, np.zeros(len(rows), np.int64))
            else:
                held.append(rows)
    if not held:
        return
    kept, removed = _settle(np.concatenate(held))
    held.clear()
    yield _rows(removed, np.zeros(len(removed), np.int64))
    edge = np.flatnonzero(np.concatenate(([True], kept["fp"][1:] != kept["fp"][:-1], [True])))
    size = np.repeat(np.diff(edge), np.diff(edge))
    rows, size = kept[size > 1], size[size > 1]
    mark = (rows["fp"] | np.uint64(3)) ^ np.where(size > HOT, np.uint64(0), np.uint64(1))
    yield _rows(rows, mark.view(np.int64))


_CUT = "key long, k long, h long, start long, bytes binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the segments to compare, with the key that deals them out."""
    out: list[tuple[int, int, int, int, bytes]] = []

    def packed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        keys = np.array(columns[0], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4], pa.binary())], [f.split()[0] for f in _CUT.split(", ")])

    for batch in batches:
        for k, h, text, found in zip(*(batch.column(i) for i in range(4)), strict=True):
            raw = text.as_buffer()
            k, h = k.as_py(), h.as_py()
            for s in found.as_py():
                fp, a, b = s["fp"] & ((1 << 64) - 1), s["start"], s["stop"]
                if fp & 1:
                    out += [(key, k, h, x, part) for key, x, part in _by_context(raw, fp, a, b)]
                else:
                    out.append((fp, k, h, a, raw[a:b].to_pybytes()))
            if len(out) > 5000:
                yield packed()
    if out:
        yield packed()


def _by_context(raw: pa.Buffer, fp: int, a: int, b: int) -> list[tuple[int, int, bytes]]:
    """A segment cut by how far its strings start before the minimizer, ``STEP`` distances to a piece.

    All strings of a piece hold the same LENGTH - STEP + 1 bytes, whose hash is the piece's key.
    """
    part = np.frombuffer(raw[a:b].to_pybytes(), np.uint8)
    prefix, last, out = prefix_hash(part), len(part) - LENGTH, []
    # the leftmost K-gram of this hash is the minimizer: an earlier one would have been chosen
    h = mix((prefix[K:] - prefix[:-K]) * powers(BASE_INV, len(prefix))[: len(part) - K + 1])
    m = int(np.argmax((h | np.uint64(3)) == np.uint64(fp | 3)))
    for near in range((m - last) // STEP * STEP, m + 1, STEP):  # distances near .. near + STEP - 1
        first_at, last_at = max(m - near - STEP + 1, 0), min(m - near, last)
        if first_at <= last_at:
            shared = np.array([m - near]), np.array([m - near - STEP + 1 + LENGTH])
            key = int(mix(window_hash(prefix, *shared) ^ np.uint64(fp))[0])
            out.append((key, a + first_at, part[first_at : last_at + LENGTH].tobytes()))
    return out


def later_starts(data: np.ndarray, ends: np.ndarray, rank: np.ndarray, length: int = LENGTH, memory: int = MEMORY, base: int = NAMES) -> Iterator[np.ndarray]:
    """Positions in ``data``, in order and a chunk at a time, of strings of ``length`` bytes that occur earlier too.

    ``data`` holds texts one after another, as bytes plus one, each ended by a 0 at
    ``ends``. Earlier: in a text of smaller ``rank``, or earlier in the same text; texts
    of equal rank are copies. What grows with ``data`` is in files beyond ``memory``.
    """
    begins = np.concatenate(([0], ends[:-1] + 1))
    shift = int(np.diff(ends, prepend=-1).max()).bit_length()
    store = Store(memory, len(data))
    try:
        later = store.array(len(data), bool)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []  # of the group that is open between chunks

        def close() -> None:
            if sum(len(at) for at, _ in waiting) > 1:
                at, value = (np.concatenate(x) for x in zip(*waiting, strict=True))
                later[at[value != value.min()]] = True
            waiting.clear()

        for part in sorted_suffixes(data, 256, memory, base, depth=length):
            at = part["at"].astype(np.int64)
            doc = np.searchsorted(ends, at)
            value = rank[doc] << shift | at - begins[doc]
            head = np.flatnonzero(part["common"] < length)
            if len(head) == 0:
                waiting.append((at, value))
                continue
            if head[0]:
                waiting.append((at[: head[0]], value[: head[0]]))
            close()
            if len(head) > 1:  # lone strings, the bulk, drop out; groups of two or more stay whole
                inner = slice(head[0], head[-1])
                size = np.diff(head)
                mine = np.repeat(np.minimum.reduceat(value[: head[-1]], head[:-1]), size)
                later[at[inner][(value[inner] != mine) & np.repeat(size > 1, size)]] = True
            waiting.append((at[head[-1] :], value[head[-1] :]))
        close()
        for a in range(0, len(data), 1 << 20):
            at = np.flatnonzero(later[a : a + (1 << 20)]) + a
            # what agrees across the end of a text is no string of it
            yield at[at + length <= ends[np.searchsorted(ends, at)]]
    finally:
        store.close()


class _Shard:
    """Texts of one partition as they come, one after another; in a file beyond the bound."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file, self.sizes, self.size = memory, [], None, [], 0

    def add(self, column: pa.Array) -> None:
        data, at = text_arrays(column)
        sizes = np.diff(at)
        out = np.zeros(len(data) + len(sizes), np.uint8)
        # UTF-8 has no byte 255, so bytes go up by one and 0 is free to end texts
        out[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data + np.uint8(1)
        self.sizes.append(sizes)
        self.size += len(out)
        self.held.append(out)
        if self.file is None and self.size > self.memory // 8:
            self.file = tempfile.TemporaryFile(prefix="shard-", dir=scratch())
        if self.file is not None:
            for part in self.held:
                part.tofile(self.file)
            self.held.clear()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """All bytes and where texts end."""
        ends = np.cumsum(np.concatenate(self.sizes) + 1) - 1
        if self.file is None:
            return np.concatenate(self.held), ends
        self.file.flush()
        return np.memmap(self.file, np.uint8, "r", shape=(self.size,)), ends


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition is a shard: strings of its segments that occur earlier, as stretches of bytes."""
    keys, shard = [], _Shard(MEMORY)
    for batch in batches:
        if len(batch):
            keys.append(np.stack([batch.column(i).to_numpy() for i in (1, 2, 3)]))
            shard.add(batch.column(4))
    if not keys:
        return
    k, h, start = np.concatenate(keys, axis=1)
    _, rank = np.unique(np.rec.fromarrays((k, h, start)), return_inverse=True)  # of repeated rows all have one rank
    data, ends = shard.done()
    for at in later_starts(data, ends, rank):
        if not len(at):
            continue
        doc = np.searchsorted(ends, at)
        run = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]))))
        last, doc = at[np.append(run[1:], len(at)) - 1], doc[run]
        rows = np.zeros(len(run), _ENTRY)
        rows["k"], rows["h"] = k[doc], h[doc]
        rows["start"], rows["n"] = start[doc] + at[run] - (ends[doc] - np.concatenate(shard.sizes)[doc]), last - at[run] + LENGTH
        rows = _merge(rows)
        yield _rows(rows, np.zeros(len(rows), np.int64))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their removed stretches."""
    for batch in batches:
        for block in blocks(batch.column(1)):
            own = batch.slice(block.first, len(block))
            spans = own.column(2)
            flat, at = spans.flatten(), np.concatenate(([0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy())))
            rows = np.zeros(len(flat), _ENTRY)
            if len(flat):
                rows["k"] = np.repeat(np.arange(len(block)), np.diff(at))
                begin = flat.field(0).to_numpy()
                rows["start"], rows["n"] = begin, flat.field(1).to_numpy() - begin
            rows = _merge(rows)
            size = np.diff(block.offsets)
            step = np.zeros(len(block.data) + 1, np.int32)
            a = block.offsets[rows["k"]] + rows["start"]
            np.add.at(step, a, 1)
            np.add.at(step, a + rows["n"], -1)
            keep = np.cumsum(step[:-1]) == 0
            left = np.concatenate(([0], np.cumsum(keep)))[block.offsets]
            count = np.bincount(rows["k"], minlength=len(block))
            cells = pa.array(np.stack([rows["start"], rows["start"] + rows["n"]], axis=1).astype(np.int64).ravel())
            pairs = pa.StructArray.from_arrays([cells.take(pa.array(np.arange(0, 2 * len(rows), 2))), cells.take(pa.array(np.arange(1, 2 * len(rows), 2)))], ["start", "stop"])
            yield pa.RecordBatch.from_arrays(
                [own.column(0), pa.array(size), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pairs), binary(np.compress(keep, block.data), left)],
                ["id", "n_bytes", "spans", "kept"],
            )


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_bytes, spans (removed runs of bytes: array of start, stop) and kept (binary: the bytes left)."""
    bounded_batches(df.sparkSession)
    docs = keyed(df, id_col, text_col).withColumn("text", F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(4 * parallelism(df.sparkSession), size // PART)  # entries are about as many bytes as the texts
    prints = docs.select("k", "h", "text").mapInArrow(_fingerprints(parts), "bucket int, settled boolean, cells binary")
    found = written(prints.repartition(parts, "bucket").mapInArrow(_repeated, _RESULT), "repeats")
    wanted = found.where("fp <> 0").groupBy("k", "h").agg(F.collect_list(F.struct("start", "stop", "fp")).alias("found")).hint("shuffle_hash")
    once = docs.select("k", "h", "text")
    cut = once.join(wanted, ["k", "h"]).mapInArrow(_cut, _CUT)
    size = found.where("fp <> 0").agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0
    compared = cut.repartition(max(parallelism(df.sparkSession), size // SHARD), "key").mapInArrow(_compared, _RESULT)
    removed = found.where("fp = 0").unionByName(written(compared, "compared"))
    spans = removed.groupBy("k", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).hint("shuffle_hash")
    rows = docs.join(spans, ["k", "h"], "left").select("id", "text", "spans")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_kept, f"id {kind}, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op2_substrings": op2_substrings}
ORACLES: dict[str, str] = {}
