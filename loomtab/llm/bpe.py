"""Byte-level BPE over columns: encoding by batched merges in padded matrices, and decoding.

A text is cut into pieces by the tokenizer's pattern. A piece that is a token
is that token; any other starts as its bytes, and its leftmost pair of least
rank is merged until no pair has a rank. Inside a task the distinct pieces
that are new go into matrices by length (rows padded to the bucket's width),
and in each round every row that still has a ranked pair merges one, so all
live rows lose one column together; finished rows leave the matrix. Ranks of
pairs come from an open-addressed hash table. Matrices have at most ``_CELLS``
cells. A row of over ``LONG`` bytes would take as many rounds as it has bytes, each
over all of it; such pieces merge the same pairs in the same order, leftmost of
least rank first, from a heap over a linked list.

What a task remembers of pieces is dropped at ``REMEMBERED`` entries: that
bounds memory and changes no result. The pattern library and the tokenizer's
know different versions of Unicode; letters and digits that are new to the
latter are cut as it cuts them, as neither. Rows: null and empty texts have no ids;
texts are never cut; repeated rows are encoded each; lone surrogates cannot
occur in Spark's strings. Other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks, mix
from .tables import bounded_batches, table

NONE = np.uint32(0xFFFFFFFF)
LONG = 512
REMEMBERED = 200_000
_CELLS = 1 << 20  # of a matrix
_OTHER = "\u00a4"  # neither letter nor digit nor white space, in any Unicode
TEXT_BYTES = 1 << 19  # texts whose new pieces are encoded together


class PairTable:
    """(left id, right id) -> id of the merged token, in an open-addressed table."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        bits = max(10, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + 64, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full((1 << bits) + 64, NONE)
        keys = np.fromiter(pairs, np.uint64, len(pairs))
        ranks_ = np.fromiter(pairs.values(), np.uint32, len(pairs))
        slot = (mix(keys) >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):  # one key for each free slot a round; the others move on by one
            self.probes += 1
            _, first = np.unique(slot[left], return_index=True)
            put = left[first]
            put = put[self.ranks[slot[put]] == NONE]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], ranks_[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] += 1

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it has none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right
        slot = (mix(keys) >> self.shift).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        odd = np.flatnonzero((found != keys) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        for _ in range(self.probes):
            if not len(odd):
                break
            slot[odd] += 1
            found = self.keys[slot[odd]]
            hit = found == keys[odd]
            out[odd[hit]] = self.ranks[slot[odd[hit]]]
            odd = odd[~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


class Bpe:
    """A vocabulary of ranks with its split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = pattern
        self.split, self.places = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.pairs = PairTable(ranks)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.uint32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.known = np.zeros(size, bool)
        self.known[list(ranks.values())] = True
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))

    @cached_property
    def ranked(self) -> dict[int, int]:
        """The table of pairs for one look at a time."""
        filled = self.pairs.ranks != NONE
        return dict(zip(self.pairs.keys[filled].tolist(), self.pairs.ranks[filled].tolist(), strict=True))

    def _long(self, piece: bytes) -> list[int]:
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n, rank_of = len(ids), self.ranked
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [rank_of.get(a << 32 | b, -1) for a, b in zip(ids, ids[1:])] + [-1]  # of the pair that starts at i
        heap = [(r, i) for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            j = after[i]
            ids[i], ids[j], rank[j] = r, None, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for left, right in ((i, k), (before[i], i)):  # the two pairs that the new token is part of
                if left >= 0:
                    found = rank[left] = rank_of.get(ids[left] << 32 | ids[right], -1) if right < n else -1
                    if found >= 0:
                        heapq.heappush(heap, (found, left))
        return [x for x in ids if x is not None]

    def _matrix(self, tokens: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for rows of byte tokens padded with NONE; ids are padded likewise."""
        n, width = tokens.shape
        out, count = np.full((n, width), NONE), widths.copy()
        rows = np.arange(n)
        ranks = np.full((n, max(width - 1, 0)), NONE)
        i, j = np.nonzero(np.arange(width - 1)[None, :] < widths[:, None] - 1) if width > 1 else (rows[:0], rows[:0])
        ranks[i, j] = self.pairs(tokens[i, j], tokens[i, j + 1])
        while tokens.shape[1] > 1 and len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                out[rows[done], : tokens.shape[1]] = tokens[done]
                live = ~done
                rows, tokens, ranks, at, best = rows[live], tokens[live], ranks[live], at[live], best[live]
                if not len(rows):
                    break
            m, w = tokens.shape
            row = np.arange(m)
            tokens[row, at] = best
            keep = np.ones((m, w), bool)
            keep[row, at + 1] = False
            tokens = np.compress(keep.ravel(), tokens.ravel()).reshape(m, w - 1)
            keep = np.ones((m, w - 1), bool)
            keep[row, at] = False
            ranks = np.compress(keep.ravel(), ranks.ravel()).reshape(m, w - 2)
            count[rows] -= 1
            for left in (at - 1, at):  # the two pairs that the new token is part of
                k = np.flatnonzero((left >= 0) & (left + 1 < w - 1))
                a, b = tokens[k, left[k]], tokens[k, left[k] + 1]
                r = self.pairs(a, b)
                r[b == NONE] = NONE
                ranks[k, left[k]] = r
        out[rows, : tokens.shape[1]] = tokens
        return out, count

    def pieces(self, text: str, latin: bool = False) -> list[str]:
        """The pieces of a text. ``latin``: the caller knows that all characters are below U+0400, where nothing is new."""
        if latin or text.isascii() or not too_new().search(text):
            return self.split(text)
        return [text[m.start() : m.end()] for m in self.places(too_new().sub(_OTHER, text))]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        known, pieces = self.ranks, list(pieces)
        result: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            piece = pieces[i] = piece.encode()
            rank = known.get(piece)
            if rank is not None:
                result[i] = (rank,)
            elif len(piece) > LONG:
                result[i] = self._long(piece)
            else:
                n = len(piece)
                buckets.setdefault(n if n <= 24 else (n + 7) & ~7, []).append(i)
        sizes = np.array([len(x) if x else 0 for x in result], np.int64)
        made = []
        for width, members in buckets.items():
            most = max(1, _CELLS // width)
            for k in range(0, len(members), most):
                part = members[k : k + most]
                widths = np.array([len(pieces[i]) for i in part])
                tokens = np.full((len(part), width), NONE)
                tokens[np.arange(width)[None, :] < widths[:, None]] = self.bytes[np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8)]
                ids, count = self._matrix(tokens, widths)
                part = np.array(part)
                sizes[part] = count
                made.append((part, ids, count))
        at = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.zeros(at[-1], np.uint32)
        for i, ids in enumerate(result):
            if ids:
                flat[at[i] : at[i + 1]] = ids
        for part, ids, count in made:
            i, j = np.nonzero(np.arange(ids.shape[1])[None, :] < count[:, None])
            flat[at[part][i] + j] = ids[i, j]
        return flat, sizes

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after another, and how many each has; unknown ids raise."""
        if len(ids) and (ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return ragged(self.flat, self.at[ids], self.at[ids.astype(np.int64) + 1] - self.at[ids])


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start : start + size] of each, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - ends + sizes, sizes)], sizes


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    """The vocabulary of a file of base64 tokens and ranks, once per Python worker."""
    with open(path, "rb") as lines:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


@lru_cache(maxsize=1)
def too_new() -> regex.Pattern:
    """Letters and digits of the pattern library that the tokenizer's library takes for neither.

    It is asked about each that Python's tables have not assigned: only after a letter or digit is ``'s`` a piece.
    """
    ranks = {bytes([b]): b for b in range(256)} | {b"'s": 256}
    asked = tiktoken.Encoding("asked", pat_str=r"'s|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=ranks, special_tokens={})
    named = regex.compile(r"[\p{L}\p{N}]")
    odd = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn" and named.match(chr(c))]
    odd = [c for c in odd if asked.encode_ordinary(f"{chr(c)}'s")[-1] != 256]
    starts = [c for c, before in zip(odd, [-1, *odd]) if c != before + 1]
    ends = [c for c, after in zip(odd, [*odd[1:], -1]) if c != after - 1]
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]" if odd else r"(?!)")


class _Seen(dict):
    """Piece -> its number; new pieces are noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path, pattern)
    seen, flat, starts, sizes = _Seen(), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for block in blocks(texts, TEXT_BYTES):
            part = texts.slice(block.first, len(block)).to_pylist()
            if len(seen) > REMEMBERED:
                seen, flat, starts, sizes = _Seen(), flat[:0], starts[:0], sizes[:0]
            latin = np.ones(len(block), bool)
            latin[np.searchsorted(block.offsets, np.flatnonzero(block.data >= 0xD0), side="right") - 1] = False
            numbers = [np.fromiter(map(seen.__getitem__, bpe.pieces(t, low)), np.int64) if t else starts[:0] for t, low in zip(part, latin.tolist(), strict=True)]
            if seen.new:
                more, counts = bpe.encode_pieces(seen.new)
                seen.new.clear()
                starts = np.concatenate((starts, len(flat) + np.cumsum(counts) - counts))
                flat, sizes = np.concatenate((flat, more)), np.concatenate((sizes, counts))
            every = np.concatenate(numbers)
            out, each = ragged(flat, starts[every], sizes[every])
            edges = np.concatenate(([0], np.cumsum([len(x) for x in numbers])))
            ends = np.concatenate(([0], np.cumsum(each)))[edges]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(block.first, len(block)), pa.array(np.diff(ends)), binary(out.astype("<u4"), ends)], ["id", "n_tokens", "ids"]
            )


def encode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_tokens (long) and ids (binary: little-endian unsigned 32-bit integers).

    ``path`` is a vocabulary file that is at the same place on every executor,
    as installed Python packages are.
    """

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: encode_batches(batches, path, pattern), f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary")


def binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column whose cells are runs of ``values`` between ``edges``."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(
        pa.binary() if data.nbytes < 1 << 31 else pa.large_binary(), len(edges) - 1,
        [None, pa.py_buffer((edges * data.itemsize).astype(np.int32 if data.nbytes < 1 << 31 else np.int64)), pa.py_buffer(data)],
    )


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ``decoded`` (binary), the bytes that ``ids`` stand for, to the columns of ``encode``; null ids: empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            cells = batch.column(batch.schema.get_field_index("ids"))
            for block in blocks(cells):
                ids = np.ascontiguousarray(block.data).view("<u4")
                out, sizes = bpe.decode(ids)
                ends = np.concatenate(([0], np.cumsum(sizes)))[block.offsets // 4]
                own = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([*own.columns, binary(out, ends)], [*own.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(task, f"{fields}, decoded binary")


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op3_bpe": op3_bpe}
ORACLES: dict[str, str] = {}
