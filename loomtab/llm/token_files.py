"""Token ids of whole texts, packed as wavelet matrices in one compressed file a shard.

Encoding: words repeat, texts don't, so a task has the tokenizer encode each
distinct piece (the matches of the tokenizer's own split pattern, told apart by their bytes) once and
puts a document's ids together from those of its pieces. Cutting into pieces
is done on bytes for texts of ASCII and accented Latin letters; a text with
any other character, a control character or an apostrophe (which may begin a
contraction) goes to the tokenizer whole. What a task remembers is dropped at
``REMEMBERED`` pieces, which changes no result.

Files: ids, with the end id after each document, are put in ascending id order
by a range exchange, and each partition is a shard: one Parquet file that holds
a wavelet matrix (bit-planes, rank directory, zeros of each plane) over all its
tokens, with the documents' ids and token counts. There are as many shards as
``SHARD`` bytes of text ask for; one that outgrows ``BLOCK`` tokens, as many equal
rows would make it, goes on in a further matrix in the same file. Spark's commit
protocol writes the files, so lost tasks leave none behind. ``ids_of`` reads them
back; ``tokens_at`` (access), ``counts_of`` (rank) and ``occurrences_of`` (select)
answer from the packed planes over all shards, by global position.

Rows: null and empty texts have the end id only; null ids come first; rows
that repeat an id stand side by side in order of their texts' length and hash.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from .blocks import Block, blocks
from .bpe import TEXT_BYTES, binary, ragged
from .pieces import PieceIndex
from .tables import bounded_batches, parallelism, passing, table
from .wavelet import WaveletMatrix

VOCABULARY, END = "word_bpe_49k.json", 1
REMEMBERED = 250_000
SHARD = 8 << 20  # bytes of text that a shard is to have
BLOCK = 1 << 22
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
#: First bytes of characters up to U+01FF; anything above is left to the tokenizer.
_LAST_LEAD = 0xC7


@lru_cache(maxsize=1)
def _latin() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower-case code of the characters up to U+01FF."""
    import unicodedata

    kind, lower = np.full(0x200, _OTHER, np.uint8), np.arange(0x200, dtype=np.int64)
    for c in range(0x200):
        low = chr(c).lower()
        lower[c] = ord(low) if len(low) == 1 else c
        group = unicodedata.category(chr(lower[c]))[0]
        kind[c] = _SPACE if chr(c).isspace() else _LETTER if group == "L" else _DIGIT if group == "N" else _OTHER
    return kind, lower


#: Bytes that leave a text to the tokenizer.
_ODD = np.zeros(256, bool)
_ODD[list(b"'\x1c\x1d\x1e\x1f")] = True
_ODD[_LAST_LEAD + 1 :] = True


class WordTokenizer:
    """Ids of many texts at once for a lower-casing BPE whose words end in a marked token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.index, self.flat = PieceIndex(2 * REMEMBERED), np.zeros(0, np.uint32)
        self.starts = self.sizes = np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Appends the ids of new pieces: many in one call, told apart by the tokens that end words."""
        flats, sizes = [], []
        for k in range(0, len(pieces), 2000):
            part = pieces[k : k + 2000]
            ids = self.whole([" ".join(part)])[0]
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part) or (len(ends) and ends[-1] != len(ids)):
                each = self.whole(part)
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            flats.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        flat, size = np.concatenate(flats), np.concatenate(sizes).astype(np.int64)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(size) - size))
        self.flat, self.sizes = np.concatenate((self.flat, flat)), np.concatenate((self.sizes, size))

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and how many each has."""
        data, at = block.data, block.offsets
        if self.index.n > REMEMBERED:
            self.forget()
        kind, lower = _latin()
        odd, kinds, small = _ODD[data], kind[:256].take(data), lower[:256].astype(np.uint8).take(data)
        lead = np.flatnonzero((data >= 0xC2) & (data <= _LAST_LEAD))
        if len(lead):  # two bytes are one character: its kind at both, its lower case in their place
            two = (data[lead].astype(np.int64) & 0x1F) << 6 | (data[lead + 1] & 0x3F)
            odd[lead[(two == 0x85) | (two == 0x130)]] = True
            kinds[lead] = kinds[lead + 1] = kind[two]
            small[lead], small[lead + 1] = 0xC0 | lower[two] >> 6, 0x80 | lower[two] & 0x3F
        docs_odd = np.unique(np.searchsorted(at, np.flatnonzero(odd), side="right") - 1)
        for i in docs_odd:
            kinds[at[i] : at[i + 1]] = _SPACE
        # a piece starts where the kind changes, at each digit, and at each document
        begins = np.ones(len(data) + 1, bool)
        begins[1:-1] = kinds[1:] != kinds[:-1]
        begins[:-1] |= kinds == _DIGIT
        begins[lead + 1] = False
        begins[at] = True
        edges = np.flatnonzero(begins)
        starts, ends = edges[:-1], edges[1:]
        solid = kinds[starts] != _SPACE
        starts, ends = starts[solid], ends[solid]
        numbers, new = self.index.number(small, starts, ends)
        if new:
            self._learn([piece.decode() for piece in new])
        flat, sizes = ragged(self.flat, self.starts[numbers], self.sizes[numbers])
        upto = np.concatenate(([0], np.cumsum(sizes)))
        cut = upto[np.searchsorted(starts, at)]
        counts = np.diff(cut)
        if len(docs_odd):
            raw, parts = data.tobytes(), np.split(flat, cut[1:-1])
            for i, ids in zip(docs_odd, self.whole([raw[at[i] : at[i + 1]].decode() for i in docs_odd]), strict=True):
                parts[i], counts[i] = ids, len(ids)
            flat = np.concatenate(parts)
        return flat, counts


@lru_cache(maxsize=1)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encode(df: DataFrame, path: str, end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_tokens (long) and ids (binary: little-endian unsigned 16- or 32-bit, as the vocabulary needs)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        kind = "<u2" if max(len(tokenizer.last), end or 0) <= 1 << 16 else "<u4"
        for batch in batches:
            for block in blocks(batch.column(1), TEXT_BYTES):
                flat, counts = tokenizer.encode(block)
                if end is not None:
                    cut = np.cumsum(counts)
                    flat, counts = np.insert(flat, cut, end), counts + 1
                edges = np.concatenate(([0], np.cumsum(counts)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), pa.array(counts), binary(flat.astype(kind), edges)], ["id", "n_tokens", "ids"]
                )

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary")


#: Columns of a file; doc_ids are of the documents' own type.
_BLOCK = "shard int, block int, first long, n long, doc_ids array<{}>, doc_tokens array<long>, bits binary, ranks binary, zeros array<long>"
#: Shards whose totals are one group of the prefix sums.
GROUP = 1024
#: Shards whose sums (12 bytes each) are broadcast at most.
SMALL = 100_000


def in_order(df: DataFrame, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text in ascending id order over partitions, each a shard to be.

    The range exchange stands before encoding: it reads its input twice, once
    to find the ranges, and texts are cheaper to read than to encode.
    """
    order = [F.col(id_col), F.octet_length(text_col), F.xxhash64(text_col)]
    rows = df.select(id_col, text_col)
    if shards is None:
        size = rows.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
        shards = max(parallelism(df.sparkSession), -(-size // SHARD))
    return rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)


def write_shards(encoded: DataFrame, directory: str, most: int = BLOCK) -> None:
    """Writes one file a partition of ``encoded``, which ``encode`` makes of rows that are ``in_order``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        cells: list[bytes] = []
        size = 0
        kind_of_ids = pa.int64()

        def packed() -> pa.RecordBatch:
            width = [c for c in cells if c]
            kind = "<u2" if all(len(c) == 2 * t for c, t in zip(cells, tokens, strict=True)) else "<u4"
            m = WaveletMatrix.build(np.frombuffer(b"".join(width), kind))
            row = [shard, block, first, m.n, ids, tokens, m.bits.tobytes(), m.ranks.tobytes(), m.zeros.tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(kind_of_ids), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)],
                [f.split()[0] for f in _BLOCK.split(", ")],
            )

        tokens: list[int] = []
        for batch in batches:
            kind_of_ids = batch.column(0).type
            for i, n, cell in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if cells and size + n > most:
                    yield packed()
                    block, first, size = block + 1, first + size, 0
                    ids, cells, tokens = [], [], []
                ids.append(i), cells.append(cell), tokens.append(n)
                size += n
        if cells:
            yield packed()

    encoded.mapInArrow(task, _BLOCK.format(encoded.schema["id"].dataType.simpleString())).write.option("compression", "zstd").parquet(directory)


def matrix(row: dict) -> WaveletMatrix:
    """The wavelet matrix of one block as it stands in a file."""
    zeros = np.array(row["zeros"], np.int64)
    depth = len(zeros)
    return WaveletMatrix(row["n"], np.frombuffer(row["bits"], np.uint8).reshape(depth, -1), np.frombuffer(row["ranks"], np.uint32).reshape(depth, -1), zeros)


def read_shards(spark: SparkSession, directory: str) -> DataFrame:
    """The blocks of all files, each with ``start``: how many ids stand before it in all shards.

    Prefix sums in two levels: over groups of ``GROUP`` shards, a row each, and over the shards of a group. The sums,
    two numbers a shard, are broadcast for up to ``SMALL`` shards; beyond that the blocks are shuffled to them.
    """
    found = spark.read.parquet(directory)
    group = F.floor(F.col("shard") / GROUP).alias("group")
    totals = found.groupBy("shard", group).agg(F.sum("n").alias("m"))
    earlier = lambda w: F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = totals.groupBy("group").agg(F.sum("m").alias("m")).select("group", earlier(Window.orderBy("group")).alias("before"))
    offsets = totals.withColumn("own", earlier(Window.partitionBy("group").orderBy("shard"))).join(before, "group").select("shard", (F.col("before") + F.col("own")).alias("offset"))
    offsets = F.broadcast(offsets) if totals.count() <= SMALL else offsets
    return found.join(offsets, "shard").withColumn("start", F.col("offset") + F.col("first")).drop("offset")


def _matrices(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[dict, WaveletMatrix]]:
    """The blocks of a partition one at a time: the row without its planes, and the matrix."""
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch.column(name)[i].as_py() for name in names}
            yield row, matrix({name: batch.column(name)[i].as_py() for name in ("n", "bits", "ranks", "zeros")})


def ids_of(blocks_: DataFrame) -> DataFrame:
    """Columns id, start, n_tokens and ids (binary: little-endian unsigned 32-bit) of each document in the files.

    Beside them, from the planes: first_id (access), n_before (occurrences of that id before the document in its
    matrix) and previous (global position of the last of these, null for none).
    """

    kind = blocks_.schema["doc_ids"].dataType.elementType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = to_arrow_type(kind)
        for row, m in _matrices(batches, ["start", "doc_ids", "doc_tokens"]):
            edges = np.concatenate(([0], np.cumsum(row["doc_tokens"])))
            at = edges[:-1]
            some = np.flatnonzero(np.diff(edges) > 0)
            first, before, previous = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            first[some] = m.accesses(at[some])
            before[some] = m.ranks_of(first[some], at[some])
            again = np.flatnonzero(before > 0)
            previous[again] = m.selects(first[again], before[again] - 1) + row["start"]
            none = np.diff(edges) == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], ids), pa.array(row["start"] + at), pa.array(np.diff(edges)), binary(m.decode().astype("<u4"), edges),
                 pa.array(first, mask=none), pa.array(before, mask=none), pa.array(previous, mask=before == 0)],
                ["id", "start", "n_tokens", "ids", "first_id", "n_before", "previous"],
            )

    return blocks_.mapInArrow(task, f"id {kind.simpleString()}, start long, n_tokens long, ids binary, first_id long, n_before long, previous long")


def tokens_at(blocks_: DataFrame, positions: DataFrame) -> DataFrame:
    """Columns position and token of the distinct global ``positions`` (column position) that exist: access.

    Positions and blocks meet by equal stretches of ``BLOCK`` positions, of which a block touches two, or more if one
    long document fills it; a block gets the positions that fall into it as one array.
    """
    stretch = lambda c: F.floor(c / BLOCK)
    ranges = blocks_.where("n > 0").select("start", "n", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("start") + F.col("n") - 1))).alias("stretch"))
    own = positions.where("position is not null").select(F.col("position").cast("long").alias("position")).distinct().withColumn("stretch", stretch(F.col("position")))
    own = own.join(ranges, "stretch").where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n")))
    asked = own.groupBy("start").agg(F.collect_list("position").alias("positions"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, m in _matrices(batches, ["start", "positions"]):
            at = np.array(row["positions"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m.accesses(at - row["start"]))], ["position", "token"])

    return blocks_.where("n > 0").join(asked, "start").mapInArrow(task, "position long, token long")


def counts_of(blocks_: DataFrame, tokens: list[int]) -> DataFrame:
    """Columns token and n: how often each of a few tokens occurs in all shards, from the planes: rank."""
    wanted = sorted(set(tokens))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, m in _matrices(batches, []):
            yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array(m.ranks_of(wanted, np.full(len(wanted), m.n)))], ["token", "n"])

    return blocks_.mapInArrow(task, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences_of(blocks_: DataFrame, tokens: list[int]) -> DataFrame:
    """Columns token and position (global) of all occurrences of a few tokens, from the planes: select."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, m in _matrices(batches, ["start"]):
            for token in sorted(set(tokens)):
                at = m.occurrences(token) + row["start"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), token)), pa.array(at)], ["token", "position"])

    return blocks_.mapInArrow(task, "token long, position long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = passing(spark, "tokens")
    write_shards(encode(in_order(table(spark, sf_dir, "documents")), public_tokenizers.path(VOCABULARY)), directory)
    found = ids_of(read_shards(spark, directory))
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "first_id", "n_before", "previous")


QUERIES = {"op9_token_files": op9_token_files}
ORACLES: dict[str, str] = {}
