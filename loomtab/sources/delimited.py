"""Delimited files of any size, many tasks a file: records are found by the state in which each piece of a file begins.

A line break ends a record unless it stands in quotes, and whether it does
depends on everything before it. Spark's text reader deals a file's lines out
by blocks. A first pass reduces each block to a summary: for either state in
which it may begin (between records, or in quotes) the state in which it ends
and the records that begin in it. Summaries, one row a block, are composed in
the order of a file, which gives each block its state and the number of its
first record. A second pass cuts the records; of a record that goes on in other
blocks each block sends its piece, and pieces are joined by record number.
Lines are never shuffled or held together.

Quotes mean what they mean to Python's ``csv``: they open a field at its start
only, two of them are one, and text after a closing quote belongs to the field.
Records of blanks alone are skipped. Encodings are tried by file: UTF-8 (with
or without a mark), then GBK, then Latin-1; line breaks and quotes are the same
bytes in all three. A file that ends in quotes has no records but ``open``.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import extension
from ..operators.ordered import written

#: Separators by extension, others have commas.
SEPARATORS = {".csv": ",", ".tsv": "\t"}
#: Blocks whose states (some 30 bytes each) are broadcast at most.
SMALL = 100_000
_BLANK = b" \t\r\f\v"


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Columns file, block (where the block begins), at (order within it) and line (bytes): the lines of files, as blocks deal them out."""
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))


def separator_of(file: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SEPARATORS.items() for x in pair])
    return F.coalesce(F.element_at(known, extension(file)), F.lit(","))


def ends_quoted(line: bytes, separator: bytes, quoted: bool) -> bool:
    """Whether a line that begins in quotes, or at the start of a record, ends in quotes."""
    parts = line.split(b'"')
    closed = False  # right after a closing quote
    fresh = not quoted  # at the start of a field
    for part in parts[:-1]:
        if quoted:
            quoted, closed = False, True
        elif closed and not part:
            quoted, closed = True, False  # two quotes are one
        else:
            closed = False
            quoted = not part and fresh or part.endswith((separator, b"\r"))
        fresh = False
    return quoted


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], str, list[bytes]]]:
    """Stretches of a batch that lie in one block: (file, block), separator, lines."""
    files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_pylist()
    names, codes, separators = files.dictionary.to_pylist(), files.indices.to_pylist(), batch.column(2)
    held = batch.column(3).to_pylist()
    at = 0
    for i in range(1, len(codes) + 1):
        if i == len(codes) or codes[i] != codes[at] or blocks[i] != blocks[at]:
            yield (names[codes[at]], blocks[at]), separators[at].as_py(), held[at:i]
            at = i


def _blank(line: bytes, separator: bytes) -> bool:
    return not line.strip(_BLANK.replace(separator, b""))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "block", "end_0", "end_1", "n_0", "n_1", "utf8", "gbk"]
    key, row = None, None

    def encoded(line: bytes, name: str) -> bool:
        try:
            line.decode(name)
        except UnicodeDecodeError:
            return False
        return True

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, *row["end"], *row["n"], row["utf8"], row["gbk"])], names)

    for batch in batches:
        for own, separator, held in _runs(batch):
            if own != key:
                if key is not None:
                    yield out()
                key, row = own, {"end": [False, True], "n": [0, 0], "utf8": True, "gbk": True}
            sep = separator.encode()
            for line in held:
                plain = line.isascii()
                row["utf8"] = row["utf8"] and (plain or encoded(line, "utf-8"))
                row["gbk"] = row["gbk"] and (plain or encoded(line, "gbk"))
                for state in (0, 1):
                    if not row["end"][state] and not _blank(line, sep):
                        row["n"][state] += 1
                if b'"' in line:
                    row["end"] = [ends_quoted(line, sep, x) for x in row["end"]]
    if key is not None:
        yield out()


def blocks(read: DataFrame) -> DataFrame:
    """Columns file, block, quoted (whether it begins in quotes), first (number of the first record that begins in it), records, encoding and open, a row a block."""
    own = F.col("separator") if "separator" in read.columns else separator_of(F.col("file"))
    rows = read.select("file", "block", own.alias("separator"), "line")
    found = written(rows.mapInArrow(_summaries, "file string, block long, end_0 boolean, end_1 boolean, n_0 long, n_1 long, utf8 boolean, gbk boolean"), "block-summaries")
    # a file's blocks, some 30 bytes each, are folded in order
    one = F.struct("block", "end_0", "end_1", "n_0", "n_1")
    per = found.groupBy("file").agg(F.array_sort(F.collect_list(one)).alias("b"), F.bool_and("utf8").alias("utf8"), F.bool_and("gbk").alias("gbk"))
    zero = F.struct(F.lit(False).alias("quoted"), F.lit(0).cast("long").alias("first"), F.array().cast("array<struct<block: bigint, quoted: boolean, first: bigint>>").alias("done"))

    def step(acc: Column, b: Column) -> Column:
        return F.struct(
            F.when(acc["quoted"], b["end_1"]).otherwise(b["end_0"]).alias("quoted"), (acc["first"] + F.when(acc["quoted"], b["n_1"]).otherwise(b["n_0"])).alias("first"),
            F.concat(acc["done"], F.array(F.struct(b["block"].alias("block"), acc["quoted"].alias("quoted"), acc["first"].alias("first")))).alias("done"),
        )

    folded = per.select("file", F.when(F.col("utf8"), "utf-8-sig").when(F.col("gbk"), "gbk").otherwise("latin-1").alias("encoding"), F.aggregate("b", zero, step).alias("x"))
    return folded.select("file", "encoding", F.col("x.quoted").alias("open"), F.col("x.first").alias("records"), F.explode("x.done").alias("d")).select("file", "d.*", "records", "encoding", "open")


def cells_of(record: bytes, separator: str, encoding: str) -> list[list[str]]:
    """The records of a text, as ``csv`` reads them: one, or several where a lone carriage return ends some."""
    return [x for x in csv.reader(io.StringIO(record.decode(encoding), newline=""), delimiter=separator) if x]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records as cells, and pieces (no cells) of records that other blocks share."""
    for own, info, held in _stretches(batches):
        separator, encoding, quoted, number = info
        sep = separator.encode()
        out, piece, shared = [], [], bool(quoted)
        number -= bool(quoted)  # the record that is under way began in an earlier block

        for line in held():
            begins = not quoted
            if begins and _blank(line, sep):
                continue
            piece.append(line)
            quoted = ends_quoted(line, sep, quoted) if b'"' in line else quoted
            if not quoted:
                text = b"\n".join(piece)
                out.append((number, text if shared else None, [] if shared else cells_of(text, separator, encoding)))
                number, piece, shared = number + 1, [], False
            if len(out) >= 1000:
                yield _records(own, out)
                out = []
        if piece or quoted and shared:
            out.append((number, b"\n".join(piece), []))
        if out:
            yield _records(own, out)


def _records(own: tuple[str, int], found: list) -> pa.RecordBatch:
    flat = [(n, i, text, cells) for n, text, several in found for i, cells in enumerate(several or [None])]
    return pa.RecordBatch.from_arrays(
        [pa.array([own[0]] * len(flat)), pa.array([own[1]] * len(flat)), pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int32()),
         pa.array([x[2] for x in flat], pa.binary()), pa.array([x[3] for x in flat], pa.list_(pa.string()))],
        ["file", "block", "record", "part", "piece", "cells"],
    )


def _stretches(batches: Iterator[pa.RecordBatch]):
    """Blocks one after another: (file, block), (separator, encoding, quoted, first) and an iterator of its lines, over batches."""
    pending: list = []

    def more() -> bool:
        batch = next(batches, None)
        if batch is None:
            return False
        plain = batch.select(["file", "block", "separator", "line"])
        at = 0
        for own, separator, held in _runs(plain):
            info = (separator, batch.column(4)[at].as_py(), batch.column(5)[at].as_py(), batch.column(6)[at].as_py())
            pending.append((own, info, held))
            at += len(held)
        return True

    while pending or more():
        if not pending:
            continue
        own, info, _ = pending[0]

        def held(own=own) -> Iterator[bytes]:
            while (pending or more()) and (not pending or pending[0][0] == own):
                if pending:
                    yield from pending.pop(0)[2]

        yield own, info, held


class OpenQuotes(ValueError):
    """A file ends in quotes."""


def records(spark: SparkSession, paths: str | list[str], separator: str | None = None, encoding: str | None = None, strict: bool = False) -> DataFrame:
    """Columns file, record (from 0), part (0, but where lone carriage returns end records) and cells of all records of delimited files.

    ``separator`` and ``encoding`` are found by file unless given. Files that end in quotes are left out, or with ``strict`` an error.
    """
    read = lines(spark, paths)
    if separator:
        read = read.withColumn("separator", F.lit(separator))
    every = written(blocks(read), "block-states")
    if strict and not every.where("open").isEmpty():
        raise OpenQuotes("a file ends in quotes")
    state = every.where("not open")
    if encoding:
        state = state.withColumn("encoding", F.lit(encoding))
    small = F.broadcast(state) if state.count() <= SMALL else state
    rows = read.join(small, ["file", "block"])
    if small is state:  # a shuffled join loses the order that the reader gives
        rows = rows.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    own = F.lit(separator) if separator else separator_of(F.col("file"))
    rows = rows.select("file", "block", own.alias("separator"), "line", "encoding", "quoted", "first")
    cut = written(rows.mapInArrow(_cut, "file string, block long, record long, part int, piece binary, cells array<string>"), "records")
    shared = cut.where("piece is not null").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("p"))
    text = F.aggregate(F.slice("p", 2, 1 << 30), F.get("p", F.lit(0))["piece"], lambda a, x: F.concat(a, F.lit(b"\n"), x["piece"]))
    joined = shared.select("file", "record", text.alias("text")).join(state.select("file", "encoding").distinct(), "file").select("file", "record", own.alias("separator"), "encoding", "text")
    whole = joined.mapInArrow(_joined, "file string, record long, part int, cells array<string>")
    return cut.where("piece is null").select("file", "record", "part", "cells").unionByName(whole)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(f, n, i, c) for f, n, s, e, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, c in enumerate(cells_of(t, s, e))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())))], ["file", "record", "part", "cells"])


def shapes(found: DataFrame) -> DataFrame:
    """Columns file, rows, width (cells of the first record) and ragged (whether a record has more), a row a file."""
    first = F.min_by(F.size("cells"), F.struct("record", "part"))
    return found.groupBy("file").agg(F.count("*").alias("rows"), first.alias("width"), (F.max(F.size("cells")) > first).alias("ragged"))
