"""Source divergence audit: how far the sources of a language are from each other, and which terms set a source apart.

Terms are runs of letters. Arrow tasks count them by (language, source) with
the number of documents that hold each, so a hot source sends what a task has
gathered, not its words. A language keeps the terms of at least ``LEAST_DOCS``
of its documents. Shares are whole numbers (billionths, smoothed), their
divergence a whole number too, so nothing depends on the order of sums.

Pairs of sources are tiled in two dimensions. Sources of a language are dealt
over blocks of about ``BLOCK``, the kept terms over chunks of about ``CHUNK``;
a source's counts in a chunk are one packed vector. Vectors are replicated to
the tiles (row block, column block) that their block meets, once for each block
of the language, and a tile adds up its submatrix over chunk after chunk in
the order they are sorted in: it holds one chunk's vectors at a time. The
vocabulary is cut into bands of ``BAND`` chunks, so that a tile of many terms
is several tasks whose submatrices Spark adds. Terms that no source of a tile
has are no columns: what each would add follows from the shares of absent
terms, so a tile adds differences from that and the rest is a product.

Rows: null text, language and source are empty ones; a source of no terms is
compared by its smoothed shares like any other; a language that keeps no term
has pairs of value 0; a source alone in its language has no pairs; repeated
rows count each time; an empty table gives no rows. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import bounded_batches, table, written

LEAST_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
BLOCK, CHUNK, BAND = 16, 4096, 64
#: Entries of a task's counts that are sent on at once.
HELD = 400_000
#: Bytes of letters in lower case, all others as a space: a-z and what isn't ASCII.
_LETTER = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            at = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*at, pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            terms = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_LETTER).split()
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from sent()
    yield from sent()


def term_counts(df: DataFrame) -> DataFrame:
    """Columns lang, source, term, n (occurrences) and docs (documents that hold it); ``df`` has lang, source and text without nulls."""
    bounded_batches(df.sparkSession)
    parts = df.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, size: Column) -> Column:
    """Smoothed share in billionths, exact: ``size`` is the sum of all counts plus two for each term."""
    return (F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)"), F.greatest(size, F.lit(1)).cast("decimal(19,0)"))).cast("long")


def _gap(p: Column, q: Column) -> Column:
    """What a term of shares p and q adds: below 2**63 before the division."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(n: np.ndarray, size: int) -> np.ndarray:
    """``_share`` of an array: three steps of a thousand stay below 2**63 for sizes up to 9 * 10**15."""
    out, rest = (n + 2) // size, (n + 2) % size
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // size, rest * 1000 % size
    return out + 1


class _Tile:
    """The submatrix of a row block and a column block."""

    def __init__(self) -> None:
        self.heads: tuple[list, list] = ([], [])
        self.place: tuple[dict, dict] = ({}, {})
        self.absent: list[np.ndarray] = []
        self.sums = self.each = None

    def head(self, side: int, source: str, size: int, terms: int, base: bool) -> None:
        self.place[side][source] = len(self.heads[side])
        self.heads[side].append((source, size, terms if base else 0))

    def begin(self) -> None:
        self.absent = [shares(np.zeros(len(h), np.int64), np.array([max(x[1], 1) for x in h], np.int64)) for h in self.heads]
        p, q = self.absent[0][:, None], self.absent[1][None, :]
        self.each = (p - q) ** 2 // (p + q)  # what a term that neither has adds
        self.sums = self.each * np.array([x[2] for x in self.heads[0]], np.int64)[:, None]

    def add(self, vectors: list[tuple[int, str, np.ndarray, np.ndarray]]) -> None:
        """One chunk's vectors."""
        terms = np.unique(np.concatenate([at for _, _, at, _ in vectors]))
        dense = [np.repeat(a[:, None], len(terms), axis=1) for a in self.absent]
        for side, source, at, n in vectors:
            k = self.place[side][source]
            dense[side][k, np.searchsorted(terms, at)] = shares(n, self.heads[side][k][1])
        for k, p in enumerate(dense[0]):
            self.sums[k] += ((dense[1] - p) ** 2 // (dense[1] + p)).sum(axis=1) - self.each[k] * len(terms)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Submatrices of tiles; rows are sorted by tile, then chunk, the sources (chunk -1) first."""
    key, tile, chunk, held = None, _Tile(), -1, []

    def closed() -> None:
        nonlocal held
        if chunk < 0:
            tile.begin()
        elif held:
            tile.add(held)
        held = []

    def done() -> Iterator[pa.RecordBatch]:
        names = [np.array([h[0] for h in side], object) for side in tile.heads]
        rows, columns = np.nonzero(names[0][:, None] != names[1][None, :])
        lang, bi, bj, _ = key
        value = tile.sums[rows, columns]
        a, b = names[0][rows], names[1][columns]
        if bi != bj:  # the other half of the matrix has no tile of its own
            a, b, value = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((value, value))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value)], ["lang", "source", "item", "value"])

    for batch in batches:
        columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
        small = [columns[c].to_pylist() for c in ("lang", "bi", "bj", "band", "chunk", "side", "source", "size", "terms")]
        for i, (lang, bi, bj, band, at, side, source, size, terms) in enumerate(zip(*small, strict=True)):
            if (lang, bi, bj, band) != key:
                if key is not None:
                    closed()
                    yield from done()
                key, tile, chunk = (lang, bi, bj, band), _Tile(), -1
            if at != chunk:
                closed()
                chunk = at
            for s in (0, 1) if bi == bj else (side,):
                if at < 0:
                    tile.head(s, source, size, terms, band == 0)
                else:
                    held.append((s, source, columns["at"][i].values.to_numpy(), columns["n"][i].values.to_numpy()))
    if key is not None:
        closed()
        yield from done()


def divergences(vectors: DataFrame, heads: DataFrame) -> DataFrame:
    """Columns lang, source, item and value: all ordered pairs of sources of a language.

    ``heads`` has lang, source, size, terms, block, blocks and bands, a row a source; ``vectors`` lang, source, chunk, at and n.
    """
    none = [F.lit(None).cast(t).alias(c) for c, t in (("at", "array<int>"), ("n", "array<long>"))]
    every = heads.select("*", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("band")).select("*", F.lit(-1).alias("chunk"), *none)
    packed = vectors.join(heads, ["lang", "source"]).withColumn("band", F.expr(f"cast(chunk div {BAND} as int)"))
    rows = every.unionByName(packed.select(*every.columns)).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(
        "lang", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "band", "chunk", (F.col("block") > F.col("other")).cast("int").alias("side"),
        "source", "size", "terms", "at", "n",
    )
    tile = ["lang", "bi", "bj", "band"]
    parts = rows.repartition(*tile).sortWithinPartitions(*tile, "chunk").mapInArrow(_tiles, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Columns lang, source, part, item, value and rank: part ``pair`` has every other source of the language, ``term`` the ``top`` terms that a source has more of than its language."""
    docs = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    found = written(term_counts(docs), "term-counts")
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_docs)
    kept = written(kept.select("lang", "term", "total"), "terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    chunks = F.ceil(F.col("terms") / chunk).cast("int")
    vocabulary = kept.join(langs, "lang").select("lang", "term", "total", F.pmod(F.xxhash64("term"), chunks).cast("int").alias("chunk"))
    # dealt by chunk, not by the language that the counts were joined by
    vocabulary = vocabulary.repartition("lang", "chunk").withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    counted = written(found.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "total", "chunk", "at"), "kept-counts")
    own = counted.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    sources = written(docs.select("lang", "source").distinct(), "sources")
    several = sources.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    zero = F.lit(0).cast("long")
    heads = sources.join(several, "lang").join(langs, "lang", "left").join(own, ["lang", "source"], "left").fillna(0, ["own", "terms", "lang_n"])
    heads = written(
        heads.select(
            "lang", "source", "terms", (F.col("own") + 2 * F.col("terms")).alias("size"), (F.col("lang_n") + 2 * F.col("terms")).alias("lang_size"), "blocks",
            F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"), F.greatest(F.ceil(F.col("terms") / (chunk * BAND)), F.lit(1)).cast("int").alias("bands"),
        ), "source-heads",
    )
    vectors = counted.groupBy("lang", "source", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("x")).select("lang", "source", "chunk", F.col("x.at").alias("at"), F.col("x.n").alias("n"))
    pairs = divergences(vectors, heads.drop("lang_size"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    p, q = _share(F.col("n"), F.col("size")), _share(F.col("total"), F.col("lang_size"))
    terms = counted.join(heads, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", "item", _gap(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part"))
    ranked = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # limited in each task before rows are shuffled
    out = pairs.select("*", F.lit("pair").alias("part"), F.row_number().over(order).alias("rank")).unionByName(ranked)
    return out.select("lang", "source", "part", "item", F.coalesce("value", zero).alias("value"), F.col("rank").cast("int").alias("rank"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_SQL = """
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
), places AS (
    SELECT d, lang, source, unnest(w) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS total FROM places GROUP BY lang, term HAVING count(DISTINCT d) >= 10
), langs AS (
    SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), counted AS (
    SELECT lang, source, term, count(*) AS n FROM places JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (
    SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counted USING (lang, source) GROUP BY lang, source
), shares AS (
    SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
           (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.n + 2 * l.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (k.total + 2) // (l.n + 2 * l.v))::BIGINT AS q
    FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {"op12_divergence": op12_divergence}
ORACLES: dict[str, str] = {"op12_divergence": _SQL}
