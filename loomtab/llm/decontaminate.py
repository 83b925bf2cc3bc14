"""Benchmark decontamination as a prefix-filtered containment join, on DataFrames alone.

An item's windows are its runs of ``WINDOW`` words (an item of fewer words is
one window). A document contains a window if it contains all its shingles (runs
of ``SHINGLE`` words; of fewer in shorter windows), so for full containment the
necessary prefix of a window, its shingles ordered by rarity, is one shingle:
the rarest. Rarity is how often a shingle of the benchmark occurs in all
documents. Document shingles are joined to prefixes only; the place of the
shingle in the window says where the window would have to start (positional
bound) and end (length bound), and the document's words there are compared with
the window's.

All documents are cut once to find where shingles of the benchmark stand, which
gives both the frequencies and the places of prefixes, and once to count words;
those with candidates are cut once more. Benchmark sides are broadcast where
their rows are at most ``SMALL`` by count; beyond that keys and places are
shuffled by token, never words, and of the joins of plain tables adaptive
execution splits hot shingles.
Windows of equal words are one row however many items have them. Nothing is
emitted for pairs of documents.

Rows: null and empty texts have no words, no hits and no items; items without
words have no windows; items without an id count as hits but are not listed;
repeated rows are one document; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import id_key, keyed, table, written

WINDOW, SHINGLE = 13, 3
SMALL = 200_000
#: What separates words, before and after A-Z are lower-cased.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words (A-Z only; other letters stay as they are)."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), _BETWEEN, -1), "")


def _shingles(column: str, width: int) -> Column:
    """Hash of the run of ``width`` words at each position (of fewer at the end)."""
    return F.transform(column, lambda w, i: F.xxhash64(w, *[F.get(F.col(column), i + j) for j in range(1, width)]))


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def item_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Columns item (string), words (array) and window (the words with spaces), one row a window and item."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (window - 1)))
    cut = items.select("item", "all", F.explode(starts).alias("at")).select("item", F.slice("all", F.col("at"), window).alias("words"))
    return cut.withColumn("window", F.array_join("words", " ")).distinct()


def shingle_places(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Columns k, h, at and token: where the ``wanted`` tokens stand in documents.

    Hashed in a projection of its own: the explosion and the join then compile to one loop. An outer
    explosion has no filter on its array pushed down, which would cut the text anew for each word.
    Beside a token there are only the key and the place, so this can be shuffled by token.
    """
    hashed = docs.select("k", "h", words(F.col("text")).alias("words")).select("k", "h", _shingles("words", width).alias("tokens"))
    return hashed.select("k", "h", F.posexplode_outer("tokens").alias("at", "token")).join(wanted, "token")


def candidates(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Columns k, h and places (array of start, size, window): where prefixes say that windows may stand."""
    distinct = windows.select("words", "window", F.size("words").alias("size")).distinct()
    spark, found = docs.sparkSession, None
    for width in range(1, SHINGLE + 1):  # windows of one or two words have shingles of as many
        own = distinct.where(F.col("size") == width if width < SHINGLE else F.col("size") >= width)
        shingles = own.select("window", "size", F.posexplode(_shingles("words", width)).alias("offset", "token")).where(F.col("offset") <= F.col("size") - width)
        shingles = written(shingles, "item-shingles")
        n = shingles.count()
        if not n:
            continue
        places = written(shingle_places(docs, _sized(shingles.select("token").distinct(), n), width), "shingle-places")
        frequency = places.groupBy("token").agg(F.count("*").alias("n"))
        ranked = shingles.join(F.broadcast(frequency) if n <= SMALL else frequency, "token", "left")
        prefix = ranked.groupBy("window", "size").agg(F.min_by(F.struct("token", "offset"), F.struct(F.coalesce("n", F.lit(0)), "offset")).alias("p"))
        prefix = written(prefix.select("window", "size", "p.token", "p.offset"), "item-prefixes")
        start = F.col("at") - F.col("offset")
        part = places.join(_sized(prefix, prefix.count()), "token").where(start >= 0).select("k", "h", start.alias("start"), "size", "window")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "k long, h long, places array<struct<start: int, size: int, window: string>>")
    return found.groupBy("k", "h").agg(F.collect_set(F.struct("start", "size", "window")).alias("places"))


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Columns k, h, start (from 0), size and window: all places of windows in documents (``docs`` as ``keyed``).

    Only documents with candidates are read again and cut, one row a document with all its candidates.
    """
    near = written(candidates(docs, windows), "window-candidates")
    n_docs, n_places = near.agg(F.count("*"), F.sum(F.size("places"))).first()
    own = docs.select("k", "h", "text")
    if (n_places or 0) > SMALL // 8:  # windows are words: only keys are broadcast, to shuffle no other texts than those with candidates
        own = own.join(_sized(near.select("k", "h"), n_docs), ["k", "h"], "left_semi")
    cut = own.join(_sized(near, 8 * (n_places or 0)), ["k", "h"]).select("k", "h", words(F.col("text")).alias("words"), "places")
    stands = lambda p: (p["start"] + p["size"] <= F.size("words")) & (F.array_join(F.slice("words", p["start"] + 1, p["size"]), " ") == p["window"])
    return written(cut.select("k", "h", F.explode(F.filter("places", stands)).alias("p")).select("k", "h", "p.*").distinct(), "window-places")


def contamination(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """Columns k, h, id, n_words, n_hit (words inside any window), items (sorted item ids) and contaminated, one row a document."""
    docs = keyed(df, id_col, text_col)
    windows = written(item_windows(bench, item_col, bench_text), "item-windows")
    places = hits(docs, windows)
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["size"] - 1)))))
    per = places.groupBy("k", "h").agg(F.collect_set(F.struct("start", "size")).alias("places")).select("k", "h", covered.cast("long").alias("hit"))
    items = places.select("k", "h", "window").distinct().join(windows.where("item is not null").select("window", "item"), "window")
    listed = items.groupBy("k", "h").agg(F.array_sort(F.collect_set("item")).alias("found"))
    counted = docs.select("k", "h", "id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(per, ["k", "h"], "left").join(listed, ["k", "h"], "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return out.select(
        "k", "h", "id", "n_words", n_hit.alias("n_hit"), F.coalesce("found", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")
    )


def keep_clean(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with its columns, that are not contaminated."""
    bad = contamination(df, bench, id_col, text_col).where("contaminated").select("k", "h").distinct()
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), id_key(id_col).alias("k"), F.xxhash64(F.col(text_col)).alias("h"))
    return own.join(bad, ["k", "h"], "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


_SQL = """
WITH item_words AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, list_slice(w, s, s + 12) AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM item_words WHERE len(w) > 0)
), doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
), places AS (
    SELECT doc_id, s, 13 AS m, list_slice(w, s, s + 12) AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM doc_words WHERE len(w) >= 13)
    UNION ALL
    SELECT doc_id, s, m, list_slice(w, s, s + m - 1) AS win
    FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s
          FROM doc_words, (SELECT DISTINCT len(win) AS m FROM windows WHERE len(win) < 13) WHERE len(w) >= m)
), found AS (
    SELECT p.doc_id, p.s, p.m, w.item_id FROM places p JOIN windows w ON p.win = w.win
), hit AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS pos FROM found) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLES: dict[str, str] = {"op6_decontaminate": _SQL}
