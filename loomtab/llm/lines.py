"""Line de-duplication by winnowing over line hashes.

Lines with a word are hashed in order. Of every ``run`` neighbours the line of
least hash (of equal ones the last) is selected: any stretch of that many lines
that repeats has the same line selected in both places, so the selected lines,
about 2 in run + 1, are fingerprints that no repeat can miss. Postings are
those: hash, document and place. A hash that was posted once goes no further.
Places whose hash meets another are matches of one line, which grow to the left
and to the right, by the hashes of their neighbours, to the windows that
selected them; only now, and only there, are neighbours looked at. Matches that
agree in all of their lines are joined with the earliest of them, and matches
that overlap add up to runs of any length. Lines of a run that also starts
earlier (smaller id, or same document and earlier line) are deleted; the first
stays. A line of over ``LONG`` words is a run in itself and is posted as such,
so a repeated passage on one line goes as well.

The earliest place of a window is a pre-aggregated minimum, so a run in a third
of all rows sends one row a task. It is written as a table, and marking later
places joins two plain tables, so that adaptive execution can split the places
of a hot window. Lines are compared by 128 bits of SHA-256. All work is on DataFrames.

Rows: a null text stays null and has no lines; lines without a word belong to
no run and stay; texts of fewer than ``run`` lines lose long lines only;
repeated rows are one document; rows of one id with different texts are ordered
by a hash of the text; null ids come first. A document can lose all its lines;
its row stays. Other columns come back as they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import id_key, keyed, parallelism, table, written

RUN, LONG = 2, 50
#: What a line without a word consists of.
_BLANKS = " \t\n\v\f\r"
_BETWEEN = r"[\x20\x09-\x0D]+"


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def _is_long(line: Column, most: int) -> Column:
    """Whether a line has over ``most`` words; shorter lines than so many words need aren't cut."""
    return (F.length(line) > 2 * most) & (F.size(F.array_remove(F.split(line, _BETWEEN, -1), "")) > most)


def line_hashes(docs: DataFrame, long: int = LONG) -> DataFrame:
    """Columns k, h and lines: of each line with a word its index i, 16 bytes of hash f, and whether it is long; ``docs`` as ``keyed``."""
    hashed = lambda x: F.unhex(F.substring(F.sha2(x, 256), 1, 32))
    worded = F.filter(F.transform(_lines(), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.length(F.btrim(s["x"], F.lit(_BLANKS))) > 0)
    lines = F.transform(worded, lambda s: F.struct(s["i"].alias("i"), hashed(s["x"]).alias("f"), _is_long(s["x"], long).alias("long")))
    return docs.where("text is not null").select("k", "h", lines.alias("lines"))


def _selected(lines: Column, run: int) -> Column:
    """For each window of ``run`` lines its first place q and the place p, from 1, that it selects: the least hash, of equal ones the last."""
    least = lambda q: -F.array_min(F.transform(F.sequence(q, q + run - 1), lambda p: F.struct(F.get(lines, p - 1)["f"].alias("f"), (-p).alias("p"))))["p"]
    every = F.transform(F.sequence(F.lit(1), F.size(lines) - (run - 1)), lambda q: F.struct(least(q).alias("p"), q.alias("q")))
    return F.when(F.size(lines) >= run, every).otherwise(F.array().cast("array<struct<p: int, q: int>>"))


def _posted(hashed: DataFrame, run: int) -> DataFrame:
    alone = F.filter(F.transform("lines", lambda s, i: F.when(s["long"], i + 1)), lambda p: p.isNotNull())
    places = F.array_distinct(F.concat(F.transform(_selected(F.col("lines"), run), lambda w: w["p"]), alone))
    posting = F.transform(places, lambda p: F.struct(p.alias("p"), F.get("lines", p - 1)["f"].alias("f")))
    return hashed.select("k", "h", F.explode(posting).alias("x")).select("k", "h", "x.*")


def postings(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """Columns k, h, p (place among worded lines) and f (hash) of the lines that windows select, and of long ones; ``docs`` as ``keyed``."""
    return _posted(line_hashes(docs, long), run)


def repeated_lines(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """Columns k, h and gone (indexes of lines to delete) of documents that lose lines; ``docs`` as ``keyed``."""
    hashed = written(line_hashes(docs, long), "line-hashes")
    posted = _posted(hashed, run)
    again = written(posted.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"), "line-minima")
    met = posted.join(again, "f").groupBy("k", "h").agg(F.collect_list("p").alias("met"))
    # matches grow from the places that met: a window that selected one reaches so many lines to its left, and the rest to its right
    grown = lambda w: F.struct(w["q"].alias("q"), F.slice("lines", w["q"], run).alias("own"))
    reached = F.transform(F.filter(_selected(F.col("lines"), run), lambda w: F.array_contains("met", w["p"])), grown)
    single = F.transform(F.filter("met", lambda p: F.get("lines", p - 1)["long"]), lambda p: F.struct(p.alias("q"), F.slice("lines", p, 1).alias("own")))
    places = hashed.join(met, ["k", "h"]).select("k", "h", F.explode(F.concat(reached, single)).alias("w"))
    # dealt out, as a table of one file could not be split where a window is hot
    places = written(places.select("k", "h", "w.q", F.col("w.own.i").alias("at"), F.col("w.own.f").alias("around")).repartition(parallelism(docs.sparkSession)), "line-matches")
    first = places.groupBy("around").agg(F.min(F.struct("k", "h", "q")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = places.join(written(first, "line-firsts"), "around").where(F.struct("k", "h", "q") > F.col("first"))
    return later.groupBy("k", "h").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("gone"))


def _rewritten(df: DataFrame, run: int, id_col: str, text_col: str) -> DataFrame:
    """Columns row (all of ``df``), text (without the deleted lines) and gone (their indexes, null for none)."""
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    docs = own.withColumns({"k": id_key("id"), "h": F.xxhash64("text")})
    joined = docs.join(repeated_lines(keyed(df, id_col, text_col), run).hint("shuffle_hash"), ["k", "h"], "left")
    lines = _lines()
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return joined.select("row", text.alias("text"), "gone")


def remove_repeated_lines(df: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``df``, without the deleted lines in the text."""
    return _rewritten(df, run, id_col, text_col).select(*[(F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in df.columns])


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(_lines()).cast("long").alias("n_lines"))
    found = _rewritten(docs, RUN, "doc_id", "text")
    return found.select(
        "row.doc_id", F.greatest(F.coalesce("row.n_lines", F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents WHERE text IS NOT NULL
), worded AS (
    SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
    FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), pairs AS (
    SELECT a.doc_id, a.p, a.i AS i1, b.i AS i2,
           row_number() OVER (PARTITION BY a.line, b.line ORDER BY a.doc_id, a.p) AS nth
    FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.p = a.p + 1
), singles AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS nth
    FROM worded WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) > 50
), gone AS (
    SELECT DISTINCT doc_id, unnest([i1, i2]) AS i FROM pairs WHERE nth > 1
    UNION SELECT doc_id, i FROM singles WHERE nth > 1
), kept AS (
    SELECT l.doc_id, count(g.i) AS n_removed, count(*) AS n_lines,
           coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
    FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

QUERIES = {"op1_lines": op1_lines}
ORACLES: dict[str, str] = {"op1_lines": _SQL}
