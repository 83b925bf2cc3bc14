"""Importance resampling towards a target distribution by external sort-counts of hashed n-grams.

Documents are cut into words once. Each n-gram's bucket, a checksum modulo the
number of buckets, is two bytes of a packed stream; a row of the written table
holds the streams of some whole documents, one after another, with the place at
which each starts. Counts come from the streams alone: every stream is sorted
and run-length encoded, runs of (bucket, count) are merged as they come, a task
gives one run, and equal buckets are summed by Spark. So memory is a stream and
a run, whatever the corpus. The same is done for the target.

A bucket's gain is the scaled logarithm of how much likelier the target is to
hold it (one occurrence more in each bucket, so none is zero). The gains, one
number a bucket and at most 65,536, go to the tasks, which gather them along
the streams and sum them between document starts with ``np.add.reduceat``. A
document's score is its weight plus Gumbel noise from a hash of its id, and the
documents of highest score are a draw without replacement by weight. Places in
the order of scores come from a range exchange and counts a partition.

Rows: null and empty texts, and those without words, have no features, weight 0
and noise only; they are drawn only if they have ``least`` words. Ties go to the
smaller id, null ids first, then whichever row comes first: repeated rows are
documents of their own with equal scores. A null id is hashed as an empty one.
An empty target gives all buckets of no occurrence equal gains; empty
documents give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import bounded_batches, id_key, in_order, table, written

BUCKETS, GRAMS, SCALE, SHARE, LEAST, SEED = 10_000, 1, 1000, 10, 20, 2024
#: Features of a row of the table of streams; one document of more stands alone.
STREAM = 1 << 19
#: Bytes of words in lower case, all others as a space: digits, letters and what isn't ASCII.
_WORD = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _grams(words: list[bytes], grams: int) -> list[bytes]:
    return [*words, *(b" ".join(words[i : i + n]) for n in range(2, grams + 1) for i in range(len(words) - n + 1))]


def _packer(buckets: int, grams: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            first, starts, counts, held, size = 0, [], [], [], 0

            def row(stop: int) -> pa.RecordBatch:
                one = lambda kind, x: pa.array([x], pa.list_(kind))
                own = pa.ListArray.from_arrays(pa.array([0, stop - first], pa.int32()), ids.slice(first, stop - first))
                return pa.RecordBatch.from_arrays([own, one(pa.int64(), starts), one(pa.int64(), counts), pa.array([b"".join(held)], pa.large_binary()).cast(pa.binary())], ["ids", "starts", "words", "stream"])

            for i, text in enumerate(texts):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_WORD).split()
                found = _grams(words, grams) if grams > 1 else words
                if held and size + len(found) > STREAM:
                    yield row(i)
                    first, starts, counts, held, size = i, [], [], [], 0
                starts.append(size)
                counts.append(len(words))
                held.append((np.fromiter(map(crc32, found), np.uint32, len(found)) % np.uint32(buckets)).astype("<u2").tobytes())
                size += len(found)
            if starts:
                yield row(len(ids))

    return pack


def streams(df: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """Columns ids, starts, words (their number), a list entry a document, and stream (packed buckets): rows of whole documents."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket takes two bytes: there can be 1 to 65,536")
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return written(rows.mapInArrow(_packer(buckets, grams), f"ids array<{rows.schema['id'].dataType.simpleString()}>, starts array<long>, words array<long>, stream binary"), "bucket-streams")


def run_lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs, by sorting."""
    values = np.sort(values)
    edges = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))
    return values[edges], np.diff(np.append(edges, len(values)))


def merged_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One run of (bucket, count) from several."""
    at, n = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    edges = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), at[1:] != at[:-1])))
    return at[edges], np.add.reduceat(n, edges) if len(edges) else n


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for stream in batch.column(0):
            held.append(run_lengths(np.frombuffer(stream.as_buffer(), "<u2")))
            size += len(held[-1][0])
            if size > 1 << 20:
                held = [merged_runs(held)]
                size = len(held[0][0])
    if held:
        at, n = merged_runs(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64))], ["bucket", "n"])


def counts(packed: DataFrame) -> DataFrame:
    """Columns bucket and n: how often each bucket occurs in the streams."""
    return packed.select("stream").mapInArrow(_runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Scaled log-likelihood ratios by bucket, from tables that ``counts`` gave: a row a bucket at most is gathered."""
    held = []
    for found in (source, target):
        own = np.zeros(buckets, np.int64)
        for bucket, n in found.collect():
            own[bucket] = n
        held.append(own)
    s, t = held
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(SCALE * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def _weigher(gain: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids, starts, words, stream = (batch.column(c)[k] for c in range(4))
                at = np.frombuffer(stream.as_buffer(), "<u2")
                begins = starts.values.to_numpy()
                n = np.diff(np.append(begins, len(at)))
                weight = np.zeros(len(n), np.int64)
                if len(at):
                    weight[n > 0] = np.add.reduceat(gain[at], begins[n > 0])
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(n), words.values, pa.array(weight)], ["id", "n_features", "n_words", "weight"])

    return weigh


def noise(id_col: str = "id", seed: int = SEED) -> Column:
    """Scaled Gumbel noise, as a whole number, from the first 32 bits of SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
    buckets: int = BUCKETS, grams: int = GRAMS, share: int = SHARE, least: int = LEAST, seed: int = SEED,
) -> DataFrame:
    """Columns id, n_features, n_words, weight, score and rank (from 1, null for documents that aren't drawn), one row a document.

    Drawn are ``share`` per cent (rounded down) of the documents with at least ``least`` words.
    """
    own = streams(df, id_col, text_col, buckets, grams)
    gain = gains(counts(own), counts(streams(target, target_id, target_text, buckets, grams)), buckets)
    kind = own.schema["ids"].dataType.elementType.simpleString()
    weighed = own.mapInArrow(_weigher(gain), f"id {kind}, n_features long, n_words long, weight long")
    scored = weighed.select("*", (F.col("weight") + noise("id", seed)).alias("score"), (F.col("n_words") < least).alias("short"), id_key("id").alias("k"), F.monotonically_increasing_id().alias("nth"))
    scored = written(scored, "scores")
    rows, able = scored.agg(F.count("*"), F.count_if(~F.col("short"))).first()
    placed = in_order(scored, rows, ["short", F.desc("score"), "k", "nth"], "score-order")
    rank = F.when(F.col("row") < share * able // 100, F.col("row") + 1).cast("long")
    return placed.select("id", "n_features", "n_words", "weight", "score", rank.alias("rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


_SQL = """
WITH crc_table AS (
    SELECT list(c ORDER BY i) AS crcs FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS i)
    )
), own AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), goal AS (
    SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), places AS (
    SELECT doc_id, unnest(w) AS word FROM own
), found AS (
    SELECT word, sum(s) AS s, sum(t) AS t FROM (SELECT word, 1 AS s, 0 AS t FROM places UNION ALL SELECT unnest(w), 0, 1 FROM goal) GROUP BY word
), hexed AS (
    SELECT word, s, t, hex(encode(word)) AS x FROM found
), bytes AS (
    SELECT word, s, t, list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT) AS b FROM hexed
), hashed AS (
    SELECT word, s, t, xor(list_reduce(list_prepend(4294967295, b), lambda c, k: xor(c >> 8, crcs[(xor(c, k) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM bytes, crc_table
), totals AS (
    SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM hashed
), gained AS (
    SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * (any_value(all_s) + 10000) / ((sum(s) + 1)::DOUBLE * (any_value(all_t) + 10000))))::BIGINT AS gain
    FROM hashed, totals GROUP BY bucket
), per_word AS (
    SELECT word, gain FROM hashed JOIN gained USING (bucket)
), weighed AS (
    SELECT doc_id, sum(gain)::BIGINT AS weight FROM places JOIN per_word USING (word) GROUP BY doc_id
), scored AS (
    SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM own LEFT JOIN weighed USING (doc_id)
), drawn AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (doc_id)
"""

QUERIES = {"op11_resampling": op11_resampling}
ORACLES: dict[str, str] = {"op11_resampling": _SQL}
