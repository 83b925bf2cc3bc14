"""Queries over files, streams and byte chunks that are written from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commits as K
from ..operators import events as E
from ..operators import intervals as V
from ..operators import mutations as M
from ..operators import stats as D
from ..operators import uploads as U
from ..operators.ordered import new_folder, written
from ..sources import delimited, workspace
from ..streaming import events as S
from ..streaming import windows as W
from .common import table
from .requests import ORACLES as REQUESTS


def delimited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as delimited files, one a task and separator, with quotes and line breaks in the texts, and read again by blocks."""
    folder = new_folder(spark, "delimited")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    for name, sep in (("a.csv", ","), ("b.tsv", "\t")):
        own = docs.where(F.col("doc_id") % 2 == (0 if sep == "," else 1))
        own.write.options(sep=sep, quoteAll="true", escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").mode("overwrite").csv(f"{folder}/{name}")
    found = delimited.records(spark, f"{folder}/a.csv", ",").unionByName(delimited.records(spark, f"{folder}/b.tsv", "\t"))
    cell = lambda i: F.get("cells", F.lit(i))
    return found.select(
        cell(0).cast("long").alias("doc_id"), cell(1).alias("lang"), cell(2).alias("source"), cell(3).cast("long").alias("n_chars"), F.size("cells").alias("n_cells"),
        F.sha2(F.coalesce(cell(4), F.lit("")), 256).alias("text_sha256"),
    )


def workspace_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace of one folder a source and language, written from the documents and listed again: files by folder, hidden names included."""
    folder = new_folder(spark, "workspace")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit(".s"), F.coalesce("source", F.lit(""))).alias("top"), F.concat(F.lit("_"), F.coalesce("lang", F.lit(""))).alias("sub"), "doc_id")
    docs.repartition("top", "sub").write.mode("overwrite").partitionBy("top", "sub").parquet(folder)
    files = workspace.scan(spark, folder, dotfiles=True).where("relative_path like '%.parquet'")
    parts = F.split("relative_path", "/")
    return files.select(F.substring_index(F.get(parts, F.lit(0)), "=", -1).alias("top"), F.substring_index(F.get(parts, F.lit(1)), "=", -1).alias("sub"), "depth").distinct()


_PAYLOAD = """'{{"type":"' || event_type || '","id":' || event_id || ',"é":"漢字"}}'"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each user's events as bytes, cut in two at a place that moves, within characters too."""
    e = table(spark, sf_dir, "events")
    payload = F.concat(F.lit('{"type":"'), "event_type", F.lit('","id":'), F.col("event_id").cast("string"), F.lit(',"é":"漢字"}'))
    frame = F.encode(F.concat(F.lit("data: "), payload, F.lit("\n\n")), "UTF-8")
    e = e.select(F.col("user_id").cast("long").alias("stream"), "event_id", frame.alias("f")).withColumn("at", (F.col("event_id") % F.octet_length("f")).cast("int"))
    halves = F.array(F.struct(F.lit(0).alias("i"), F.substring("f", F.lit(1), F.col("at")).alias("data")), F.struct(F.lit(1).alias("i"), F.substring("f", F.col("at") + 1, F.octet_length("f")).alias("data")))
    return e.select("stream", "event_id", F.explode(halves).alias("h")).select("stream", (2 * F.col("event_id") + F.col("h.i")).cast("long").alias("seq"), "h.data")


def chunked_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sse_chunks(_chunks(spark, sf_dir))


def chunked_sse_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks through a stream, to completion."""
    root = new_folder(spark, "sse")
    _chunks(spark, sf_dir).write.parquet(f"{root}/in")
    chunks = spark.readStream.schema("stream long, seq long, data binary").parquet(f"{root}/in")
    return _to_completion(S.sse_stream(chunks), root)


def _to_completion(stream: DataFrame, root: str) -> DataFrame:
    """Everything that a stream gives for what is there now, as a table below ``root``."""
    started = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start(f"{root}/out")
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def live_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers who have seen a third of their session's log are sent, through a stream of the log."""
    root = new_folder(spark, "tail")
    log = table(spark, sf_dir, "events").selectExpr("user_id AS session_id", "event_id AS version", "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'error' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'streaming_ended' ELSE 'stage_result' END AS type")
    log.selectExpr("cast(session_id AS long) AS session_id", "cast(version AS long) AS version", "type").write.parquet(f"{root}/in")
    seen = log.groupBy("session_id").agg(F.expr("min(version) + (max(version) - min(version)) div 3").alias("seen"))
    stream = spark.readStream.schema("session_id long, version long, type string").parquet(f"{root}/in")
    return _to_completion(S.live_tail(stream, seen), root)


def upload_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders whose uploads a clock removes: all manifests come in, then nothing but a tick."""
    root = new_folder(spark, "expiry")
    said, k = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_id") % 6
    manifest = F.when(k == 1, F.concat(F.lit('{"created_at": "'), said)).when(k == 2, F.lit('{"size": 3}')).when(k > 2, F.concat(F.lit('{"created_at": "'), said, F.lit('", "size": 3}')))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("upload_id"), manifest.alias("manifest"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    rows.write.parquet(f"{root}/in")
    stream = S.expiring(spark.readStream.schema("upload_id long, manifest string, at timestamp").parquet(f"{root}/in"))
    _to_completion(stream, root)
    tick = "2024-01-03 00:00:00"
    spark.range(1).select(F.lit(None).cast("long").alias("upload_id"), F.lit(None).cast("string").alias("manifest"), F.lit(tick).cast("timestamp").alias("at")).write.mode("append").parquet(f"{root}/in")
    return _to_completion(stream, root)


def merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as uploads of several parts, joined into files; the checksums of what lies there, read again."""
    folder = new_folder(spark, "merged")
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("upload_id"), F.col("turn").alias("part"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    made = U.merged(c, "upload_id", "part", "content", folder)
    there = workspace.contents(spark, folder).select("relative_path", F.sha2("content", 256).alias("there"), F.col("size_bytes").alias("n_there"))
    own = made.withColumn("relative_path", F.element_at(F.split("path", "/"), -1)).join(there, "relative_path", "left")
    return own.select("upload_id", "n_bytes", "sha256", (F.col("there").eqNullSafe(F.col("sha256")) & F.col("n_there").eqNullSafe(F.col("n_bytes"))).alias("same"))


def committed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog table that is made, updated and pruned in three versions; the rows of each."""
    path = new_folder(spark, "catalog")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("title"))
    K.create(o.where("id % 3 <> 0"), path)
    K.write(spark, path, lambda now: M.upsert(now, o.where("id % 2 = 0").withColumn("title", F.lit("new")), "id", "id"))
    K.write(spark, path, lambda now: now.where("user_id % 5 <> 1"))
    return reduce(DataFrame.unionByName, [K.read(spark, path, v).withColumn("version", F.lit(v)) for v in K.versions(spark, path)])


def _kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", "user_id", "ts")


def events_near_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and errors of one user at most two hours apart."""
    found = V.within(_kind(spark, sf_dir, "purchase"), _kind(spark, sf_dir, "error"), "user_id", "ts", 7_200_000_000)
    return found.select(F.col("l_event_id").alias("purchase"), F.col("r_event_id").alias("error"))


def last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last click before it."""
    found = V.latest_before(_kind(spark, sf_dir, "purchase"), _kind(spark, sf_dir, "click"), "user_id", "ts", "event_id", "event_id")
    return found.select("event_id", F.col("before_").alias("click"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sessions(table(spark, sf_dir, "events").select("user_id", "ts"), "6 hours", None)


def user_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a stream; a last row, years later, ends the sessions that are open."""
    root = new_folder(spark, "sessions")
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(f"{root}/in")
    stream = W.sessions(spark.readStream.schema("user_id long, ts timestamp").parquet(f"{root}/in"), "6 hours")
    _to_completion(stream, root)
    spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.lit("2100-01-01").cast("timestamp").alias("ts")).write.mode("append").parquet(f"{root}/in")
    return _to_completion(stream, root)


def clicks_to_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases at most an hour after a click of the same user, as a join of two streams."""
    root = new_folder(spark, "joined")
    for kind in ("click", "purchase"):
        _kind(spark, sf_dir, kind).select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(f"{root}/{kind}")
    streams = [spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(f"{root}/{kind}") for kind in ("click", "purchase")]
    return _to_completion(W.followed(*streams), root)


def distinct_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts sold by year from states that were stored by day: rows exactly, distinct values within three standard errors."""
    li = table(spark, sf_dir, "lineitem").select("l_shipdate", F.year("l_shipdate").alias("year"), "l_partkey")
    states = written(D.sketched(li, ["l_shipdate", "year"], "l_partkey"), "day-states")
    exact = li.groupBy("year").agg(F.count_distinct("l_partkey").alias("exact"))
    merged = D.merged_sketches(states, ["year"]).join(exact, "year")
    return merged.select("year", "n", "exact", (F.abs(F.col("distinct_values") - F.col("exact")) <= F.greatest(F.lit(1), 3 * 1.04 / 128 * F.col("exact"))).alias("close"))


QUERIES = {f.__name__: f for f in (
    committed_versions, events_near_errors, last_click, user_sessions, user_sessions_stream, clicks_to_purchases, distinct_by_year, delimited_files, workspace_listing, chunked_sse, chunked_sse_stream, live_tail, upload_expiry, merged_files,
)}
_SSE = f"SELECT user_id::BIGINT AS stream, 2 * (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS place, {_PAYLOAD.format()} AS payload FROM events"
_SESSIONS = """SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM (
    SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
    FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, k"""
_MADE = "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS title FROM orders"
ORACLES = {
    "committed_versions": f"""WITH o AS ({_MADE}), v1 AS (SELECT * FROM o WHERE id % 3 <> 0), v2 AS (SELECT id, user_id, CASE WHEN id % 2 = 0 THEN 'new' ELSE title END AS title FROM o WHERE id % 3 <> 0 OR id % 2 = 0)
        SELECT *, 1::INTEGER AS version FROM v1 UNION ALL SELECT *, 2 FROM v2 UNION ALL SELECT *, 3 FROM v2 WHERE user_id % 5 <> 1""",
    "events_near_errors": "SELECT a.event_id AS purchase, b.event_id AS error FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'purchase' AND b.event_type = 'error'",
    "last_click": "SELECT a.event_id, (SELECT arg_max(b.event_id, (b.ts, b.event_id)) FROM events b WHERE b.event_type = 'click' AND b.user_id = a.user_id AND b.ts <= a.ts) AS click FROM events a WHERE a.event_type = 'purchase'",
    "user_sessions": _SESSIONS,
    "user_sessions_stream": _SESSIONS,
    "clicks_to_purchases": "SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'",
    "distinct_by_year": "SELECT year(l_shipdate)::INTEGER AS year, count(*) AS n, count(DISTINCT l_partkey) AS exact, true AS close FROM lineitem GROUP BY 1",
    "delimited_files": "SELECT doc_id, lang, source, n_chars, 5::INTEGER AS n_cells, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "workspace_listing": "SELECT DISTINCT '.s' || coalesce(source, '') AS top, '_' || coalesce(lang, '') AS sub, 3::INTEGER AS depth FROM documents",
    "chunked_sse": _SSE,
    "chunked_sse_stream": _SSE,
    "live_tail": REQUESTS["snapshot_and_tail"],
    "upload_expiry": f"SELECT event_id AS upload_id, v AS verdict FROM ({REQUESTS['upload_sweep'].replace('AS verdict', 'AS v')}) WHERE v <> 'keep'",
    "merged_files": "SELECT conv_id AS upload_id, sum(strlen(coalesce(text, '')))::BIGINT AS n_bytes, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS sha256, true AS same FROM conversations GROUP BY conv_id",
}
