"""Queries over the event log, uploads, routing and worker results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import events as E
from ..operators import routing as R
from ..operators import uploads as U
from ..operators.ordered import new_folder
from ..streaming import events as S
from .common import table

#: Turns of a conversation as events of a session, by turn modulo 5.
KINDS = ("llm_chunk", "llm_chunk", "llm_complete", "llm_chunk", "stage_result")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), ((F.col("turn") + F.col("conv_id")) % 5 + 1).cast("int"))
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), kind.alias("type"), F.coalesce("text", F.lit("")).alias("content"))


def event_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compact(_log(spark, sf_dir)).select("session_id", "seq", "type", "content", "n_merged")


def stream_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log through a stream of files, to completion, and the snapshot of its changes."""
    root = new_folder(spark, "stream")
    _log(spark, sf_dir).repartition(4, "session_id").write.parquet(f"{root}/in")
    events = spark.readStream.schema("session_id long, seq long, type string, content string").parquet(f"{root}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = S.compact_stream(events).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return S.snapshot(spark.read.schema(f"{S.OUT}, batch int").parquet(f"{root}/out"))


def tail_after_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("version"), F.col("event_type").alias("type"))
    seen = e.groupBy("session_id").agg((F.min("version") + 5).alias("seen"))
    return E.tail_after(e, seen)


def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("type", F.when(F.col("type") == "llm_chunk", "report_chunk").when(F.col("type") == "stage_result", "error").otherwise(F.col("type")))
    return E.fold(log).select("session_id", "n_events", F.sha2("report", 256).alias("report_sha256"), "status")


def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", T.sse(F.to_json(F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id")))).alias("frame"))


_LEVELS = {
    "route": ["planner", "coder", "worker", "reporter", "finish"], "last": ["coder", ""], "invocations": [23, 24], "replans": [3, 4], "corrections": [4, 5],
    **{k: [False, True] for k in ("plan", "code", "ran", "failed", "data", "done", "force")},
}


def routing_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state for every order: digits of its key pick the levels, so consecutive keys go through their combinations."""
    out = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("state_id"), F.col("o_orderkey").alias("left_"))
    for name, values in _LEVELS.items():
        out = out.withColumn(name, F.element_at(F.array(*map(F.lit, values)), (F.col("left_") % len(values) + 1).cast("int"))).withColumn("left_", F.floor(F.col("left_") / len(values)))
    return out.drop("left_")


def route_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.clamp(routing_states(spark, sf_dir)).select("state_id", "route", F.coalesce("rule", F.lit("")).alias("rule"))


def correction_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = routing_states(spark, sf_dir)
    args = [F.col(c) for c in ("failed", "ran", "code", "corrections")]
    return s.groupBy(R.should_correct(*args).alias("correct"), R.should_keep_code(*args).alias("keep")).agg(F.count("*").alias("n"))


def worker_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    results = e.select("user_id", "event_id", (F.col("event_type") != "error").alias("success"), F.col("event_type").alias("log"), F.concat(F.lit("failed "), F.col("event_id").cast("string")).alias("error"))
    r = E.rollup_results(results, "user_id", "event_id")
    return r.select("user_id", "success", F.sha2("logs", 256).alias("logs_sha256"), F.substring(F.array_join("errors", "\n"), 1, 12000).alias("errors"))


def analyzable_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_semi").select("o_orderkey")


def missing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("upload_id"), (F.col("l_linenumber").cast("long") - 1).alias("part"), F.col("l_quantity").cast("long").alias("bytes"))
    manifests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("upload_id"), (F.col("o_orderkey") % 9).alias("total"), F.lit(512).cast("long").alias("size"))
    s = U.status(manifests, li)
    return s.select("upload_id", F.array_join("uploaded", ",").alias("uploaded"), F.array_join("missing", ",").alias("missing"), F.col("uploaded_bytes").cast("long").alias("uploaded_bytes"), "progress")


def part_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    offered = li.select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") % 11).alias("owner"), F.when(F.col("l_orderkey") % 11 == 3, 0).otherwise(F.col("l_orderkey") % 11).alias("user"),
        F.when(F.col("l_orderkey") % 13 == 0, 86_401).otherwise(86_400).alias("age"), F.when(F.col("l_orderkey") % 17 == 0, "completed").otherwise("uploading").alias("state"),
        (F.col("l_linenumber").cast("long") - 1).alias("part"), F.lit(10).cast("long").alias("size"), F.lit(4).cast("long").alias("chunk"), F.lit(3).cast("long").alias("total"),
        F.when(F.col("l_linenumber") == 3, 2).otherwise(4).cast("long").alias("bytes"), F.when(F.col("l_orderkey") % 5 == 0, " ABC ").when(F.col("l_orderkey") % 5 == 1, "abd").alias("checksum"), F.lit("abc").alias("actual"),
    )
    return U.accept(offered).groupBy("verdict").agg(F.count("*").alias("n"))


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    size = (F.col("o_totalprice") * 1000).cast("long")
    chunk = U.chunk_size(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") * 100_000).cast("long")).cast("long")
    o = o.select("o_orderkey", size.alias("size"), chunk.alias("chunk"))
    total = U.total_chunks(F.col("size"), F.col("chunk"))
    return o.select("o_orderkey", "chunk", total.alias("total"), U.expected_size(total - 1, F.col("size"), F.col("chunk"), total).cast("long").alias("last_bytes"))


def ordered_merge_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return U.merged(c, "conv_id", "turn", "text").select("conv_id", "sha256", F.col("n_bytes").cast("long").alias("n_bytes"))


def expired_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return U.expired(e.withColumn("created_at", F.col("ts").cast("timestamp")), now).agg(F.count("*").alias("n_expired"))


def trace_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.last_of(table(spark, sf_dir, "events"), "user_id", "event_id", 8).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("trace"))
    return e.select("user_id", F.array_join(T.tail(F.col("trace")), ">").alias("trace"))


def command_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    command = F.element_at(F.array(F.concat(F.lit("python3 out/s"), n.cast("string"), F.lit(".py")), F.lit("python3 a.py; rm x"), F.lit("python a.py"), F.lit("python3 a.sh")), (n % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(T.allowed_command(command), F.lit("")).alias("script"))


def unfenced_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("```python\nx = "), F.col("o_orderkey").cast("string"), F.lit("\n```"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.unfence(code).alias("code"))


QUERIES = {f.__name__: f for f in (
    event_compaction, stream_compaction, tail_after_version, session_fold, sse_frames, route_clamp, correction_modes, worker_rollup, analyzable_exists, missing_parts, part_acceptance,
    chunk_plan, ordered_merge_checksum, expired_uploads, trace_tail, command_allowlist, unfenced_code,
)}


def _states_sql() -> str:
    parts, step = [], 1
    for name, values in _LEVELS.items():
        shown = ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in values)
        parts.append(f"list_extract([{shown}], ((state_id // {step}) % {len(values)} + 1)::INTEGER) AS {name}")
        step *= len(values)
    return f"SELECT state_id, {', '.join(parts)}, '' AS rule FROM (SELECT o_orderkey AS state_id FROM orders)"


#: The rule chain as SQL conditions, in order: (rule, condition, new route).
_CHAIN = [
    ("forced", "force AND route NOT IN ('reporter', 'finish')", "'reporter'"),
    ("early_finish", "route = 'finish' AND NOT done", "CASE WHEN NOT plan THEN 'planner' WHEN code AND ran THEN 'reporter' WHEN NOT data THEN 'reporter' WHEN NOT code THEN 'coder' ELSE 'worker' END"),
    ("needs_plan", "NOT plan AND route IN ('coder', 'worker', 'reporter')", "'planner'"),
    ("needs_code", "plan AND route = 'worker' AND NOT code AND data", "'coder'"),
    ("needs_run", "plan AND route = 'reporter' AND NOT ran AND data", "CASE WHEN code THEN 'worker' ELSE 'coder' END"),
    ("finished", "done AND route <> 'finish'", "'finish'"),
    ("too_many_steps", "invocations >= 24 AND NOT done AND plan AND code AND route NOT IN ('reporter', 'finish')", "'reporter'"),
    ("too_many_plans", "route = 'planner' AND replans >= 4 AND plan", "CASE WHEN NOT data THEN 'reporter' WHEN NOT code THEN 'coder' WHEN NOT ran THEN 'worker' ELSE 'reporter' END"),
    ("code_again", "plan AND code AND last = 'coder' AND route = 'coder' AND data", "'worker'"),
    ("too_many_fixes", "plan AND code AND corrections >= 5 AND ran AND failed AND route = 'coder' AND data", "'worker'"),
    ("no_data", "plan AND NOT data AND NOT done AND route IN ('coder', 'worker')", "'reporter'"),
]


def _route_sql() -> str:
    ctes = [f"s0 AS ({_states_sql()})"]
    for i, (name, condition, route) in enumerate(_CHAIN):
        ctes.append(f"s{i + 1} AS (SELECT * REPLACE (CASE WHEN {condition} THEN {route} ELSE route END AS route, CASE WHEN {condition} THEN '{name}' ELSE rule END AS rule) FROM s{i})")
    return f"WITH {', '.join(ctes)} SELECT state_id, route, rule FROM s{len(_CHAIN)}"


_LOG = "log AS (SELECT conv_id AS session_id, turn AS seq, list_extract([{}], ((turn + conv_id) % 5 + 1)::INTEGER) AS type, coalesce(text, '') AS content FROM conversations)".format(", ".join(f"'{k}'" for k in KINDS))
_COMPACT = f"""WITH {_LOG}, b AS (
        SELECT *, CASE WHEN type = 'llm_chunk' AND coalesce(lag(type) OVER (PARTITION BY session_id ORDER BY seq), '') = 'llm_chunk' THEN 0 ELSE 1 END AS starts FROM log
    ), i AS (SELECT *, sum(starts) OVER (PARTITION BY session_id ORDER BY seq) AS island FROM b
    ), g AS (SELECT session_id, island, min(seq) AS seq, arg_min(type, seq) AS type, string_agg(content, '' ORDER BY seq) AS content, count(*) AS n_merged FROM i GROUP BY ALL
    ), a AS (SELECT *, lead(type) OVER (PARTITION BY session_id ORDER BY island) AS after FROM g)
    SELECT session_id, seq, type, content, n_merged FROM a WHERE NOT (type = 'llm_chunk' AND coalesce(after, '') = 'llm_complete')"""
ORACLES = {
    "event_compaction": _COMPACT,
    "stream_compaction": _COMPACT,
    "tail_after_version": """WITH seen AS (SELECT user_id, min(event_id) + 5 AS seen FROM events GROUP BY user_id),
        n AS (SELECT e.* FROM events e JOIN seen USING (user_id) WHERE event_id > seen),
        ends AS (SELECT user_id, min(event_id) AS stop FROM n WHERE event_type IN ('streaming_ended', 'streaming_error', 'error') GROUP BY user_id)
        SELECT user_id AS session_id, event_id AS version, event_type AS type FROM n LEFT JOIN ends USING (user_id) WHERE stop IS NULL OR event_id <= stop""",
    "session_fold": f"""WITH {_LOG} SELECT session_id, count(*) AS n_events, sha256(coalesce(string_agg(content, '' ORDER BY seq) FILTER (WHERE type = 'llm_chunk'), '')) AS report_sha256,
        CASE WHEN arg_max(type, seq) = 'stage_result' THEN 'error' ELSE 'done' END AS status FROM log GROUP BY session_id""",
    "sse_frames": """SELECT event_id, 'data: {"type":"' || event_type || '","id":' || event_id || '}' || chr(10) || chr(10) AS frame FROM events""",
    "route_clamp": _route_sql(),
    "correction_modes": f"SELECT ran AND failed AND code AND corrections < 5 AS correct, ran AND failed AND code AND corrections >= 5 AS keep, count(*) AS n FROM ({_states_sql()}) GROUP BY ALL",
    "worker_rollup": """SELECT user_id, bool_and(event_type <> 'error') AS success, sha256(string_agg(event_type, chr(10) ORDER BY event_id)) AS logs_sha256,
        substr(coalesce(string_agg('failed ' || event_id, chr(10) ORDER BY event_id) FILTER (WHERE event_type = 'error'), ''), 1, 12000) AS errors FROM events GROUP BY user_id""",
    "analyzable_exists": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "missing_parts": """WITH m AS (SELECT o_orderkey AS upload_id, o_orderkey % 9 AS total FROM orders),
        h AS (SELECT l_orderkey AS upload_id, l_linenumber - 1 AS part, max(l_quantity::BIGINT) AS bytes FROM lineitem JOIN m ON l_orderkey = upload_id WHERE l_linenumber - 1 < total GROUP BY ALL),
        u AS (SELECT upload_id, string_agg(part::VARCHAR, ',' ORDER BY part) AS uploaded, sum(bytes)::BIGINT AS b FROM h GROUP BY upload_id),
        w AS (SELECT m.upload_id, unnest(range(0, total)) AS part FROM m),
        x AS (SELECT w.upload_id, string_agg(w.part::VARCHAR, ',' ORDER BY w.part) AS missing FROM w LEFT JOIN h ON h.upload_id = w.upload_id AND h.part = w.part WHERE h.part IS NULL GROUP BY 1)
        SELECT m.upload_id, coalesce(uploaded, '') AS uploaded, coalesce(missing, '') AS missing, coalesce(b, 0) AS uploaded_bytes, round(coalesce(b, 0) / 512.0::DOUBLE, 6) AS progress
        FROM m LEFT JOIN u USING (upload_id) LEFT JOIN x USING (upload_id)""",
    "part_acceptance": """SELECT CASE WHEN l_orderkey % 11 = 3 THEN 'forbidden' WHEN l_orderkey % 13 = 0 THEN 'expired' WHEN l_orderkey % 17 = 0 THEN 'completed' WHEN l_linenumber > 3 THEN 'range'
        WHEN l_orderkey % 5 = 1 THEN 'checksum' ELSE 'ok' END AS verdict, count(*) AS n FROM lineitem GROUP BY 1""",
    "chunk_plan": """WITH o AS (SELECT o_orderkey, (trunc(o_totalprice * 1000))::BIGINT AS size, greatest(1048576, least(10485760, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 100000 ELSE 5242880 END))::BIGINT AS chunk FROM orders),
        t AS (SELECT *, (CASE WHEN size <= 0 THEN 0 ELSE (size + chunk - 1) // chunk END)::BIGINT AS total FROM o)
        SELECT o_orderkey, chunk, total, (CASE WHEN total = 0 THEN 0 ELSE size - chunk * (total - 1) END)::BIGINT AS last_bytes FROM t""",
    "ordered_merge_checksum": "SELECT conv_id, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS sha256, sum(strlen(coalesce(text, '')))::BIGINT AS n_bytes FROM conversations GROUP BY conv_id",
    "expired_uploads": "SELECT count(*) AS n_expired FROM events WHERE floor(epoch(TIMESTAMP '2024-06-01 00:00:00')) - floor(epoch(ts)) > 86400",
    "trace_tail": "SELECT user_id, array_to_string(list_slice(t, greatest(1, len(t) - 7), len(t)), '>') AS trace FROM (SELECT user_id, list(event_type ORDER BY event_id) AS t FROM events GROUP BY user_id)",
    "command_allowlist": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'out/s' || o_orderkey || '.py' ELSE '' END AS script FROM orders",
    "unfenced_code": "SELECT o_orderkey, 'x = ' || o_orderkey AS code FROM orders",
}
