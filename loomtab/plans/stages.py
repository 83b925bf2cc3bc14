"""Queries over what passes between the stages of an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stages as G
from ..operators import catalog
from ..operators import events as E
from ..operators.ordered import dealt, joined
from .common import table


def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    analysis, steps = F.when(n % 3 == 0, " goal ").when(n % 3 == 1, ""), F.when(n % 2 == 0, "do it\n").otherwise("")
    text = F.when(n % 5 == 0, " given ")
    return o.select("o_orderkey", G.final_plan(text, analysis, steps).alias("plan"), G.plan_is_valid(analysis, steps).alias("valid"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 5
    reply = F.when(n == 0, 'so: {"next_stage": "coder", "reason": "r"} end').when(n == 1, '```json\n{"next_stage": "worker", "feedback_for_next": "f"}\n```').when(n == 2, '{"next_stage": "nowhere"}').when(n == 3, "no object")
    d = table(spark, sf_dir, "orders").select("o_orderkey", G.decision(reply).alias("d"))
    return d.select("o_orderkey", F.coalesce("d.next_stage", F.lit("-")).alias("next_stage"), F.coalesce("d.feedback_for_next", F.lit("-")).alias("feedback"), F.coalesce("d.reason", F.lit("-")).alias("reason"))


def worker_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 2 == 0, "trace").otherwise("")
    failed = e.select("user_id", "event_id", F.struct(F.concat(F.lit("s"), F.col("event_id").cast("string"), F.lit(".py")).alias("path"), (F.col("event_type") != "error").alias("success"), said.alias("stderr")).alias("r"))
    per = joined(dealt(failed, ["user_id", "event_id"], "results"), ["user_id"], "event_id", {"rs": F.when(~F.col("r.success") & (F.col("r.stderr") != ""), F.col("r"))})
    return per.select("user_id", G.error_text(F.array(F.lit("first"), F.lit(""), F.lit(None).cast("string")), F.col("rs")).alias("errors"))


def silent_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    errors = G.with_silence(F.col("event_type") != "error", F.when(F.col("event_id") % 3 == 0, "log"), F.array(F.lit("e")))
    return e.select(errors.alias("errors")).groupBy(F.size("errors").alias("n_errors")).agg(F.count("*").alias("n"))


def trace_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.last_of(table(spark, sf_dir, "events"), "user_id", "event_id", 8)
    one = F.struct(F.col("event_id").cast("int").alias("invoke"), F.col("event_type").alias("next"), F.lit("why").alias("reason"), F.when(F.col("event_id") % 2 == 0, "more").otherwise("").alias("feedback"))
    per = e.groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("trace"))
    return per.select("user_id", G.trace_section(F.col("trace")).alias("section"))


def memory_without_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    memory = F.when(n % 3 == 0, F.concat(F.lit("# m\n## 3. a\nx\n## 4. digest\nmuch\n## 5. b "), n.cast("string"), F.lit("\ny\n"))).when(n % 3 == 1, "# m\n## 4. digest\nmuch\n").otherwise("no sections\n")
    return table(spark, sf_dir, "orders").select("o_orderkey", G.without_digest(memory).alias("memory"))


def log_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", G.log_id(F.when(F.col("p_partkey") % 4 == 0, "#!?").when(F.col("p_partkey") % 4 == 1, F.col("p_brand"))).alias("log_id"))


def asset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n, u = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    project = F.concat(F.lit("/w/"), u, F.lit("/p"))
    session = F.when(F.col("o_orderkey") % 2 == 0, F.concat(project, F.lit("/sessions/"), n)).otherwise(F.concat(F.lit("/w/"), u, F.lit("/"), n))
    return o.select("o_orderkey", G.asset_path(F.concat(session, F.lit("/raw/a.csv")), project, session, n).alias("path"))


def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", G.iso_time(F.col("o_orderdate").cast("timestamp")).alias("created_at"))


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 10 == 0, "__personal_default__").otherwise(F.col("c_name"))
    c = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    return c.select("c_custkey", (F.col("name") == "__personal_default__").alias("is_default"), F.when(F.col("name") == "__personal_default__", "personal").otherwise(F.col("name")).alias("name"))


def flattened_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    content = F.when(n % 2 == 0, F.concat(F.lit('["a", {"text": "b'), n.cast("string"), F.lit('"}]'))).otherwise(F.concat(F.lit('"plain '), n.cast("string"), F.lit('"')))
    return table(spark, sf_dir, "orders").select("o_orderkey", G.flattened(content).alias("content"))


def table_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey").limit(8)
    return n.select(F.col("n_nationkey").alias("row"), G.coordinates(["n_nationkey", "n_name"], F.col("n_nationkey")).alias("line"))


def delete_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    path = F.when(n % 4 == 0, "raw/a.csv").when(n % 4 == 1, "../x").when(n % 4 == 2, "SESSION_MEMORY.md").otherwise("/raw/./b")
    kind = F.when(n % 3 == 0, "file").when(n % 3 == 1, "directory")
    return table(spark, sf_dir, "orders").select(G.delete_verdict(path, n % 11 != 0, n % 7 == 0, kind).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


def project_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects with the number of sessions and which folders they have: one pass over the files, no lookup each."""
    o = table(spark, sf_dir, "orders")
    projects = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    folder = F.element_at(F.array(F.lit("raw"), F.lit("outputs"), F.lit("archive")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    has = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set(folder).alias("folders"))
    counted = catalog.with_counts(projects, o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey").join(has, "c_custkey", "left")
    return counted.select("c_custkey", "session_count", *[F.coalesce(F.array_contains("folders", f), F.lit(False)).alias(f"has_{f}") for f in ("raw", "outputs", "archive")])


def last_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event that a poller of accumulated content is given for each version: the last one if there are more, else the last that changed."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id")
    n = F.row_number().over(w)
    return e.select("user_id", n.cast("long").alias("version"), "event_id", "event_type").select("user_id", "version", F.col("event_type").alias("given"))


QUERIES = {f.__name__: f for f in (
    plan_texts, decisions, worker_errors, silent_success, trace_sections, memory_without_digest, log_ids, asset_paths, iso_timestamps, display_names, flattened_content, table_dump, delete_checks, project_details, last_change,
)}
_NL = "chr(10)"
ORACLES = {
    "plan_texts": f"""WITH p AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'goal' ELSE '' END AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'do it' ELSE '' END AS s FROM orders)
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'given' WHEN a = '' AND s = '' THEN '' ELSE '{G.HEADINGS[0]}' || {_NL} || {_NL} || a || {_NL} || {_NL} || '{G.HEADINGS[1]}' || {_NL} || {_NL} || s END AS plan, a <> '' AND s <> '' AS valid FROM p""",
    "decisions": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'coder' WHEN 1 THEN 'worker' ELSE '-' END AS next_stage, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'f' ELSE '-' END AS feedback, CASE o_orderkey % 5 WHEN 0 THEN 'r' WHEN 1 THEN '' ELSE '-' END AS reason FROM orders",
    "worker_errors": f"""SELECT user_id, substr('first' || coalesce({_NL} || string_agg('s' || event_id || '.py: trace', {_NL} ORDER BY event_id) FILTER (WHERE event_type = 'error' AND event_id % 2 = 0), ''), 1, 12000) AS errors FROM events GROUP BY user_id""",
    "silent_success": "SELECT (CASE WHEN event_type <> 'error' AND event_id % 3 <> 0 THEN 2 ELSE 1 END)::INTEGER AS n_errors, count(*) AS n FROM events GROUP BY 1",
    "trace_sections": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events)
        SELECT user_id, string_agg('- 第 ' || event_id || ' 次 supervisor → **' || event_type || '**；理由: why' || CASE WHEN event_id % 2 = 0 THEN {_NL} || '  - 反馈摘录: more' ELSE '' END, {_NL} ORDER BY event_id) AS section FROM r WHERE back <= 8 GROUP BY user_id""",
    "memory_without_digest": f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '# m' || {_NL} || '## 3. a' || {_NL} || 'x' || {_NL} || '## 5. b ' || o_orderkey || {_NL} || 'y' WHEN 1 THEN '# m' ELSE 'no sections' || {_NL} END AS memory FROM orders",
    "log_ids": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN replace(p_brand, '#', '') ELSE 'unknown' END AS log_id FROM part",
    "asset_paths": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'sessions/' || o_orderkey || '/raw/a.csv' ELSE 'legacy/' || o_orderkey || '/raw/a.csv' END AS path FROM orders",
    "iso_timestamps": "SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%f') = '000000' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') END AS created_at FROM orders",
    "display_names": "SELECT c_custkey, c_custkey % 10 = 0 AS is_default, CASE WHEN c_custkey % 10 = 0 THEN 'personal' ELSE c_name END AS name FROM customer",
    "flattened_content": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'ab' || o_orderkey ELSE 'plain ' || o_orderkey END AS content FROM orders",
    "table_dump": "SELECT n_nationkey AS row, '行' || n_nationkey || '：列0=''' || n_nationkey || ''' | 列1=''' || trim(n_name) || '''' AS line FROM nation ORDER BY n_nationkey LIMIT 8",
    "delete_checks": """SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'no_session' WHEN o_orderkey % 7 = 0 THEN 'archived' WHEN o_orderkey % 4 = 1 THEN 'bad_path' WHEN o_orderkey % 4 = 2 THEN 'protected'
        WHEN o_orderkey % 3 = 1 THEN 'directory' WHEN o_orderkey % 3 = 2 THEN 'missing' ELSE 'ok' END AS verdict, count(*) AS n FROM orders GROUP BY 1""",
    "project_details": """SELECT c_custkey, count(o_orderkey) AS session_count, coalesce(bool_or(o_orderkey % 3 = 0), false) AS has_raw, coalesce(bool_or(o_orderkey % 3 = 1), false) AS has_outputs, coalesce(bool_or(o_orderkey % 3 = 2), false) AS has_archive
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "last_change": "SELECT user_id, version, event_type AS given FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events)",
}
