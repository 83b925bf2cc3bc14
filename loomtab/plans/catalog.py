"""Queries over the catalog: customers stand for users or projects, orders for sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import mutations as M
from .common import table


def scan_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isNotNull())
    return o.select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_orderkey"))


def session_latest_content_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), "c_name")
    content = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("content"))
    return C.with_latest(users, content)


def point_lookup_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("version"), F.col("event_type").alias("content"))
    return C.latest(e)


def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's versions in order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("content"))
    return o.orderBy("session_id", "version")


def members_left_join_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    users = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    return C.members_with_users(members, users).select("o_orderkey", "user_id", "c_name")


def accessible_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    own = o.where("o_orderstatus = 'F'").withColumn("via", F.lit("own")).drop("o_orderstatus")
    shared = o.withColumn("via", F.lit("shared")).drop("o_orderstatus")
    return C.accessible(own, shared).select("session_id", "owner", "via")


def owned_plus_member_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("user_id"))
    members = projects.select(F.col("project_id"), (F.col("user_id") % 7).alias("user_id"))
    users = projects.select("user_id").distinct().withColumn("is_admin", F.lit(False))
    found = C.reachable_projects(users, projects.withColumnRenamed("project_id", "id"), members)
    return found.select(F.col("id").alias("project_id"), "user_id", "via")


def session_counts_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return C.with_counts(users, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"], 3, 5)


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    target = part.where("p_size < 20").select(F.col("p_brand").alias("project"), F.col("p_name").alias("path"))
    staged = part.select(F.col("p_brand").alias("project"), F.col("p_name").alias("path"), F.col("p_partkey").alias("asset_id"))
    return M.insert_if_absent(target, staged, ["project", "path"])


def first_write_wins_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 3 == 1, "  ").otherwise(F.col("c_name")).alias("title"))
    return M.set_if_blank(c, "title", F.lit("first question"))


def orphan_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") * 10).alias("project_id"))
    return M.assign_where_null(c, "project_id", F.lit(7).cast("long"), F.col("c_nationkey") < 10)


def partial_update_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    changes = s.where("s_acctbal > 0").select("s_suppkey", F.upper("s_name").alias("s_name"), F.lit(None).cast("int").alias("s_nationkey"))
    return M.partial_update(s, changes, "s_suppkey", ["s_name", "s_nationkey"])


def upsert_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), F.lit("/old").alias("path"))
    changes = o.select(F.col("o_custkey").alias("session"), F.concat(F.lit("/new/"), F.col("o_orderkey").cast("string")).alias("path"), "o_orderkey")
    return M.upsert(target.withColumn("ord", F.lit(0).cast("long")), changes.withColumnRenamed("o_orderkey", "ord"), "session", "ord")


def delete_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return M.delete_by_key(part, part.where("p_size < 10"), ["p_partkey"])


def sessions_of_existing_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(users, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def permissions_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit('["data_upload","run"]'), F.lit("not json"), F.lit(None).cast("string"), F.lit("[]")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.permissions(raw), ",").alias("permissions"))


def platform_admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("c_custkey") % 3 == 0, " Admin ").when(F.col("c_custkey") % 3 == 1, "user")
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.lower(F.trim(role)) == "admin", F.lit(False)).alias("is_admin"))


QUERIES = {f.__name__: f for f in (
    scan_project_filter, session_latest_content_left, point_lookup_latest_version, version_history, members_left_join_users, accessible_union_dedupe, owned_plus_member_anti,
    session_counts_enriched, page_with_total, insert_if_absent, first_write_wins_title, orphan_assignment, partial_update_coalesce, upsert_paths, delete_assets,
    sessions_of_existing_users, permissions_parse, platform_admins,
)}
ORACLES = {
    "scan_project_filter": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IS NOT NULL",
    "session_latest_content_left": """SELECT c.c_custkey AS session_id, c.c_name, o.o_orderkey AS version, o.o_orderpriority AS content FROM customer c
        LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderkey = (SELECT max(x.o_orderkey) FROM orders x WHERE x.o_custkey = c.c_custkey)""",
    "point_lookup_latest_version": "SELECT user_id AS session_id, max(event_id) AS version, arg_max(event_type, event_id) AS content FROM events GROUP BY user_id",
    "version_history": "SELECT o_custkey AS session_id, o_orderkey AS version, o_orderstatus AS content FROM orders",
    "members_left_join_users": "SELECT o_orderkey, o_custkey AS user_id, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey",
    "accessible_union_dedupe": "SELECT o_orderkey AS session_id, o_custkey AS owner, CASE WHEN o_orderstatus = 'F' THEN 'own' ELSE 'shared' END AS via FROM orders",
    "owned_plus_member_anti": "SELECT o_orderkey AS project_id, o_custkey AS user_id, 'owner' AS via FROM orders UNION ALL SELECT o_orderkey, o_custkey % 7, 'member' FROM orders WHERE o_custkey % 7 <> o_custkey AND o_orderkey <> 0 AND o_custkey % 7 IN (SELECT o_custkey FROM orders)",
    "session_counts_enriched": "SELECT c_custkey, c_name, count(o_orderkey) AS session_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "page_with_total": "SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier) AS total FROM supplier ORDER BY s_suppkey LIMIT 5 OFFSET 3",
    "insert_if_absent": "SELECT p_brand AS project, p_name AS path, min(p_partkey) AS asset_id FROM part s WHERE NOT EXISTS (SELECT 1 FROM part t WHERE t.p_size < 20 AND t.p_brand = s.p_brand AND t.p_name = s.p_name) GROUP BY 1, 2",
    "first_write_wins_title": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN c_name ELSE 'first question' END AS title, c_custkey % 3 <> 2 AS saved FROM customer",
    "orphan_assignment": "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 10 WHEN c_nationkey < 10 THEN 7 END::BIGINT AS project_id, c_custkey % 4 = 0 AND c_nationkey < 10 AS assigned FROM customer",
    "partial_update_coalesce": "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN upper(s_name) ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier",
    "upsert_paths": "SELECT c_custkey AS session, coalesce('/new/' || max(o_orderkey), '/old') AS path, coalesce(max(o_orderkey), 0)::BIGINT AS ord FROM customer FULL JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "delete_assets": "SELECT p_partkey, p_brand, p_size FROM part WHERE NOT coalesce(p_size < 10, false)",
    "sessions_of_existing_users": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "permissions_parse": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'data_upload,run' WHEN 3 THEN '' ELSE 'data_download' END AS permissions FROM customer",
    "platform_admins": "SELECT c_custkey, c_custkey % 3 = 0 AS is_admin FROM customer",
}
