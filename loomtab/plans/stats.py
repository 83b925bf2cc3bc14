"""Statistics that analysts ask for, and (``ext_``) extensions that go beyond them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import stats as S
from .common import table

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def stat_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.describe(table(spark, sf_dir, "lineitem"), _NUMBERS)


def stat_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.value_counts(table(spark, sf_dir, "events"), "event_type")


def stat_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 4).alias("avg_disc"))


def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.profile(table(spark, sf_dir, "orders")).select("position", "column_name", "n_rows", "non_null")


def ext_hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def ext_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def ext_asof_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the last view of its user before it: one window over both kinds, no range join."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("view_id", last).where("event_type = 'purchase'").select("event_id", "user_id", "view_id")


def ext_top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three parts of most revenue for each brand."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    ranked = li.join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("revenue"), "p_partkey")))
    return ranked.where("rank <= 3").select("p_brand", "p_partkey", "revenue", "rank")


QUERIES = {f.__name__: f for f in (stat_describe, stat_value_counts, stat_group_counts, table_profile, ext_hourly_events, ext_cube, ext_asof_last_view, ext_top_parts)}
_DESCRIBE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, max({c})::DOUBLE AS max FROM lineitem"
    for c in _NUMBERS
)
ORACLES = {
    "stat_describe": _DESCRIBE,
    "stat_value_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "stat_group_counts": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 4) AS avg_disc FROM lineitem GROUP BY ALL",
    "table_profile": " UNION ALL ".join(f"SELECT {i}::INTEGER AS position, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS non_null FROM orders" for i, c in enumerate(("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))),
    "ext_hourly_events": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "ext_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "ext_asof_last_view": """SELECT event_id, user_id, view_id FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_id
        FROM events WHERE event_type IN ('view', 'purchase')) WHERE event_type = 'purchase'""",
    "ext_top_parts": """WITH r AS (SELECT l_partkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1),
        k AS (SELECT p_brand, p_partkey, revenue, row_number() OVER (PARTITION BY p_brand ORDER BY revenue DESC, p_partkey) AS rank FROM r JOIN part ON p_partkey = l_partkey)
        SELECT p_brand, p_partkey, revenue, rank::INTEGER AS rank FROM k WHERE rank <= 3""",
}
