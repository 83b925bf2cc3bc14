"""Tables in the shared folder, and places in an order that no single task has to hold."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a partition that one task sorts and numbers.
ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that executors share; a session that isn't local and names none is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
    return where or f"file://{tempfile.gettempdir()}/checkpoints"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes when the session's driver ends."""
    path = f"{shared_dir(spark)}/loomtab-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: cuts the lineage and the plan, and outlives executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in tasks of about ``rows`` rows each: for work that is much for a row, on tables that are small by bytes."""
    return df.repartition(max(1, -(-df.count() // rows)))


def dealt(df: DataFrame, order: list[Column | str], name: str, rows: int = ROWS) -> DataFrame:
    """``df`` with part_: stretches of the order of the columns ``order``, which must be total, of about ``rows`` each.

    Rows are dealt by ranges and written once, so a key that holds any share of the rows is spread over as many tasks as
    its rows need. Up to ``rows`` rows are one part as they are.
    """
    parts = max(1, -(-df.count() // rows))
    if parts == 1:
        return df.withColumn("part_", F.lit(0))
    return written(df.repartitionByRange(parts, *order).withColumn("part_", F.spark_partition_id()), name)


def running(df: DataFrame, order: list[Column | str], value: Column) -> DataFrame:
    """Rows that ``dealt`` made, with place_ (from 0, in the order) and sum_ (of ``value``, longs, over all rows up to this one).

    Numbers within parts plus those of the parts before, one row a part.
    """
    df = df.withColumn("v_", value.cast("long"))
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("part_").agg(F.count("*").alias("n_"), F.sum("v_").alias("s_"))
    totals = totals.select("part_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("n_"), F.coalesce(F.sum("s_").over(earlier), F.lit(0)).alias("s_"))
    within = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.select("*", F.row_number().over(within).alias("i_"), F.sum("v_").over(within).alias("u_")).join(totals, "part_")
    return numbered.withColumns({"place_": F.col("n_") + F.col("i_") - 1, "sum_": F.col("s_") + F.col("u_")}).drop("n_", "s_", "i_", "u_", "v_")


def in_order(df: DataFrame, order: list[Column | str], name: str, value: Column | None = None, rows: int = ROWS) -> DataFrame:
    """``df`` with part_, place_ and, for a ``value``, sum_, as ``dealt`` and ``running`` have them."""
    out = running(dealt(df, order, name, rows), order, F.lit(0) if value is None else value)
    return out if value is not None else out.drop("sum_")


def neighbours(df: DataFrame, order: list[Column | str], value: Column) -> DataFrame:
    """Rows that ``dealt`` made, with prev_ and next_: ``value`` of the rows right before and after in the whole order (null at its ends).

    Within a part by a window; at its ends from the last row of the part before and the first of the part after.
    """
    df = df.withColumn("x_", value)
    within, parts = Window.partitionBy("part_").orderBy(*order), Window.orderBy("part_")
    ends = df.groupBy("part_").agg(F.min_by("x_", F.struct(*order)).alias("first_"), F.max_by("x_", F.struct(*order)).alias("last_"))
    ends = ends.select("part_", F.lag("last_").over(parts).alias("before_"), F.lead("first_").over(parts).alias("after_"))
    own = df.select("*", F.lag("x_").over(within).alias("p_"), F.lead("x_").over(within).alias("n_")).join(ends, "part_")
    return own.withColumns({"prev_": F.coalesce("p_", "before_"), "next_": F.coalesce("n_", "after_")}).drop("x_", "p_", "n_", "before_", "after_")


def joined(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], more: dict[str, tuple[Callable, Callable, Column]] | None = None) -> DataFrame:
    """Rows that ``dealt`` made as one row for each of ``keys``: arrays of the ``values`` (nulls left out) in the order of ``order``.

    ``more`` has further aggregates: of a part's rows, of the parts, and of what.

    A key's values of one part are gathered first, then its parts, so no list is longer than a part or has more items
    than there are parts, but for the result itself.
    """
    lists = [F.transform(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(F.col(order).alias("o"), v.alias("v"))))), lambda x: x["v"]).alias(n) for n, v in values.items()]
    per = df.groupBy(*keys, "part_").agg(*lists, *[f(c).alias(n) for n, (f, _, c) in (more or {}).items()])
    whole = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part_", F.col(n).alias("l")))), lambda x: x["l"])).alias(n) for n in values]
    rest = [f(n).alias(n) for n, (_, f, _) in (more or {}).items()]
    return per.groupBy(*keys).agg(*whole, *rest)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path, and the path in it; names of local files are no URIs, so they may hold any character."""
    local = re.match("(?:file:/+|/)(.*)", uri)
    return (fs.LocalFileSystem(), f"/{local[1]}") if local else fs.FileSystem.from_uri(uri)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside; the session's setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)
