"""Small Spark helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine, as in tests, a folder of its own where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
    return where or f"file://{tempfile.gettempdir()}/checkpoints"


#: Folders that the running query may delete once its result is a table; each thread and run has its own list.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes at the latest when the session's driver ends."""
    path = f"{shared_dir(spark)}/loomtab-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def passing(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, deleted with the tables of the running query."""
    path = _folder(spark, name)
    own = _passing.get()
    if own is not None:
        own.append(path)
    return path


def _table(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: cuts the lineage, outlives executors.

    Such tables stay until ``discard``, or until the result of the ``settled`` query that made them is a table itself.
    """
    return _table(df, passing(df.sparkSession, name))


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, as a table that lives as long as the session; everything that was written on the way is deleted, whether it succeeds or not."""
    token = _passing.set([])
    try:
        return _table(make(), _folder(spark, name))
    finally:
        own = _passing.get()
        _passing.reset(token)
        for path in own:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``written`` made and nothing reads any more."""
    path = _paths.pop(df, None)
    if path:
        _delete(df.sparkSession, path)


#: Rows of an Arrow batch; a batch is held by the JVM and by Python, several times over.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows where they are larger: texts are long."""
    now = int(spark.conf.get(_BATCH))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row, however often it is used: a lambda's variable isn't put in place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def id_key(id_col: str) -> Column:
    """The order of a row's id as a long: null is the least (as -2**63, if an id is that); a text that is no whole number, its hash."""
    plain = F.col(f"`{id_col}`")
    return F.coalesce(plain.try_cast("long"), F.when(plain.isNotNull(), F.xxhash64(plain.cast("string"))), F.lit(-(2**63)))


def keyed(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Columns id, text and the key (k, h) of a row: ``id_key`` of its id and a hash of its text.

    Rows that agree in both are copies of one document and get one verdict.
    """
    return df.select(id_key(id_col).alias("k"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *more)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a partition that is sorted and numbered by one task.
ORDER_ROWS = 1_000_000


def in_order(df: DataFrame, rows: int, order: list[Column | str], name: str, running: str | None = None) -> DataFrame:
    """The rows of ``df`` (``rows`` of them), with row: the place, from 0, in the order of the columns ``order``.

    A range exchange sized by the number of rows, a count a partition, and numbers within partitions plus what
    comes before. With ``running``, a column of longs, also before and total: its sum over the rows before, and over all.
    """
    parts = max(1, min(parallelism(df.sparkSession), -(-rows // 1000)), -(-rows // ORDER_ROWS))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)
    value = F.col(running) if running else F.lit(0)
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(value).cast("long").alias("_v"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition, each of up to ORDER_ROWS rows
    totals = totals.select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_v"),
        F.sum("_v").over(Window.partitionBy()).alias("total"),
    )
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.select("*", F.row_number().over(within).alias("_i"), F.sum(value).over(within).cast("long").alias("_upto")).join(totals, "_part")
    placed = placed.withColumn("row", F.col("_n") + F.col("_i") - 1)
    if running:
        return placed.withColumn("before", F.col("_v") + F.col("_upto") - F.col(running)).drop("_part", "_i", "_n", "_v", "_upto")
    return placed.drop("_part", "_i", "_n", "_v", "_upto", "total")
