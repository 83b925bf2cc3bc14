"""Joins of events by time: within a distance, and with the nearest one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ROWS, dealt


def within(left: DataFrame, right: DataFrame, key: str, time: str, microseconds: int) -> DataFrame:
    """Rows of ``left`` with l_ and of ``right`` with r_ before their columns, for pairs of one key whose times are at most so far apart.

    Times are cut into bins of that length; a left row meets the right rows of three bins by equal key and bin, and
    the distance is checked then. A key with many rows is as many groups as its bins. Null keys and times meet nothing.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    side = lambda df, s: df.select(*[F.col(f"`{c}`").alias(f"{s}_{c}") for c in df.columns], F.col(key).alias("key_"), at.alias(f"{s}at_"))
    bin_ = lambda c: F.expr(f"floor({c} / {microseconds}L)")
    first = side(left, "l").withColumn("bin_", bin_("lat_"))
    second = side(right, "r").withColumn("bin_", F.explode(F.sequence(bin_("rat_") - 1, bin_("rat_") + 1)))
    return first.join(second, ["key_", "bin_"]).where(F.abs(F.col("lat_") - F.col("rat_")) <= microseconds).drop("key_", "bin_", "lat_", "rat_")


def latest_before(left: DataFrame, right: DataFrame, key: str, time: str, order: str, value: str, rows: int = ROWS) -> DataFrame:
    """``left`` with before_: ``value`` of the last row of ``right`` of the same key whose time is not later; of equal times the one of greatest ``order``.

    Both are dealt in one order over parts; what is the last right row is carried through a part by a window and from
    part to part, one row a part, so a key's rows need no single task. Null keys meet nothing, nor null times.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row_")
    known = F.struct(F.col(key).alias("k"), F.col(value).alias("v")).alias("x_")
    second = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key_"), F.col(time).alias("time_"), F.lit(0).alias("side_"), F.col(order).alias("order_"), known)
    first = left.select(F.col(key).alias("key_"), F.col(time).alias("time_"), F.lit(1).alias("side_"), F.col(order).alias("order_"), own)
    by = ["key_", "time_", "side_", "order_"]
    both = dealt(first.unionByName(second, allowMissingColumns=True), by, "latest", rows)
    upto = Window.partitionBy("part_").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    parts = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("part_").agg(F.max_by("x_", F.when(F.col("x_").isNotNull(), F.struct(*by))).alias("end_"))
    carried = ends.select("part_", F.last("end_", ignorenulls=True).over(parts).alias("carried_"))
    found = both.select("*", F.last("x_", ignorenulls=True).over(upto).alias("own_")).join(carried, "part_")
    last = F.coalesce("own_", "carried_")
    return found.where("side_ = 1").select("row_.*", F.when((last["k"] == F.col("key_")) & F.col("time_").isNotNull(), last["v"]).alias("before_"))
