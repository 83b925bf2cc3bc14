"""Contiguous shards of near equal bytes from global prefix sums.

Rows are put in order of id (then checksum and size) by a range exchange and
written once with the number of their partition; partitions are as many as the
rows ask for. Per-partition totals, a few numbers each, become offsets; a row's
global byte position is its running sum within the partition plus the
partition's offset. A row goes to the shard in
which its middle byte falls when all bytes are cut into equal lengths, so
shards are contiguous in id order and each cut is off its target by at most
one row's size. Law ``bytes``: copies of a text are not kept together, as one
group of copies may be larger than a shard.

Nothing but ids, sizes and checksums is shuffled. Rows: a null text has size 1
(no bytes, plus 1) and checksum 0, as an empty text has; null ids come first;
rows that agree in id, size and checksum are interchangeable and each gets a
slot of its own; one row larger than a shard's target leaves shards empty; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import in_order, table, written

SHARDS = 8


def assign_shards(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, size, text_crc32, shard (int) and slot (long, gapless from 0 in each shard)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    order = ["id", "text_crc32", "size"]
    placed = in_order(rows, df.count(), order, "shard-sizes", "size")
    # twice the place of a row's middle byte, by twice the total: whole numbers, exact at any size
    placed = written(
        placed.select(
            "id", "size", "text_crc32", "row",
            F.least(F.expr(f"((2 * before + size) * {shards}L) div (2 * total)"), F.lit(shards - 1)).cast("int").alias("shard"),
        ), "shards",
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most one row a shard
    return placed.join(F.broadcast(firsts), "shard").select("id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign_shards(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op5_sharding": op5_sharding}
ORACLES: dict[str, str] = {}
