"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, parallelism, written

ROWS = 500_000  # links that one task writes


def connected_components(links: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """Columns node and root (the least node reachable) for every node of ``links`` (columns u, v: long).

    Alternating large-star and small-star steps: every step rewires each node
    to the least neighbour it knows, so the number of links never grows and a
    chain of length n needs about log n rounds. The links of a round are a
    table in the shared folder, not a lineage. Loops are ignored; a node
    without links isn't in the result. The least neighbour is a pre-aggregated
    minimum, and a table before the hub's neighbours are joined with it: of a
    join of two plain tables, adaptive execution splits a hot hub.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    def kept(e: DataFrame, rows: int) -> DataFrame:
        # the number of links never grows, so its last count bounds what a few tasks would have to write
        return written(e.coalesce(rows // ROWS + 1) if rows // ROWS < parallelism(e.sparkSession) else e, name)

    # v < u from here on: each node points at smaller ones
    edges = written(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name
    )
    before = digest(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = kept(least(both).withColumn("m", F.least("u", "m")), 2 * before[0])
        large = both.join(nearest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(least(large), "u")
        last, edges = edges, kept(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct(), before[0]
        )
        discard(last)
        discard(nearest)
        after = digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
