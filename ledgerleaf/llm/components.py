"""Connected components of an edge list, by alternating large-star and small-star steps.

Each step is a few joins and aggregations on the edges, so no vertex list, component or link ever reaches the driver;
it only sees a row count and a checksum that tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links -> (node, root): each linked node with the least node reachable from it.

    Both columns are long and hold no nulls. Self links and repeated links are harmless; nodes without any link to
    another node are absent. A node with very many links only makes one side of an equi-join large, which Spark's
    adaptive skew join splits; the other side has one row for each node.
    """
    big, small = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = cut(edges.where("u <> v").select(big, small).distinct())
    before = _state(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        edges = cut(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
