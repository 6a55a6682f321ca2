"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import cut, drop_table, table


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` has two columns of one orderable type, the ends of undirected links.

    Returns ``node, component`` for every node that has a link to another, where
    ``component`` is the smallest node reachable. Loops, repeated and null ends are
    ignored. Each round is aggregations and equi-joins only: a hub with many
    neighbours is pre-aggregated to its minimum, and the minima are written as a table, so
    that Spark broadcasts them if they are small and else can split the hub's join partition.
    The number of rounds grows with the logarithm of the longest chain.
    """
    a, b = edges.columns
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    stars = cut(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(stars)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = cut(both.where("v > u").join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        second = table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(second, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(small.union(second.select("u", F.col("m").alias("v"))).distinct())
        drop_table(first)
        drop_table(second)
        now = _state(stars)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
