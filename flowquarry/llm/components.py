"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.session import settle


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge to another.

    Alternates two steps: every node hands its larger neighbours over to its smallest one, then every node hands
    its smaller neighbours over to their smallest one. The number of rounds grows with the logarithm of the longest
    path. Each step is written, so that a lost executor costs one step at most. Nodes are LONGs; NULLs and
    self-loops are left out.
    """
    def oriented(frame: DataFrame) -> DataFrame:
        return frame.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = settle(oriented(edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"))), "edges")
    before = state(current)
    while before[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = settle(oriented(
            both.filter("b > a").join(settle(least, "least"), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(settle(least, "least"), "a")
        current = settle(oriented(
            small.select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(small.select("a", F.col("least").alias("b")))), "small-star")
        after = state(current)
        if after == before:
            break
        before = after
    own = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return own.union(own.select(F.col("component").alias("node"), "component").distinct())
