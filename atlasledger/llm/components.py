"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasledger.session import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours of each node onto the least one; ``edges`` has ``a > b``.

    The least neighbour is an aggregate that combines before its shuffle, and the join back has
    one row per node on one side, so a hub's edges may be split over tasks.
    """
    if large:
        told = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = told.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        out = told.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return (
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a > b")
        .unionByName(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` of every node that has an edge; the component is its least node.

    ``edges`` has two long columns ``a, b``; order, loops, nulls and repeats do not matter. Rounds
    grow with the logarithm of the longest path. Each round is a table in the shared folder.
    """
    now = scratch.save(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a > b")
        .distinct()
    )
    mark = None
    while True:
        found = now.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
        ).first()
        if (found.n, found.x) == mark:
            break
        mark = (found.n, found.x)
        step = scratch.save(_star(_star(now, True), False))
        scratch.drop(now)
        now = step
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
