"""Connected components of a graph of any shape, by small and large stars.

Each step turns every node's neighbourhood into a star around its smallest
member: in the large star step towards larger neighbours, in the small star
step towards smaller ones.  A node's minimum is a partial aggregation and
reaches its links by a join, so the neighbourhood of a hub is never gathered;
a step's links are written, and a later step reads them from shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.shared import written

MAX_ROUNDS = 100


def connect(links: DataFrame) -> DataFrame:
    """``(node, root)`` for all nodes of the links ``(src, dst)``; the root is
    the smallest node reachable, and its own root.  No link: no row."""
    now = written(
        links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        "links",
    )
    before = None
    for _ in range(MAX_ROUNDS):
        now = written(_small_star(written(_large_star(now), "large-star")), "small-star")
        state = _state(now)
        if state == before:
            return _rooted(now)
        before = state
    raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")


def _state(links: DataFrame) -> tuple:
    """Equal after two rounds only if the links are: their number and a sum of
    hashes."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u")).toDF("u", "v")
    low = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("low")), "lows").withColumnRenamed("u", "_u")
    moved = both.where("v > u").join(low, F.col("u") == F.col("_u"))
    return moved.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Here ``v < u`` holds for every link."""
    low = written(links.groupBy("u").agg(F.min("v").alias("low")), "lows").withColumnRenamed("u", "_u")
    moved = links.join(low, F.col("u") == F.col("_u")).select("v", "low")
    kept = low.select(F.col("_u").alias("v"), "low")
    return moved.union(kept).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _rooted(links: DataFrame) -> DataFrame:
    """At the end every node but the roots has one link, to its root."""
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
