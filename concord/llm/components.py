"""Connected components of a distributed set of links.

Links with a null end, and of a node with itself, say nothing and are passed over; links that repeat count once. No links give no nodes. Columns besides src and dst are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_root


def _star(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its least node) of all nodes in links (src, dst: long, in any order).

    Large-star: each node's larger neighbours go to the least of its
    neighbourhood. Small-star: so do its smaller neighbours and itself. Both
    only move links, so a node with many links stays one key of an aggregation
    that combines before it shuffles, and a join that splits skewed keys. Rounds end when the links
    stay as they are, by count and sum of hashes; each is checkpointed in the shared folder.
    """
    spark = links.sparkSession
    scratch_root(spark)
    edges = links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u != v").distinct().checkpoint()
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _star(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = large.checkpoint()
        least = _star(large)
        small = large.join(least, "u")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = moved.checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components took more than {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
