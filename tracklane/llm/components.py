"""Connected components of a table of links, by rounds of large-star and small-star joins.

Each round moves every link towards the smallest id its ends have seen; the rounds end when nothing changes,
after about the logarithm of the longest path. Only a count and a checksum reach the driver; each round is
written as a table in the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.session import settle


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest id reachable) for each end of a link (``a``, ``b``), nulls left out."""
    now = settle(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _state(now)
    while True:
        after = settle(_small_star(_large_star(now)))
        next_state = _state(after)
        if next_state == state:
            break
        now, state = after, next_state
    roots = after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to its smallest neighbour or itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))  # node a has neighbour b
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. Links run from larger a to b."""
    smallest = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(smallest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smallest.select("a", F.col("m").alias("b")).unionByName(others).distinct()
