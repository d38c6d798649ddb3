"""Connected components of a graph given as links, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutewise.llm.common import saved


def _nearest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the lowest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = _nearest(both).select("a", F.least("a", "m").alias("m"))
    return both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its neighbours below are linked to the lowest of them; links point down already."""
    lowest = _nearest(links)
    across = links.join(lowest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label, the lowest node that it reaches, of every node that has a link.

    links: columns a and b of one ordered type, in any direction; links of a node with itself are left out. Alternates
    the two star operations until nothing changes, which takes about as many rounds as the logarithm of the longest
    path. Each round's links are saved, so that a lost executor costs one round. Only a count and a checksum come
    to the driver.
    """
    now = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        now = saved(_small_star(_large_star(now)))
    # Every node is linked to its label now; labels are nodes too.
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
