"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step moves links towards the smallest node of their neighbourhood (Kiveris et al. 2014). Only nodes
with links take part. A step is one aggregate and one join on a node; a node with very many links is
first reduced on the map side, and the join against it can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.llm.common import settled


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links of every node's larger (or smaller) neighbours to the least of its neighbourhood."""
    both = links.select("a", "b") if not large else links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("node"))
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def roots(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``; root is the least node that it reaches.

    Links may repeat, point either way or join a node to itself (ignored); null ends are ignored.
    """
    now = settled(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = None
    while True:
        # done when every link leads from a node with no other link to a root
        n, nodes, sums = now.agg(F.count("*"), F.count_distinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n == nodes and (n, sums) == before):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (n, sums)
        now = settled(_star(_star(now, large=True), large=False))
