"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshloom.llm.common import Scratch


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """node, root for every node of a link, where root is the least node that it reaches.

    Nodes are longs. Each step is a partial aggregation and a join, so a node with very many
    links is combined before the shuffle and split by adaptive skew handling after it; each
    round ends in a written table. Self-links and repeated links change nothing; an empty table
    has no rows. The number of rounds grows with the logarithm of the longest chain; more than
    ``rounds`` of them, which no chain of longs can need, are an error.
    """
    scratch = Scratch(links.sparkSession, "components")
    u, v = F.col("u"), F.col("v")

    def stars(edges: DataFrame) -> DataFrame:
        """edges: u > v. Large star: every larger neighbour to the least of the neighbourhood."""
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u > v)
        own = least.where(u > F.col("m")).select("u", F.col("m").alias("v"))
        edges = large.unionByName(own).distinct()
        # Small star: smaller neighbours and the node itself to the least of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").where(v > F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    def mark(edges: DataFrame):
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = scratch.put(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(), "links")
    last = mark(edges)
    for _ in range(rounds if last[0] else 0):
        newer = scratch.put(stars(edges), "stars")
        scratch.drop(edges)
        edges, now = newer, mark(newer)
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError(f"components: not settled after {rounds} rounds")
    return edges.select(u.alias("node"), v.alias("root")).unionByName(edges.select(v.alias("node"), v.alias("root")).distinct())
