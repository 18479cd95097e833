"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stash


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node reachable.

    Each step joins the edges with one row per node, both written tables, so a node with very many
    edges is split by adaptive execution; no neighbourhood is ever collected. Self loops and repeated
    edges are ignored; no edges give no rows. Nothing goes to the driver but a count and a checksum.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    now = stash(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    seen = _sign(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # large star: every larger neighbour moves to the smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-min")
        large = stash(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc-large")
        # small star: every smaller neighbour moves to the smallest of them
        least = stash(large.groupBy("a").agg(F.min("b").alias("m")), "cc-min")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stash(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc-edges")
        last, seen = seen, _sign(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
