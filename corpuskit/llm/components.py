"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.session import materialise, temporary_copies


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written, so that the join below may split a node with very many links over tasks.
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "stars")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m")), "stars")
    others = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, of all nodes with a link (bigint ``a``, ``b``).

    Each round is written to the shared folder. Rounds grow with the logarithm of the longest
    path, and a node with very many links is a join key that adaptive execution may split.
    Links of a node to itself and null ends say nothing; without links the result is empty.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = materialise(links.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "links")
    seen = _signature(edges)
    while seen[0]:
        with temporary_copies(links.sparkSession) as kept:
            edges = materialise(_small_star(materialise(_large_star(edges).distinct(), "links")), "links")
            kept.append(edges)
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.withColumn("component", F.col("node")))
