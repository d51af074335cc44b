"""Connected components of a table of links, by alternating stars.

Each round points every node's neighbours at the smallest of them, first the larger neighbours and then the
smaller ones, so paths shorten to stars in a number of rounds that grows with the logarithm of their length; it ends
as soon as all edges form stars.
A node's smallest neighbour is an aggregate that is written before it is joined back to the node's links, so that both
sides of the join are plain exchanges: the partition of a node with very many links is then one that adaptive execution
splits. (It leaves a join alone whose one side was aggregated on the same key within the query.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.session import drop, saved, scratch, tidy_shuffles


def are_stars(edges: DataFrame) -> bool:
    """Whether every u of the distinct edges (u, v), u > v, has one v only, and no v is also a u; then v is its root."""
    ends = edges.selectExpr("u AS node", "1 AS up", "0 AS down").union(edges.selectExpr("v", "0", "1"))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
    return odd.isEmpty()


def pointed(links: DataFrame, least: DataFrame) -> DataFrame:
    """links (u, v) with the m of each u; least is a saved table."""
    return links.join(least, "u")


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of links(a, b), root being the smallest node that it reaches.

    Links are undirected and may repeat; links with a null end or from a node to itself count for nothing.
    Every round is written to the shared folder, so a lost executor costs a round at most.
    """
    spark = links.sparkSession
    folder, n = scratch(spark, "components"), 0
    with tidy_shuffles(spark):
        ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        edges = saved(ends.distinct(), f"{folder}/{n}")
        while not are_stars(edges):
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{folder}/{n}-least")
            large = pointed(both, least).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = saved(large.where("u != v").distinct(), f"{folder}/{n}-large")
            least = saved(large.groupBy("u").agg(F.min("v").alias("m")), f"{folder}/{n}-smallest")
            small = pointed(large, least).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            edges = saved(small.select("e.u", "e.v").where("u != v").distinct(), f"{folder}/{n + 1}")
            drop(spark, *(f"{folder}/{n}{part}" for part in ("", "-least", "-large", "-smallest")))
            n += 1
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
