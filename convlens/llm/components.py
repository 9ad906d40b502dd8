"""Connected components of a table of links, by large-star and small-star steps.

Each step is an aggregation and a join on node ids; every step's links are
written to the shared folder, so the lineage stays one step long. No node's links are gathered in
one task: a step only needs the smallest neighbour of a node, which is a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.sources.staging import stage


def _towards(links: DataFrame) -> DataFrame:
    """Links from the larger to the smaller id, each once."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return links.where(F.col("a") != F.col("b")).select(high.alias("a"), low.alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node, and the node, link to the smallest of node and neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, link to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _finished(links: DataFrame) -> bool:
    """Does every node link to one root, and no root to another?"""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """links: a, b of any ordered type. Returns a, b: every linked node but the smallest of its
    component, with that smallest node."""
    current = stage(_towards(links), label)
    while not _finished(current):
        current = stage(_towards(_small_star(_large_star(current).distinct())), label)
    return current
