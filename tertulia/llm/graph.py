"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tertulia.plans.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """Each node of `edges` (columns a and b) that is not the smallest of its component, with that one:
    columns node and root.

    Large-star and small-star steps in turn: a node passes the smallest of its neighbours to its larger
    neighbours, then to its smaller ones, until all point at the smallest. The table of edges never
    grows, no node gathers its neighbours, and the rounds are about the logarithm of the longest path.
    """
    current = stage(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _all_stars(current):
        current = stage(_small_star(_large_star(current)))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node points at one root, and no root points at another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("points")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("points"))
    )
    nodes = ends.groupBy("node").agg(F.sum("points").alias("points"), F.min("points").alias("least"))
    # A node that is pointed at has a row with 0; then it must not point itself.
    unfit = nodes.where((F.col("points") > 1) | ((F.col("points") > 0) & (F.col("least") == 0)))
    return unfit.isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("low"))
    return both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("low"))
    passed = edges.join(lowest, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return passed.unionByName(lowest.select("u", F.col("low").alias("v"))).distinct()
