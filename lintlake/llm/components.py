"""Connected components of a link table as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_driver, written


def components(links: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, for every node of ``links`` (a, b).

    Alternates two star steps until the edges stay the same.  Large star hangs every larger
    neighbour on a node's smallest neighbour, small star every smaller one; the edges end as
    stars around the component minima.  Each step is one aggregate with map-side combine and
    one join on the node, so a node with very many neighbours is split like any skewed join
    key.  The edges of every round are written to the shared folder; the driver only learns
    whether they are stars already, and keeps nothing of the rounds before.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct(), "edges")
    while not _stars(edges):
        free_driver(edges.sparkSession)
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(
            "v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(
            F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        edges = written(
            joined.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
            .union(least.select("v", F.col("m").alias("u"))).distinct(), "edges")
    free_driver(edges.sparkSession)
    nodes = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return nodes.union(roots).groupBy("node").agg(F.min("component").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Every node hangs on one smaller node, and no node has others hanging on it and hangs itself."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("v").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")),
        F.struct(F.col("u").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("e"))
    counts = ends.groupBy("e.node").agg(F.sum("e.below").alias("below"), F.max("e.above").alias("above"))
    return counts.where("below > 1 or (below = 1 and above = 1)").isEmpty()
