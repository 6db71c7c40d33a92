"""Connected components by alternating large-star and small-star rounds, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the (a, b) pairs, as a written table; a component is named by its smallest node.

    In a round, each node's larger neighbours are linked to the smallest of its neighbourhood, then each node and its
    smaller neighbours to the smallest of those. Minima are aggregated before they are joined back, so a node
    with very many neighbours is never gathered in one place. The rounds end when the links no longer change.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    nodes = pairs.where("u = v").select("u")
    with Scratch(links.sparkSession) as scratch:
        edges, mark = scratch.stored(pairs.where("u <> v").distinct(), "edges"), None
        while True:
            seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
            if (seen["n"], seen["h"]) == mark or not seen["n"]:
                break
            mark = (seen["n"], seen["h"])
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            last, edges = edges, scratch.stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
            scratch.free(last)
        roots = edges.select(F.col("v").alias("u")).unionByName(nodes).distinct().join(edges.select("u"), "u", "left_anti")
        found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("component")))
        return stored(found, "components")
