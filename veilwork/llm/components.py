"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one centre at most and no centre has one itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("centre"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("centre")))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("centre").alias("centre"))
    return seen.filter("out > 1 OR (out = 1 AND centre = 1)").isEmpty()


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for each node of ``links`` (u, v); the component is its smallest node.

    Smallest neighbours are found by aggregation with map-side combine and joined back, so the
    neighbours of one node are never gathered in one place.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        edges = materialise(small.filter("u <> v").distinct())
        if _settled(edges):
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
