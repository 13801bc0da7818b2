"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthgrid.llm.common import materialize


def _signature(edges: DataFrame) -> tuple:
    """Edge count and an order-free checksum."""
    folded = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(folded)).first())


def components(links: DataFrame) -> DataFrame:
    """``links``: u, v (bigint). One row (node, component) for each linked node; component is the smallest node.

    Each step is an aggregate for the smallest neighbour and a join with it, so a node with very many
    links is neither collected nor kept in one task. Rounds grow with the logarithm of the longest chain.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        # Every edge now points from a node to a smaller one.
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.toDF("u", "v"))
        edges = materialize(small.where("u <> v").distinct(), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(roots)
