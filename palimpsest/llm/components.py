"""Connected components of a graph given as an edge table.

Defined cases: an edge with a null end, or from a node to itself, links nothing and names no node; repeated edges count
once, in either direction; no edges give no rows; other columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialised


def _signature(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``, root the least of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step
    replaces edges by edges to the least neighbour, until each component is a star on its least
    node. A node of any degree is handled by partial minima and a join that
    adaptive execution may split, never by gathering its neighbours."""
    edges = materialised(edges.where("a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = _signature(edges)
    while before[0]:
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(
            edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("m != v").select(
            F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.explode(F.array(
            F.struct(F.col("m").alias("a"), F.col("b").alias("b")),
            F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").where("a != b")
        edges = materialised(small.distinct())
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
