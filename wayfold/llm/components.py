"""Connected components of an undirected graph by repeated contraction, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.session import cut_lineage


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _followed(parents: DataFrame) -> DataFrame:
    """Pointer jumping: (node, parent) with parent < node, to (node, the root above it)."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        # A root has no row of its own, so an unmatched parent is a root.
        jumped = parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        jumped = cut_lineage(jumped, "parents")
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each end of the edges (u, v), with comp the smallest node that it reaches.

    Each round every node points at its smallest neighbour if that is smaller, pointers are followed to their roots (a chain of n nodes takes
    log n jumps), and the edges are drawn again between roots. At most half of the nodes that still have edges are roots, so there are few rounds.
    Hot nodes are only met in aggregations that combine before the shuffle and in joins with one row per node.
    """
    left = cut_lineage(_canonical(edges), "edges")
    found: DataFrame | None = None
    while not left.isEmpty():
        roots = _followed(cut_lineage(left.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent")), "pointing"))
        found = roots if found is None else found.unionByName(roots)
        to = roots.select(F.col("node").alias("end"), F.col("parent").alias("root"))
        moved = left.join(to.withColumnRenamed("end", "u"), "u", "left").select(F.coalesce("root", "u").alias("u"), "v")
        moved = moved.join(to.withColumnRenamed("end", "v"), "v", "left").select("u", F.coalesce("root", "v").alias("v"))
        left = cut_lineage(_canonical(moved), "edges")
    if found is None:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("comp")).limit(0)
    # A node is pointed upwards in one round; a root of that round may be pointed in a later one.
    found = _followed(cut_lineage(found, "pointing"))
    roots = found.select(F.col("parent").alias("node")).distinct()
    return found.select("node", F.col("parent").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))
