"""Connected components of links, as tables: no component ever meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.functions.tables import Scratch, stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links`` (a, b): the smallest node that links reach.

    Rounds of two steps.  Every node hands its larger neighbours to its smallest neighbour, then its smaller ones; both keep the
    components and flatten them to stars within a number of rounds that grows with the logarithm of the longest chain.  A node with very many links
    is a hot key only on the side of its links; its smallest neighbour is one row.
    """
    scratch = Scratch(links.sparkSession)
    pairs = links.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    nodes = scratch.stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    edges = scratch.stored(pairs.where("a < b").distinct(), "links")
    while True:
        grown = scratch.stored(_towards_least(edges, larger=True), "links")
        small = scratch.stored(_towards_least(grown, larger=False), "links")
        changed = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        edges = small
        if changed:
            break
    # stars: every node but the least hangs on the least
    out = stored(nodes.join(edges.select(F.col("b").alias("node"), "a"), "node", "left").select("node", F.coalesce("a", "node").alias("component")), "components")
    scratch.close()
    return out


def _towards_least(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node's larger (or smaller) neighbours, and itself, linked to the least of the node and its neighbours."""
    if larger:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        seen = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = seen.join(least, "u")
    if larger:
        moved = met.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        moved = met.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.where("a <> b").distinct()
