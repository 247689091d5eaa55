"""Connected components of links, by contraction; nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b) that are not the least of their
    component, ``component`` being the least node reachable.

    Each round hangs every node that has a smaller neighbour under the least
    one, shortens the paths to roots by doubling, and keeps the links between
    different roots. Stars, the shape of near-duplicate groups, end after one.
    """
    edge = F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = staged(links.where("a <> b").select(edge.alias("e")).select("e.u", "e.v").distinct(), "graph-links")
    labels = None
    while True:
        held = parents = staged(edges.groupBy("u").agg(F.min("v").alias("p")), "graph-parents")
        if labels is not None and parents.isEmpty():
            discard(edges, held)
            return labels
        while True:
            up = parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            further = staged(parents.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "graph-parents")
            moved = not further.where("moved").isEmpty()
            discard(held)
            held, parents = further, further.select("u", "p")
            if not moved:
                break
        new = parents.select(F.col("u").alias("node"), F.col("p").alias("component"))
        if labels is not None:
            up = parents.select(F.col("u").alias("component"), "p")
            new = labels.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component")).unionByName(new)
        before, labels = labels, staged(new, "graph-labels")
        if before is not None:
            discard(before)
        of_u = parents.select("u", F.col("p").alias("pu"))
        of_v = parents.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        between = edges.join(of_u, "u").join(of_v, "v", "left").select(F.col("pu").alias("a"), F.coalesce("pv", "v").alias("b")).where("a <> b")
        left = staged(between.select(edge.alias("e")).select("e.u", "e.v").distinct(), "graph-links")
        discard(edges, held)
        edges = left
