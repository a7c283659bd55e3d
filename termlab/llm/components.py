"""Connected components of a link table, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlab.sources.tables import stage


def components(links: DataFrame) -> DataFrame:
    """``node, component``: each node of ``links`` (BIGINT ``a, b``) with the smallest node it reaches.

    Links may repeat and may join a node to itself.  A round turns every node to the
    smallest of its neighbourhood, first among the larger neighbours and then among the
    smaller ones, which keeps what is connected connected; rounds grow with the
    logarithm of the largest distance.  Each round is staged in the shared folder, and
    only the two totals that tell whether it changed anything come to the driver.
    A node with very many neighbours is reduced by partial aggregates; its minimum is
    joined back, so no task holds a neighbourhood.
    """
    edges = stage(
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    state = None
    while True:
        # Larger neighbours of u go to the smallest of u and all its neighbours.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = _to_minimum(both, larger=True)
        # Then u and its smaller neighbours go to the smallest of them.
        edges = stage(_to_minimum(edges, larger=False), "star")
        new = edges.agg(F.count("*"), F.expr("sum(cast(u as decimal(38)) * 3 + v)")).first()
        if new == state:
            break
        state = new
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(roots)


def _to_minimum(edges: DataFrame, larger: bool) -> DataFrame:
    """Re-hang each v that is larger (or smaller) than its u on the smallest of u's neighbourhood."""
    lowest = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = edges.join(lowest, "u")
    if larger:
        moved = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = lowest.where("m != u").select("u", F.col("m").alias("v"))
        moved = hung.where("v < u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)
    return moved.where("u != v").distinct()
