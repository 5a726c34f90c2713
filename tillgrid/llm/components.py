"""Connected components of a distributed edge list, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of ``edges`` (``a``, ``b``: long).

    Alternating stars: each node first hands its larger neighbours to the
    smallest neighbour, then its smaller ones, until the edge list is a
    forest of stars. Each half round is one partially aggregated minimum and
    one join that adaptive execution may split, so a node with very many
    edges never gathers them in one task. Rounds grow with the logarithm of
    the longest path; each is cut by a written table, and the tables before it are removed.
    They end when every node has one edge, to a centre without an edge to a smaller one. Nulls and self loops
    are left out; repeated edges count once. No edges give no rows.
    """
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = stars.union(stars.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = both.join(low.select("a", F.least("a", "low").alias("low")), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        before, large = stars, cut(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        pairs = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a"), F.col("low").alias("b"))))
        stars = cut(large.join(low, "a").select(pairs.alias("e")).select("e.a", "e.b").where("a <> b").distinct(), "edges")
        remove(before, large)
        held, nodes = stars.agg(F.count("*"), F.count_distinct("a")).first()
        centres = stars.select("b").distinct()
        if held == nodes and stars.join(centres.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            roots = centres.select(F.col("b").alias("node"), F.col("b").alias("component"))
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
