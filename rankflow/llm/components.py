"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.session import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: the neighbours of each node are tied to the least of them.

    Large stars tie the greater neighbours, small stars the others. Only the least neighbour of a node is aggregated,
    before the shuffle as well; a node's neighbours are never gathered.
    """
    ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        ways = ways.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = ways.join(least, "u").where("v > u" if large else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        tied = tied.union(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return tied.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for each node of ``edges`` (``a``, ``b``: longs) that is not its component's least node.

    Every round is written to the shared folder; the rounds grow with the logarithm of the longest path.
    """
    edges = materialize(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        edges = materialize(_stars(materialize(_stars(edges, True), "large-stars"), False), "small-stars")
