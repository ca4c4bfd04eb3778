"""Connected components by alternating stars, on edges that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import cut


def _towards_least(edges: DataFrame) -> DataFrame:
    """Every ``big`` node is tied to the least of its ``small`` ones, and these to it as well."""
    least = edges.groupBy("big").agg(F.min("small").alias("least"))
    tied = edges.join(least, "big").filter(F.col("small") != F.col("least"))
    return (
        tied.select(F.col("small").alias("big"), F.col("least").alias("small"))
        .union(least.select("big", F.col("least").alias("small")))
        .distinct()
    )


def _away_from_least(edges: DataFrame) -> DataFrame:
    """Of each node, the larger neighbours are tied to its least neighbour or to itself."""
    both = edges.select(F.col("big").alias("node"), F.col("small").alias("other")).union(
        edges.select(F.col("small").alias("node"), F.col("big").alias("other"))
    )
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    return (
        both.join(least, "node")
        .filter(F.col("other") > F.col("node"))
        .select(F.col("other").alias("big"), F.col("least").alias("small"))
        .distinct()
    )


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b), root being the least node reachable.

    Each round is two aggregations and two joins on node ids and is cut from its
    lineage; rounds grow with the logarithm of a component's size. Minima are
    combined before the shuffle and the joins are splittable by adaptive
    execution, so a node with very many neighbours is no single task's load.
    No edges give no rows; loops and repeated edges do no harm.
    """
    stars = (
        edges.filter("a != b")
        .select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small"))
        .distinct()
    )
    seen = None
    while True:
        stars = cut(_towards_least(_away_from_least(stars)))
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    heads = stars.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct()
    return stars.select(F.col("big").alias("node"), F.col("small").alias("root")).union(heads)
