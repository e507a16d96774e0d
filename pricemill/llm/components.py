"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.session import staged


def components(edges: DataFrame) -> DataFrame:
    """Label every node of `edges` (a, b: long) with the smallest node it can reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round points nodes at
    the smallest neighbour, the minimum being aggregated before the shuffle, and rewrites the edges
    to it. The number of edges never grows and a few rounds are enough also for long chains. Each
    round is a written table, so neither plans nor lineage grow. Loops and repeated edges are allowed;
    edges with a null end are ignored. Returns (node, label) for the nodes that have an edge to another node.
    """
    current = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    state = _state(current)
    while state[0]:
        current = staged(_small_star(_large_star(current)), "edges")
        after = _state(current)
        if after == state and _is_star(current):
            break
        state = after
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    # each larger neighbour of a node is tied to the node's minimum
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and sums: unchanged over a round only when the edges are."""
    row = edges.agg(
        F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def _is_star(edges: DataFrame) -> bool:
    """Every node hangs on one root, and no root hangs on another node."""
    roots = edges.select(F.col("b").alias("a")).distinct()
    return edges.join(roots, "a", "left_semi").isEmpty()
