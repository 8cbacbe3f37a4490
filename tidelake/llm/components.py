"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.session import written


def _smallest(pairs: DataFrame) -> DataFrame:
    """The smallest v of every u, written so that a join on a hot u can be split."""
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")), "smallest")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both)
    out = both.filter("v > u").join(least, "u").select(
        F.col("v").alias("u"), F.least("m", "u").alias("v")
    )
    return written(out.distinct(), "large-star")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest of them."""
    least = _smallest(edges)
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), "m")
    out = moved.union(least).select("u", F.col("m").alias("v")).distinct()
    return written(out, "small-star")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge: root is the smallest node reachable.

    ``edges`` holds (u, v) of one integer type. Large-star and small-star rounds alternate until
    every edge points at its root; the number of rounds grows with the logarithm of the longest
    path. Every round is a table in the shared folder: no lineage grows and nothing is collected
    but two numbers. Loops, repeated and NULL edges are ignored; no edges give no rows.
    """
    edges = edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges, seen = written(edges.distinct(), "edges"), None
    for _ in range(max_rounds):
        state = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).collect()[0]
        if state == seen or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
        edges = _small_star(_large_star(edges))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
