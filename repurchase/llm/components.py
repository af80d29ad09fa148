"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another and is not the
    smallest of its component; root is that smallest node.

    ``edges`` holds node pairs in any order; repeated ones and loops count
    once or not at all. Each round points every node at the least neighbour
    of its neighbour, then all neighbours of a node at its least one; rounds
    are stored, so a lost executor re-reads files. Aggregates and joins only,
    with both join sides shuffled plainly, so Spark may split a hub's rows.
    """
    big, small = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    edges = stash(edges.where(F.col(a) != F.col(b)).select(big, small).distinct(), "edges")
    while True:
        least = stash(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        deep = edges.join(least.select(F.col("a").alias("b"), "m"), "b", "left")
        state = deep.agg(F.count("m").alias("deep"), F.count(F.lit(1)).alias("n")).first()
        if not state["deep"] and state["n"] == least.count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = stash(deep.select("a", F.coalesce("m", "b").alias("b")).distinct(), "edges")
        least = stash(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        onto = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stash(least.select("a", F.col("m").alias("b")).unionByName(onto).distinct(), "edges")
