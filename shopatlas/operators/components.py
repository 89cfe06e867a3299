"""Connected components of an edge table by alternating star contractions, all in DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``edges`` (a, b long).

    Large-star and small-star steps alternate until nothing changes, which takes a number of
    rounds that grows with the logarithm of the graph.  A round is an aggregation (with partial
    sums before the shuffle) and an equi-join; a node with very many neighbours is a skewed key
    of that join, which Spark splits.  Only nodes that have an edge are moved.  Self-edges and
    repeated edges do no harm; no edges give no rows.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # 128 bits of hashes stand for the set of edges
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # every larger neighbour of a node is tied to the node's smallest neighbour
        edges = both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every node and its smaller neighbours are tied to the smallest of them
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(low.hint("merge"), "a")
        edges = materialise(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
