"""Connected components of an edge table, by large and small stars, each round written to the shared folder."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """edges (a, b) in any order, loops and repeats allowed -> (node, label), label the smallest node reachable.

    Nodes without an edge to another node are not returned. A large star hangs the larger neighbours of
    a node on its smallest one, a small star the smaller ones; rounds end when the edges stay the same.
    Minima are pre-aggregated, and a hub is one key only in joins that Spark can split.
    """
    edges = space.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        large = edges.join(least, F.col("b") == F.col("u")).select("a", F.least("b", "m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a > b").distinct()
        old, edges = edges, space.keep(small)
        before, state = state, _state(edges)
        space.drop(old)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a").cast("decimal(20,0)") - F.col("b"))).first())
