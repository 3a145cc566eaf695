"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable from each node of the undirected edges; nodes must be orderable.

    Alternating large-star and small-star steps: each step points the larger neighbours (then the smaller ones) of a
    node at the least node of its neighbourhood. The number of edges never grows, the number of rounds is about
    log^2 of the nodes, and each round is written out, so that a lost executor costs one round at most. The neighbours
    of a node are never collected: its least neighbour is an aggregate that is joined back, and adaptive execution
    splits the rows of a node with very many.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nb = both if large else both.where("b < a")
        least = nb.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        j = nb.join(least, "a")
        out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else j.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("a <> m").select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    e = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        e = materialize(star(star(e, True), False), "star")
        h = F.xxhash64("a", "b").cast("decimal(38,0)")
        now = e.agg(F.count("*"), F.sum(h), F.min("a"), F.max("b")).first()
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = now
