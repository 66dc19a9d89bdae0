"""Distributed union-find over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.session import cut


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``links``; ``component`` is the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour (a partial aggregation, so a hub costs one row per
    task), doubles the pointers until they rest on local minima, and contracts the links onto those. At least half
    of the nodes that still have links go in each round: a star or a sorted chain ends in one. Every step is
    checkpointed. Links with a null end are ignored; no links give an empty result.
    """
    edges = links.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("p")))
        while True:
            up = hook.select(F.col("n").alias("p"), F.col("p").alias("pp"))
            hook = cut(hook.select("n", "p").join(up, "p", "left").select("n", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")))
            if hook.where("moved").isEmpty():
                break
        if labels is None:
            labels = hook.select(F.col("n").alias("node"), F.col("p").alias("component"))
        else:
            step = hook.select(F.col("n").alias("component"), F.col("p").alias("q"))
            labels = labels.join(step, "component", "left").select("node", F.coalesce("q", "component").alias("component"))
        labels = cut(labels)
        for end in ("a", "b"):
            edges = edges.join(hook.select(F.col("n").alias(end), F.col("p").alias(f"p{end}")), end)
        edges = edges.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = cut(edges.distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
