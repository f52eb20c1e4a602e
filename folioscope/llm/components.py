"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import materialized

#: Rounds halve the depth of every tree at least; so many cover any graph that can be stored.
MOST_ROUNDS = 200


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for all nodes of ``edges(a, b)``; a component is its smallest node.

    Large star: each node hands its larger neighbours to its smallest one. Small star: each node
    hands its smaller neighbours to its smallest one. Both are an aggregate and a join, and a
    node's neighbours never meet in one task. Every round is written to the shared folder.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = materialized(both, name)
    before = None
    for _ in range(MOST_ROUNDS):
        state = materialized(_small_star(_large_star(state)), name)
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    members = state.groupBy("u").agg(F.min("v").alias("component"))
    roots = state.select(F.col("v").alias("u"), F.col("v").alias("component"))
    return (
        members.unionByName(roots).groupBy("u").agg(F.min("component").alias("component"))
        .withColumnRenamed("u", "node")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v; for every node u all larger neighbours point to u's smallest one."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    out = near.filter("v > u").join(least, "u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).filter("u > v").distinct()
