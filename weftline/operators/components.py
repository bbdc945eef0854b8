"""Connected components by hooking, pointer jumping and contraction; stars, never pairs of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut


def star_edges(members: DataFrame, group: list[str], node: str) -> DataFrame:
    """Distinct (a, b), a < b: from each group's smallest node to its others."""
    root = members.groupBy(*group).agg(F.min(node).alias("a"), F.max(node).alias("z")).where("a < z").drop("z")
    return members.join(root, group).where(F.col(node) > F.col("a")).select("a", F.col(node).alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (a, b); the component is its smallest node.

    Each round hooks every node to its smallest neighbour, jumps pointers to the roots and contracts the edges, so
    the rounds are logarithmic in the longest chain. All is written to the shared folder between rounds.
    """
    edges = cut(edges.where("a != b"), "edges")
    labels: DataFrame | None = None
    while not edges.isEmpty():  # each round at least halves the nodes of every component that is left
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        parents = cut(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("parent")), "parents")
        while True:
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = cut(parents.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "parents")
            parents = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        roots = parents.withColumnRenamed("parent", "root")
        if labels is None:
            labels = roots.select("node", F.col("root").alias("component"))
        else:
            labels = labels.join(roots.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        labels = cut(labels, "labels")
        ends = edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = cut(ends.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
