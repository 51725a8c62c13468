"""Connected components by hooking and pointer jumping, as joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of ``n`` items reaches over links ``a - b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _rested(parent: DataFrame, label: str) -> DataFrame:
    """``a, p`` with every pointer moved on until it rests at a node that has none; two jumps a table."""
    while True:
        up = lambda i: parent.select(F.col("a").alias(f"_a{i}"), F.col("p").alias(f"_p{i}"))  # noqa: E731, B023
        once = parent.join(up(1), F.col("p") == F.col("_a1"), "left").join(up(2), F.col("_p1") == F.col("_a2"), "left")
        parent = staged(once.select("a", F.coalesce("_p2", "_p1", "p").alias("p"), F.col("_p2").isNotNull().alias("moved")), label)
        if parent.filter("moved").isEmpty():
            return parent.select("a", "p")


def forest(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` that isn't the smallest of its component.

    Each round hooks every node on its smallest smaller neighbour (a partial
    aggregate, so a hub costs no more than its tasks' minima), jumps pointers
    until they rest at roots, and contracts the edges; at least all nodes but
    the local minima leave in each round. A node leaves once, so the rounds'
    pointers together are a forest, which is jumped through at the end.
    Tables of a round are written to the shared folder; nothing passes the
    driver but whether one is empty.
    """
    ordered = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    left = staged(ordered(edges), "cc-edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        hooks = staged(left.groupBy("a").agg(F.min("b").alias("p")), "cc-hooks")
        parent = _rested(hooks, "cc-jumps")
        rounds.append(parent)
        to = lambda c, df: df.join(parent.select(F.col("a").alias("_a"), F.col("p").alias("_p")), F.col(c) == F.col("_a"), "left").withColumn(c, F.coalesce("_p", c)).drop("_a", "_p")  # noqa: E731, B023
        # an edge that its first end has hooked along is done before the join by "b", where hubs stand
        half = to("a", left).filter("a <> b").select("a", "b").distinct()
        left = staged(ordered(to("b", half)), "cc-edges")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    found = _rested(staged(found, "cc-forest"), "cc-jumps") if len(rounds) > 1 else found
    return found.select(F.col("a").alias("node"), F.col("p").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``: the smallest node it reaches."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = forest(edges).withColumnRenamed("node", "_node")
    return nodes.join(found, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("root", "node").alias("root"))
