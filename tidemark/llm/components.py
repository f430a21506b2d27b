"""Connected components of an edge table by alternating star contraction, on the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def min_label(near: np.ndarray) -> np.ndarray:
    """Labels (smallest index reachable) of a small symmetric boolean matrix."""
    n = len(near)
    labels = np.arange(n)
    rows = np.flatnonzero(near.sum(1) > 1)
    if not len(rows):
        return labels
    part = near[np.ix_(rows, rows)]
    own = rows.copy()
    while True:
        new = np.where(part, own[None, :], n).min(1)
        if (new == own).all():
            break
        own = new
    labels[rows] = own
    return labels


def forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least labels after the pairs (a, b) are joined."""
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def merge(members: DataFrame) -> DataFrame:
    """(node, part) -> (node, root): parts that share a node are one component.

    A node lies in few parts and a part may hold any number of nodes, so only the graph of parts, in which each
    edge is a part and the least part that shares a node with it, goes through the iterations. Edges are
    partly aggregated before each exchange.
    """
    members = cut(members)
    least = members.groupBy("node").agg(F.min("part").alias("low"))
    edges = members.join(least, "node").where("part <> low").select(F.col("part").alias("u"), F.col("low").alias("v")).distinct()
    roots = contract(edges)
    return (
        members.join(roots.withColumnRenamed("u", "part"), "part", "left")
        .select("node", F.coalesce("root", "part").alias("root"))
        .groupBy("node").agg(F.min("root").alias("root"))
    )


def contract(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, root) for every u that is not its component's least vertex."""
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return e.select("u", F.col("v").alias("root"))
        mark = now
        both = e.union(e.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = cut(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(low, "u")
        e = cut(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).distinct())
