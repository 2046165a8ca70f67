"""Connected components by alternating large and small stars, as joins and aggregations of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netglean.llm.shared import forget, save


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node but the least of its component to the least one, for local edges (u, v)."""
    if not len(u):
        return u[:0], v[:0]
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        new = new[label]
        if (new == label).all():
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for each node of edges (u, v), longs; root is the least node that edges reach, and has a row too.

    Each round replaces edges by stars around smaller nodes, until each node but the roots has one edge, to a root;
    rounds grow with the logarithm of the longest path. Nulls and loops drop out. A node of very many edges isn't one task's: edges and the least
    neighbours are dealt alike by a second key too, so that adaptive execution may split the edges' large partitions. forget() deletes what the result reads.
    """
    twice = F.xxhash64("u").alias("w")
    edges = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("root")))).alias("e"))
        ends = ends.groupBy("e.n").agg(F.sum("e.up").alias("up"), F.max("e.root").alias("root"))
        if not ends.where("up > 1 OR up = 1 AND root = 1").limit(1).count():
            break
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select("u", "m", twice)
        large = both.where("v > u").select("u", "v", twice).join(least, ["u", "w"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m")).select("u", "m", twice)
        small = large.select("u", "v", twice).join(least, ["u", "w"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = save(small.where("u <> v").distinct(), tag)
        forget(edges)
        edges = new
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out.saved_at = edges.saved_at
    return out
