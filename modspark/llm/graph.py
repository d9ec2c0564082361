"""Connected components of an edge table by alternating large-star and
small-star steps: every step is a grouped minimum and a join, no task ever
holds a component, and hub nodes only meet map-side combined minima and
skew-splittable joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _hang(pairs: DataFrame) -> DataFrame:
    """(u, v) neighbour rows -> edges from every v (and u) to min(u, N(u))."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return pairs.join(low, "u")


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """``edges`` (a, b) longs -> (node, root) with root the smallest node of
    the component; nodes without edges are not listed."""
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    for _ in range(max_steps):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        large = _hang(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        e = large.filter("a <> b").distinct()
        down = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        hung = _hang(down)
        small = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(hung.select(F.col("u"), F.col("m")))
        e = stored(small.filter("a <> b").distinct(), "cc")
        # converged when no node that is a root has a parent and the edges stay
        now = e.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if tuple(now) == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                e.select(F.col("b"), F.col("b")).distinct()
            )
        before = tuple(now)
    raise RuntimeError("components did not settle")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, its component's smallest node), one fewer than nodes per
    component, with the connectivity of the edges (a, b) given."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        while True:
            jumped = after[after]
            if np.array_equal(jumped, after):
                break
            after = jumped
        if np.array_equal(after, label):
            break
        label = after
    kept = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[kept], nodes[label[kept]]
