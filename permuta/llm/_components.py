"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permuta.llm._store import Scratch


def _is_done(edges: DataFrame) -> bool:
    """Whether the edges u -> v are stars: one edge from each u, and no v that has an edge itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or out > 0 and in > 0").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str = "star") -> DataFrame:
    """(id, component) for every id in ``edges`` (a long, b long): the smallest id it reaches.

    Both steps keep the components; they end in stars around the smallest ids after a number of rounds
    that grows with the logarithm of the largest component.  Each round is a written table, no link
    comes to the driver.
    """
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur, step = scratch.keep(cur, f"{name}0"), 0
    while not _is_done(cur):
        step += 1
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours move to the smallest of the neighbourhood.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours and the node itself move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        cur = scratch.keep(small, f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def local_components(n: int, i, j):
    """Smallest reachable number of each of 0..n-1 along the links i-j, inside one task's block."""
    import numpy as np

    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
