"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest of the node and its neighbours."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of these. edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lifted = edges.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lifted.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, most: int = 64) -> DataFrame:
    """(node, component): each node that has an edge (u, v) and the smallest node it reaches.

    Rounds go on until the edges, stars then, no longer change; each round is written to the shared folder and the
    one before is dropped. Hot nodes cost no unbounded group: every step is a minimum, which is combined before the
    shuffle, and an equi-join whose skewed side the adaptive plan can split."""
    now = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(most):
        large = scratch.write(_large_star(now))
        new = scratch.write(_small_star(large))
        scratch.drop(large)
        scratch.drop(now)
        now = new
        r = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (found := (r[0], r[1])) == mark:
            break
        mark = found
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
