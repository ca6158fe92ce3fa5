"""Connected components with alternating large and small stars."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): neighbours are tied to the least of u's neighbourhood. The least is a map-side aggregate."""
    if large:
        near = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = near.join(least, "u")
    if large:
        return tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    own = least.select("u", F.col("m").alias("v"))
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).filter("u != v").distinct()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of every node of (u, v): the component's name is its least node.

    Edges with a null end and loops are ignored. The work stays distributed; each round is checkpointed, and
    only two numbers reach the driver to see whether anything changed. It goes on until nothing does; if ``rounds``
    are given and aren't enough, that is an error.
    """
    now = common.checkpoint(edges.select("u", "v").filter("u is not null and v is not null and u != v").distinct())
    mark = None
    for done in count(1):
        before, now = now, common.checkpoint(_star(_star(now, True), False))
        common.discard(before)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        if done == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
