"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMBERS, cut, join_hot


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(edges: DataFrame, rows: int) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge; edges: (u, v) longs, at most `rows`.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every step is an
    aggregation and an equi-join, and the edges never outgrow the input. Rounds are few, as
    they grow with the logarithm of a component's size. Each round is cut to the shared
    checkpoint folder. Only a count and a checksum reach the driver. No edges: no rows.
    """
    edges = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows)
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = 2 * before[0]
        # A hub may have a third of all edges: its rows are joined where they are.
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias(MEMBERS)).select("u", F.least("u", "m").alias("m"), MEMBERS)
        large = join_hot(both, least, ["u"], n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias(MEMBERS))
        linked = join_hot(large, least, ["u"], n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = least.drop(MEMBERS)
        small = linked.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, 2 * before[0])
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
