"""Connected components by alternating stars: every node points at the smallest neighbour it knows of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import kept


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """`edges` has columns u and v (long). Returns node and root, the smallest node reachable, for each node of an edge
    between two different nodes. Nulls and loops are dropped; repeated edges count once; no edges give no rows.

    Each step is a minimum per node, joined back: a node of many edges is combined before the shuffle, and what is
    joined for it can be split. The number of steps grows with the logarithm of the nodes.
    """
    edges = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(larger.distinct())
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        smaller = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        was, mark = mark, _mark(edges)
        if mark == was:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
