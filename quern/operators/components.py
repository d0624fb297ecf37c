"""Connected components by alternating large-star and small-star steps over plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.state import cut, forget


def _starred(edges: DataFrame, centre: str, leaf: str) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with the least neighbour m of u, itself included; and the table of the minima.

    The minima are written before the join, so that both sides are plain and a node with very many
    neighbours can be split over tasks.
    """
    pairs = edges.select(F.col(centre).alias("u"), F.col(leaf).alias("v"))
    least = cut(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return pairs.join(least, "u"), least


def _is_forest(e: DataFrame) -> bool:
    """Whether every node hangs on one node, which hangs on none: then the components are found."""
    ends = e.select(F.col("a").alias("node"), F.col("b"), F.lit(1).alias("hangs")).unionByName(e.select(F.col("b").alias("node"), F.lit(None).cast("bigint").alias("b"), F.lit(0).alias("hangs")))
    odd = ends.groupBy("node").agg(F.min("b").alias("x"), F.max("b").alias("y"), F.min("hangs").alias("lo"), F.max("hangs").alias("hi")).filter("x <> y or lo <> hi")
    return odd.limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: for every node of ``edges (u, v)`` the least node it is connected with.

    Nodes are longs. Loops and repeated edges are allowed, edges with a null end are left out; no edges give no rows.
    """
    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")
    while not _is_forest(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        far, minima = _starred(both, "a", "b")
        large = cut(far.filter("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        forget(minima)
        near, minima = _starred(large, "a", "b")
        small = near.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(near.select(F.col("u").alias("a"), F.col("m").alias("b")))
        was, e = e, cut(small.distinct(), "small")
        for spent in (was, large, minima):
            forget(spent)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
