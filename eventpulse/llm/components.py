"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum and an equi-join; the edge table never grows, and it is checkpointed after
each pass, so neither links nor components visit the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("a", "low").alias("low"))
    joined = both.join(low, both["a"] == low["u"])
    if large:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
    again = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("low").alias("b")))
    return again.filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; edges has orderable columns a and b, the component is the
    smallest node reached. Loops and repeated edges do no harm; no edges give no rows."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = checkpointed(edges)
    before = _state(edges)
    while before[0]:
        stars = _star(edges, large=True)
        stars = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = checkpointed(_star(stars, large=False))
        now = _state(edges)
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
