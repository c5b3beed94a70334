"""Connected components of an edge table by alternating large and small stars.

Every round points neighbours at the least node seen; the number of rounds
grows with the logarithm of a component's length. Each round is two
aggregations and two joins over edges, written once to the shared folder, so a
lost executor costs at most one round. Neither nodes nor edges reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u > v). Large: a node's larger neighbours go to its least one or itself.
    Small: a node and its smaller neighbours go to the least of them."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = (edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(least.select("u", F.col("m").alias("v"))))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the least node reachable) for every node on an edge."""
    e = materialise(edges.filter(F.col(a) != F.col(b))
                    .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        e = materialise(_star(_star(e, True), False), "stars")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    # stable: every edge points from a node to its component
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
