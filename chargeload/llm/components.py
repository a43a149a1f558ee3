"""Connected components of an edge table, by alternating large and small stars.

Every round is a few aggregations and joins over the edges, written to the shared checkpoint
folder; nothing but the answer whether stars are all that is left reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hangs its larger (large star) or its smaller neighbours and itself (small star) on the least of them."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    hung = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Does every node either hang on one other or hold others, never both?"""
    roles = edges.select("u", F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("v", F.lit(0), F.lit(1)))
    roles = roles.groupBy("u").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not roles.where("hangs > 1 OR hangs > 0 AND holds > 0").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of `edges` (u bigint, v bigint); a component is named by its least node."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while not _settled(edges):
        edges = cut(_star(_star(edges, True), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
