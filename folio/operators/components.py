"""Connected components by alternating stars: a logarithmic number of joins, no links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources.staging import stage


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.union(links.select("v", "u"))
    low = _lowest(both).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the smallest of them. Links are (larger, smaller)."""
    low = _lowest(links)
    ends = links.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return ends.union(low.select("u", "m")).distinct()


def _open(links: DataFrame) -> DataFrame:
    """The nodes that hang on several others, or hang on one while others hang on them."""
    ends = links.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of ``edges``; a component is named by its smallest node.

    Works on any ordered type. Null ends and loops are dropped, repeated edges count once.
    """
    nodes = edges.filter(F.col(a) == F.col(b)).select(F.col(a).alias("id"), F.col(a).alias("component"))
    links = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    while True:
        links = stage(_small_star(_large_star(links)), "links")
        if _open(links).isEmpty():
            break
    members = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return members.union(roots.union(nodes).distinct().join(members.select("id"), "id", "left_anti"))
