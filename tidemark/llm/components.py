"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Neighbours from which on a node is a hub; there are at most (edges / HUB) of them.
HUB = 50_000


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m of u's row in least (u, m, n). Hubs' rows are broadcast, so a hub's edges stay where they are
    and no task gets them all; the other edges are joined by a shuffle."""
    hubs = least.where(F.col("n") > HUB).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    marked = edges.join(F.broadcast(hubs), edges.u == F.col("hub"), "left")
    rest = marked.where("hub is null").select("u", "v").join(least.where(F.col("n") <= HUB).select("u", "m"), "u")
    return marked.where("hub is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(rest)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node with the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, with the smallest one. Edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v: any one type with an order) -> (node, root) for each node with an edge; root is the least node.

    Null ends and loops link nothing. Each round halves distances at least, so rounds grow with the logarithm of the
    longest chain; each is cut from its lineage. A node with very many edges is no hot spot: its least neighbour is
    pre-aggregated and broadcast.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = cut(e.distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        e = cut(_small_star(_large_star(e)))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
