"""Connected components of a graph whose edges lie in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._session import checkpointed

#: A node with more than this share of all edges is a hub. As every edge has one first node, there are at most 1 / SHARE hubs, whatever the graph.
HUB_SHARE = 1 / 2000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _joined(edges: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """``edges`` (u, w) with ``least`` (u, m, n: edges of u). Edges of hubs meet a broadcast of the hubs and stay where they are, so no task takes a hub's edges."""
    hubs = F.broadcast(least.where(F.col("n") > most).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")))
    tagged = edges.join(hubs, F.col("u") == F.col("hub"), "left")
    others = tagged.where("hub IS NULL").select("u", "w").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return others.unionByName(tagged.where("hub IS NOT NULL").select("u", "w", F.col("hub_m").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: longs, null in none); the component is its smallest node.

    A large star joins a node's larger neighbours to the smallest around it, a small star its smaller ones; both keep the
    graph connected. Minima are aggregated before they are exchanged and hubs are joined by broadcast, so a node may have any
    share of the edges. Ends when a round changes nothing.
    """
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := _mark(edges)) != before:
        before, most = now, max(1, int(now[0] * HUB_SHARE))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # n counts the edges that the join below deals by u
        least = both.withColumn("own", F.lit(0)).unionByName(edges.select(F.col("v").alias("u"), F.col("v"), F.lit(1).alias("own"))).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.sum("own").alias("n"))
        large = _joined(edges.select(F.col("v").alias("u"), F.col("u").alias("w")), least, most).select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        # large: every node's edge to a smaller one; the small star links them to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _joined(large.select("u", F.col("v").alias("w")), least, most).select(F.when(F.col("w") == F.col("m"), F.col("u")).otherwise(F.col("w")).alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.where("u <> v").distinct())
    return edges.groupBy("u").agg(F.min("v").alias("c")).select(F.col("u").alias("node"), F.col("c").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
