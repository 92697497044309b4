"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hub_join, saved


def components(links: DataFrame) -> DataFrame:
    """links(u, v) of any one orderable type -> (node, component): component is the least node reachable.

    Both steps take a minimum per node and join it back by hub_join, so the links of a node with very many are never
    gathered in one task. Rows with a null end and links of a node with itself count for nothing; no links give an
    empty result.
    """
    edges = saved(links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        # large star: every greater neighbour of u goes to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = saved(hub_join(both, saved(least, "least"), "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        # small star: u and its smaller neighbours go to the least of them
        least = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        moved = hub_join(large, least, "u", "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done, edges = edges, saved(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        for old in (done, large, least):
            discard(old)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
