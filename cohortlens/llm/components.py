"""Connected components of a table of links, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def components(links: DataFrame) -> DataFrame:
    """(u, v) links -> (``node``, ``component``): each linked node that is not the smallest of its component, with that smallest node.

    Groups are aggregated and joined back, so a node with very many links never meets them in one task. The loop
    ends when a round changes nothing; every round is written to the shared folder.
    """
    now = settle(links.filter("u <> v").select("u", "v").distinct())
    was, at = None, state(now)
    while at != was:
        now = settle(small_star(large_star(now)))
        was, at = at, state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
