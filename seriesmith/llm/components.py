"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for each end of ``links``: component is the smallest node reachable.

    Each round hangs neighbours onto the smallest node near them; the number of rounds grows with
    the logarithm of the longest chain.  Minima are pre-aggregated before the shuffle, the join
    back to the links is split by Spark where a node is hot, and each round is cut.  Links to
    oneself, repeated links and null ends are ignored; no links give an empty result.
    """
    links = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .where(F.col("u") > F.col("v")).distinct())
    before = None
    while (now := _state(links)) != before:
        before = now
        # large star: larger neighbours of a node go to the smallest of its neighbours and itself
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u > v").distinct())
        # small star: smaller neighbours of a node, and itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))))
        links = cut(small.where("u > v").distinct())
    return (links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
            .union(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
