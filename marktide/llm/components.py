"""Connected components of a link table by alternating large-star and small-star steps, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("a"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, F.col("u") == F.col("a")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low.withColumnRenamed("u", "a"), F.col("u") == F.col("a"))
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()


def _sign(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (u long, v long): one row (u, v) for each node but the smallest of its component, v the smallest.

    Nodes without a link are left out. Every round is written to the shared folder; the number of rounds grows with the
    logarithm of the longest chain.
    """
    now = saved(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    sign = _sign(now)
    while sign[0]:
        now = saved(_small_star(_large_star(now)), "links")
        if (new := _sign(now)) == sign:
            break
        sign = new
    return now
