"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component``: for every node of a link, the smallest node it is linked with.

    ``links`` has two columns of longs. Each round hangs the larger neighbours of a node, then
    the smaller ones, to the smallest of them, until every component is a star; rounds grow
    with the logarithm of the longest path. Minima are partial aggregates, and the joins have
    one row for each node on one side, so that AQE can split the other side of a hub.
    """
    low, high = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    links = stored(links.filter(F.col(a) != F.col(b)).select(high, low).distinct(), "links")
    state = _state(links)
    while True:
        # Large star: what is above a node goes to the smallest in the node's neighbourhood.
        turned = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = links.select("u", "v").unionByName(turned)
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        above = both.filter("v > u").join(least, "u")
        above = above.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and what is below it go to the smallest below it.
        lowest = above.groupBy("u").agg(F.min("v").alias("m"))
        below = above.join(lowest, "u").filter("v != m")
        below = below.select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(
            below.unionByName(lowest.withColumnRenamed("m", "v")).distinct(), "links"
        )
        before, state = state, _state(links)
        if state == before:
            break
    stars = links.groupBy("u").agg(F.min("v").alias("v"))
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
