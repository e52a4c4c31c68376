"""Connected components of links, by alternating large-star and small-star steps.

Each step is one aggregation and one join, so a node with very many links is never gathered, and the number of steps
grows with the logarithm of the longest path. Every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm import common


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (u, v); a component is named by its least node."""
    both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = common.written(both, "links")
    state = _state(now)
    while state[0]:
        either = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = either.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = either.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = least.select("u", F.col("m").alias("v")).unionByName(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        now = common.written(small, "links")
        after = _state(now)
        if after == state:
            break
        state = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
