"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join, so a node with very many links is
neither collected nor held in one task; adaptive execution may split its join. Each round is written to the
shared folder. The number of rounds grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import stored


def _both(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    both = _both(links)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` lead from larger to smaller nodes."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``u, v``: every linked node that is not the smallest of its component, and that smallest node.

    ``links`` has two columns of one ordered type without nulls; repeated links and links to itself are allowed.
    """
    a, b = links.columns
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    now, before = stored(now, "links"), None
    while True:
        # Every round that changes anything brings a node nearer to the smallest, so there is a last one.
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return now
        before = state
        now = stored(_small_star(_large_star(now).distinct()).distinct(), "links")
