"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: longs); component is the smallest node.

    Each round links every node to its smallest neighbour, first from larger neighbours,
    then from smaller ones; the number of rounds is logarithmic in the longest chain.
    Minima are taken by aggregation and joined back, so a hub with many links is folded
    map-side and its join is a skewed join Spark can split. Rounds end in written tables.
    """
    links = scratch.keep(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("h")).head()
    while state.n:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        step = (small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        after = scratch.keep(step)
        new = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("h")).head()
        scratch.drop(links)
        links = after
        if (new.n, new.h) == (state.n, state.h):
            break
        state = new
    # a forest of stars: every other node points at the smallest one
    tops = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
