"""Connected components of links as joins and aggregations: alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import Scratch


def _stars(links: DataFrame) -> DataFrame:
    """One large-star pass, then one small-star pass. Links are (u, v) with u > v; minima combine in each task."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.filter("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, v): each linked node but the least of its component, with that least node. `links` is (u, v), u > v.

    Each pass is written to the shared folder, and the one before it goes.
    """
    current, last, step = links, None, 0
    while True:
        current = scratch.save(_stars(current), f"{name}-{step}")
        if step:
            scratch.drop(f"{name}-{step - 1}")
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last or state["n"] == 0:
            return current
        last, step = state, step + 1
