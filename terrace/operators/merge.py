"""Incremental refresh of results: no known score is ever erased."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("team", "day", "code", "opponent")


def is_stale(day: Column, score: Column, official: Column, today: str, window: int = 10, missing_only: bool = False) -> Column:
    """Whether a match of the last `window` days still lacks an official result, or, for the cheap pass, any score."""
    t = F.lit(today).cast("date")
    open_ = score.isNull() if missing_only else ~F.coalesce(official, F.lit(False))
    return day.between(F.date_sub(t, window), t) & open_


def merge_results(held: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = KEYS, scope: str = "team") -> DataFrame:
    """The fresh snapshot of each team replaces its held rows; teams that were not read keep theirs.

    A fresh row without a score keeps the held score together with its official flag; any other fresh pair counts, even
    from official to provisional. `changed` marks a new score that differs.
    """
    old = held.select(*keys, F.col("score").alias("old_score"), F.col("official").alias("old_official"))
    joined = fresh.select(*keys, "score", "official").join(old, list(keys), "left")
    carry = F.col("score").isNull() & F.col("old_score").isNotNull()
    merged = joined.select(
        *keys,
        F.when(carry, F.col("old_score")).otherwise(F.col("score")).alias("score"),
        F.when(carry, F.col("old_official")).otherwise(F.col("official")).alias("official"),
        (F.col("score").isNotNull() & ~F.col("score").eqNullSafe(F.col("old_score"))).alias("changed"),
    )
    rest = held.join(fresh.select(scope).distinct(), scope, "left_anti").select(*keys, "score", "official", F.lit(False).alias("changed"))
    return merged.unionByName(rest)


def upsert(held: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows replace held ones of the same keys."""
    return held.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)
