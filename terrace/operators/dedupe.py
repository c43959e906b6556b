"""First-wins de-duplication, uniqueness and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order, as one aggregation with partial combining."""
    rest = [c for c in df.columns if c not in keys]
    rank = [F.col(o) if isinstance(o, str) else o for o in order]
    best = F.min_by(F.struct(*rest), F.struct(*[r.alias(f"o{i}") for i, r in enumerate(rank)])).alias("row")
    return df.groupBy(*keys).agg(best).select(*keys, "row.*").select(*df.columns)


def unique_only(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """Keys with one row alone, with its value: a lookup that is empty where a name is ambiguous."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias(alias)).filter("n = 1").drop("n")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; the job fails if two of them share a key."""
    many = F.count("*").over(Window.partitionBy(*keys)) > 1
    checked = df.withColumn("_twice", F.when(many, F.raise_error(F.concat_ws(" ", F.lit("repeated key"), *keys))).otherwise(F.lit(None).cast("string")))
    return checked.filter(F.col("_twice").isNull()).drop("_twice")


def overlay(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Base rows with extra ones over them; keys that start with _ are comments."""
    ranked = base.withColumn("_layer", F.lit(1)).unionByName(extra.withColumn("_layer", F.lit(0)), allowMissingColumns=True)
    return first_by(ranked.filter(~F.col(key).startswith("_")), [key], "_layer").drop("_layer")


def is_complete(read: Column, played: Column) -> Column:
    """Whether all that was played has been read."""
    return F.size(F.array_except(played, read)) == 0


def compare_sets(items: DataFrame, keys: list[str], item: str, first: Column, second: Column) -> DataFrame:
    """Per key the sizes of union, intersection and difference of two sets of items, and whether the second covers the first.

    Each distinct item is a row with two marks, so no group is gathered. Keys without an item on either side are left out.
    """
    marked = items.filter(first | second).groupBy(*keys, item).agg(F.bool_or(first).alias("a"), F.bool_or(second).alias("b"))
    counts = marked.groupBy(*keys).agg(F.count("*").alias("either"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(~F.col("b")).alias("only_first"), F.count_if("b").alias("n_second"))
    kept = counts.filter((F.col("both") + F.col("only_first") > 0) & (F.col("n_second") > 0))
    return kept.select(*keys, "either", "both", "only_first", (F.col("only_first") == 0).alias("complete"))


def top_up(held: DataFrame, fresh: DataFrame, season: str, day: str) -> DataFrame:
    """Freshly read seasons replace the held rows of those seasons, newest first, missing dates last."""
    kept = held.join(fresh.select(season).distinct(), season, "left_anti")
    return kept.unionByName(fresh).orderBy(F.col(day).desc_nulls_last())
