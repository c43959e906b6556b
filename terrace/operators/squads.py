"""Squads: per-season counters as partials, rolled up over any range of seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = ("apps", "goals", "best", "gk", "cap")
LEAST_MATCHES = 5


def eligible(appearances: DataFrame, least: int = LEAST_MATCHES) -> DataFrame:
    """(team): teams with enough matches that have a line-up."""
    return appearances.groupBy("team").agg(F.count_distinct("match_id").alias("n")).filter(F.col("n") >= least).select("team")


def partials(appearances: DataFrame, goals: DataFrame, opted_out: DataFrame | None = None, opted_teams: DataFrame | None = None) -> DataFrame:
    """(team, season, player, counters): line-ups (best, gk, cap flags) and goals in one aggregation, no full join.

    Opted-out names (player) and all of opted-out teams (team) are dropped before counting.
    """
    seen = appearances.select("team", "season", "player", F.lit(1).alias("apps"), F.lit(0).alias("goals"), *[F.col(c).cast("int").alias(c) for c in ("best", "gk", "cap")])
    scored = goals.select("team", "season", "player", F.lit(0).alias("apps"), F.col("goals").cast("int").alias("goals"), *[F.lit(0).alias(c) for c in ("best", "gk", "cap")])
    both = seen.unionByName(scored)
    if opted_out is not None:
        both = both.join(opted_out, "player", "left_anti")
    if opted_teams is not None:
        both = both.join(opted_teams, "team", "left_anti")
    return both.groupBy("team", "season", "player").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def in_range(season: Column, one: int | None, other: int | None) -> Column:
    """Between two ends in either order; an unknown end means the whole history."""
    if one is None or other is None:
        return F.lit(True)
    return season.between(min(one, other), max(one, other))


def roll_up(parts: DataFrame, one: int | None, other: int | None) -> DataFrame:
    """Totals of players with appearances in a range, first and last season, and the team's own goals (names without any)."""
    sums = parts.filter(in_range(F.col("season"), one, other)).groupBy("team", "player").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.min("season").alias("first_season"), F.max("season").alias("last_season"))
    own = F.sum(F.when(F.col("apps") == 0, F.col("goals")).otherwise(0)).over(Window.partitionBy("team"))
    return sums.withColumn("own_goals", own).filter("apps > 0")


def season_records(matches: DataFrame) -> DataFrame:
    """(team, season, n, w, d, l, gf, ga, biggest, worst): a season's record, and the matches (match_id, line, margin) with
    the largest and the smallest margin, the earliest of equal ones."""
    count = lambda r: F.count_if(F.col("res") == r)
    margin = F.col("gf") - F.col("ga")
    match = F.struct("match_id", "line", margin.alias("margin"))
    extreme = lambda sign: F.min_by(match, F.struct(sign * margin, "day", "match_id", "line"))
    return matches.groupBy("team", "season").agg(F.count("*").alias("n"), count("W").alias("w"), count("D").alias("d"), count("L").alias("l"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), extreme(-1).alias("biggest"), extreme(1).alias("worst"))


def range_totals(records: DataFrame, one: int | None, other: int | None) -> DataFrame:
    """Sums of a team's seasons in a range, with its biggest win and worst loss; of equal ones the oldest season's."""
    chosen = records.filter(in_range(F.col("season"), one, other))
    extreme = lambda c, sign: F.min_by(F.struct(f"{c}.match_id", f"{c}.margin", "season"), F.struct(sign * F.col(f"{c}.margin"), "season"))
    return chosen.groupBy("team").agg(*[F.sum(c).alias(c) for c in ("n", "w", "d", "l", "gf", "ga")], extreme("biggest", -1).alias("biggest"), extreme("worst", 1).alias("worst"))


def ordinals(appearances: DataFrame, goals: DataFrame) -> DataFrame:
    """(team, player, ordinal) by first appearance: day, line-ups before goals, place in the sheet."""
    first = lambda df, kind: df.select("team", "player", F.struct("day", F.lit(kind).alias("kind"), "match_id", "line").alias("at"))
    least = first(appearances, 0).unionByName(first(goals, 1)).groupBy("team", "player").agg(F.min("at").alias("at"))
    return least.withColumn("ordinal", F.dense_rank().over(Window.partitionBy("team").orderBy("at"))).drop("at")


def squad_order(by: str, descending: bool, collation: str = "cs") -> list[Column]:
    """Sort of a squad table: a column or `name`, then appearances; the direction turns both."""
    first = F.collate(F.concat_ws(" ", F.substring_index("player", " ", -1), "player"), collation) if by == "name" else F.col(by)
    keys = [first, F.col("apps")]
    return [k.desc() if descending else k.asc() for k in keys]


def default_order() -> list[Column]:
    """Most appearances first, then most goals, then by name."""
    return [F.desc("apps"), F.desc("goals"), F.asc("player")]
