"""Head-to-head meetings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = ("family", "slug", "opponent")
#: Meetings that a task aggregates, about: their groups are held in memory.
TASK_ROWS = 500_000


def past_meetings(matches: DataFrame, current: DataFrame) -> DataFrame:
    """Played matches of other seasons than the family's current one (family, current).

    There is a row for each family, so it is broadcast: matches dealt by family would land in as many tasks as there are families.
    """
    return matches.join(F.broadcast(current), "family").filter("res is not null and season <> current").drop("current")


def tasks(spark: SparkSession, rows: int) -> int:
    """Tasks to deal so many meetings to: one a core, and more as rows grow."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def _dealt(meetings: DataFrame, parts: int | None) -> DataFrame:
    """Dealt by pair before they are aggregated: most pairs meet once, so combining them in the tasks that read saves little and holds much."""
    return meetings.repartition(parts, *PAIR) if parts else meetings


def balance(meetings: DataFrame, parts: int | None = None) -> DataFrame:
    """Per team and opponent: meetings, wins, draws and the rest, which counts as lost; in `parts` tasks, where given."""
    w, d = (F.count_if(F.col("res") == r) for r in "WD")
    return _dealt(meetings.select(*PAIR, "res"), parts).groupBy(*PAIR).agg(F.count("*").alias("n"), w.alias("w"), d.alias("d")).withColumn("l", F.col("n") - F.col("w") - F.col("d"))


def tally(meetings: DataFrame, parts: int | None = None) -> DataFrame:
    """The balance with goals on both sides and the last day."""
    w, d = (F.count_if(F.col("res") == r) for r in "WD")
    out = _dealt(meetings.select(*PAIR, "res", "gf", "ga", "day"), parts).groupBy(*PAIR).agg(F.count("*").alias("n"), w.alias("w"), d.alias("d"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.max("day").alias("last_day"))
    return out.withColumn("l", F.col("n") - F.col("w") - F.col("d"))


def extremes(matches: DataFrame) -> DataFrame:
    """Per team and season the match with the largest and the smallest margin, the earliest of equal ones."""
    margin = F.col("gf") - F.col("ga")
    match = F.struct("match_id", "line", margin.alias("margin"))
    best, worst = F.struct(-margin, "day", "match_id", "line"), F.struct(margin, "day", "match_id", "line")
    out = matches.groupBy("family", "slug", "season").agg(F.min_by(match, best).alias("b"), F.min_by(match, worst).alias("w"))
    return out.select("family", "slug", "season", F.col("b.match_id").alias("best_match"), F.col("b.margin").alias("best_margin"), F.col("w.match_id").alias("worst_match"), F.col("w.margin").alias("worst_margin"))


def meeting_lists(fixtures: DataFrame, meetings: DataFrame) -> DataFrame:
    """Fixtures (family, slug, opponent, ..) that have past meetings, with their list by day, and wins, draws and the rest.

    A pair of teams meets a few times a season, so a list stays short. Fixtures are few beside matches: meetings of other pairs
    leave before lists are made, and all three steps share one dealing by pair.
    """
    columns = ("day", "match_id", "line", "gf", "ga", "res")
    asked = meetings.select(*PAIR, *columns).join(fixtures.select(*PAIR).distinct(), [*PAIR], "left_semi")
    lists = asked.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("meetings"))
    count = lambda r: F.size(F.filter("meetings", lambda m: m["res"] == r))
    out = fixtures.join(lists, [*PAIR]).withColumn("w", count("W")).withColumn("d", count("D"))
    return out.withColumn("l", F.size("meetings") - F.col("w") - F.col("d"))
