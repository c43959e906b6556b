"""Careers bounded by gaps, placings and biographies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = 4


def season_positions(seasons: DataFrame) -> DataFrame:
    """(family, season, pos): 1 for a family's newest existing season. A season nobody played has no position."""
    newest = Window.partitionBy("family").orderBy(F.desc("season"))
    return seasons.select("family", "season").distinct().withColumn("pos", F.row_number().over(newest))


def career(presence: DataFrame, positions: DataFrame, gap: int = GAP) -> DataFrame:
    """(family, slug, season, pos): the newest run of a team's seasons; `gap` absences in a row end it."""
    # Seasons of families are few, so Spark broadcasts positions by their measured size.
    placed = presence.select("family", "slug", "season").distinct().join(positions, ["family", "season"])
    walk = Window.partitionBy("family", "slug").orderBy("pos")
    broken = F.coalesce(F.col("pos") - F.lag("pos").over(walk) > gap, F.lit(False)).cast("int")
    runs = placed.withColumn("breaks", broken).withColumn("run", F.sum("breaks").over(walk.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.filter("run = 0").select("family", "slug", "season", "pos")


def standings(matches: DataFrame) -> DataFrame:
    """Tables from results: (family, season, division, slug, played, w, d, l, gf, ga, points, place, out_of)."""
    count = lambda r: F.count_if(F.col("res") == r)
    sums = matches.groupBy("family", "season", "division", "slug").agg(F.count("*").alias("played"), count("W").alias("w"), count("D").alias("d"), count("L").alias("l"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"))
    table = Window.partitionBy("family", "season", "division")
    ranked = sums.withColumn("points", 2 * F.col("w") + F.col("d"))
    best = table.orderBy(F.desc("points"), F.desc(F.col("gf") - F.col("ga")), F.desc("gf"), "slug")
    return ranked.withColumn("place", F.row_number().over(best)).withColumn("out_of", F.count("*").over(table))


def career_line(careers: DataFrame, tables: DataFrame) -> DataFrame:
    """A row for each career season, with the placing where a table with matches is known."""
    known = tables.filter("played > 0").select("family", "season", "slug", "division", "place", "out_of", "played", "points")
    return careers.join(known, ["family", "season", "slug"], "left")


def placings(line: DataFrame) -> DataFrame:
    return line.filter("place is not null")


def best_and_worst(line: DataFrame) -> DataFrame:
    """Per team: best and worst (level, place), newest season on ties, and titles with the newest one's season."""
    low = F.struct("level", "place", (-F.col("season")).alias("newest"))
    high = F.struct("level", "place", F.col("season").alias("newest"))
    first = F.when(F.col("place") == 1, F.col("season"))
    out = placings(line).groupBy("family", "slug").agg(F.min(low).alias("top"), F.max(high).alias("bottom"), F.count_if(F.col("place") == 1).alias("titles"), F.max(first).alias("last_title"))
    return out.select("family", "slug", F.col("top.level").alias("best_level"), F.col("top.place").alias("best_place"), (-F.col("top.newest")).alias("best_season"), F.col("bottom.level").alias("worst_level"), F.col("bottom.place").alias("worst_place"), F.col("bottom.newest").alias("worst_season"), "titles", "last_title")


def biography(line: DataFrame, positions: DataFrame) -> DataFrame:
    """Per team: seasons, oldest one, previous level if it differs, highest and lowest level with their newest season,
    whether the career reaches the family's first season and whether it has holes."""
    newest = Window.partitionBy("family", "slug").orderBy("pos")
    flagged = line.withColumn("previous", F.lead("level").over(newest)).withColumn("r", F.row_number().over(newest))
    ends = positions.groupBy("family").agg(F.max("pos").alias("first_pos"))
    sums = flagged.groupBy("family", "slug").agg(
        F.count("*").alias("n"),
        F.min("season").alias("oldest"),
        F.max(F.when((F.col("r") == 1) & (F.col("previous") != F.col("level")), F.col("previous"))).alias("previous_level"),
        F.min(F.struct("level", (-F.col("season")).alias("s"))).alias("hi"),
        F.max(F.struct("level", F.col("season").alias("s"))).alias("lo"),
        F.max("pos").alias("last_pos"),
        (F.max("pos") - F.min("pos") + 1 != F.count("*")).alias("has_gap"),
    )
    joined = sums.join(ends, "family")
    return joined.select("family", "slug", "n", "oldest", "previous_level", F.col("hi.level").alias("high_level"), (-F.col("hi.s")).alias("high_season"), F.when(F.col("lo.level") != F.col("hi.level"), F.col("lo.level")).alias("low_level"), (F.col("last_pos") == F.col("first_pos")).alias("from_start"), "has_gap")


def shared_seasons(archive: DataFrame, fixtures: DataFrame, kept: DataFrame | None = None, current: DataFrame | None = None) -> DataFrame:
    """(slug, season): seasons in which a team shared its division with one of its current opponents.

    Only `kept` seasons (slug, season) count, and none that is `current` (season). Equi-joins and semi joins; a division is
    as large as a league table, so the join by division stays linear in the fixtures.
    """
    mine = archive if kept is None else archive.join(kept.select("slug", "season").distinct(), ["slug", "season"], "left_semi")
    mine = mine if current is None else mine.join(current.select("season").distinct(), "season", "left_anti")
    own = fixtures.join(mine, "slug").select("slug", "opponent", "season", "division")
    theirs = archive.select(F.col("slug").alias("opponent"), "season", "division")
    return own.join(theirs, ["opponent", "season", "division"], "left_semi").select("slug", "season").distinct()
