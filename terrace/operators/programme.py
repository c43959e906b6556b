"""Programmes by ground and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.text import code_number, code_prefix
from terrace.operators.dedupe import first_by


def programme(fixtures: DataFrame) -> DataFrame:
    """Fixtures (ground, day, minute, code, home, away, ord) once each, in kick-off order, with the others of the day.

    The identity is day, minute, code and both names; of repeats the first by `ord` stays.
    """
    once = first_by(fixtures, ["ground", "day", "minute", "code", "home", "away"], "ord")
    place = Window.partitionBy("ground", "day")
    ordered = place.orderBy("minute", code_prefix(F.col("code")), code_number(F.col("code")), "home", "away")
    return once.withColumn("slot", F.row_number().over(ordered)).withColumn("others", F.count("*").over(place) - 1)


def fixture_texts(fixtures: DataFrame) -> DataFrame:
    """Per ground its fixtures in order as one text."""
    return fixtures.groupBy("ground").agg(F.expr("listagg(label, ', ') within group (order by ord)").alias("fixtures"), F.count("*").alias("n"))


def oriented(fixtures: DataFrame) -> DataFrame:
    """Fixtures seen from one team (team, opponent, at_home) as home and away."""
    home = F.col("at_home")
    return fixtures.withColumn("home", F.when(home, F.col("team")).otherwise(F.col("opponent"))).withColumn("away", F.when(home, F.col("opponent")).otherwise(F.col("team")))


def chosen(rows: DataFrame, codes: list[str] | None = None, slug: object = None, family: str | None = None, season: int | None = None, limit: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows by code, team, family and season, each where given; then the first `limit` in order."""
    if codes is not None:
        rows = rows.filter(F.col("code").isin(codes))
    for name, value in (("slug", slug), ("family", family), ("season", season)):
        rows = rows if value is None else rows.filter(F.col(name) == value)
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def with_fixtures(teams: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Teams (team, ..) that have a fixture."""
    return teams.join(fixtures.select("team").distinct(), "team", "left_semi")


def placed(fixtures: DataFrame, venues: DataFrame) -> DataFrame:
    """Fixtures (code, ..) with the name of their ground, or its code where none is known, and its area."""
    known = venues.select("code", F.col("name").alias("ground"), "area")
    return fixtures.join(known, "code", "left").withColumn("ground", F.coalesce("ground", F.col("code").cast("string")))


def team_summaries(fixtures: DataFrame) -> DataFrame:
    """Per team of placed fixtures (team, opponent, score, official, res, met, area): played matches by result, provisional
    results, opponents met before, fixtures on grounds without a measure, and the largest ground by the smallest."""
    count = lambda r: F.count_if(F.col("res") == r)
    provisional = F.count_if(F.col("score").isNotNull() & ~F.col("official"))
    out = fixtures.groupBy("team").agg(F.count("res").alias("played"), count("W").alias("w"), count("D").alias("d"), count("L").alias("l"), provisional.alias("provisional"), F.count_distinct(F.when(F.col("met"), F.col("opponent"))).alias("met"), F.count_if(F.col("area").isNull()).alias("unmeasured"), F.max("area").alias("most"), F.min("area").alias("least"))
    return out.withColumn("ratio", F.round(F.col("most") / F.col("least"), 1)).drop("most", "least")


def grounds_by_area(fixtures: DataFrame, pos: str) -> DataFrame:
    """(team, code, area, place): a team's measured grounds, the largest first, of equal ones the first in its fixtures."""
    own = fixtures.filter("area is not null").groupBy("team", "code").agg(F.first("area").alias("area"), F.min(pos).alias("pos"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("area"), "pos", "code"))).drop("pos")


def shown_grounds(venues: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Venues that a page shows: no training grounds, no comments (keys that start with _), and only with a measured candidate; with their number of candidates."""
    counts = candidates.groupBy(key).agg(F.count("*").alias("candidates"))
    kept = venues.filter(~F.coalesce("training", F.lit(False)) & ~F.col(key).startswith("_"))
    return kept.join(counts, key)
