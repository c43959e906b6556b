"""Dates, times, seasons and families as Column expressions. Nothing here reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_MINUTES = 75
SPRING, AUTUMN = "jaro", "podzim"


def parse_day(text: Column) -> Column:
    """A date from d.m.y with any blanks; two-digit years are of this century; null if there is no such date."""
    part = lambda i: F.regexp_extract(text, r"(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4}|\d{2})(?!\d)", i)
    year = F.when(F.char_length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    return F.try_to_date(F.when(part(3) != "", F.concat_ws("-", year, F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))), "yyyy-MM-dd")


def minutes(time: Column) -> Column:
    """Minutes since midnight of HH:MM; 0 without a time."""
    hour, minute = (F.regexp_extract(time, r"(\d{1,2}):(\d{2})", i).try_cast("int") for i in (1, 2))
    return F.coalesce(hour * 60 + minute, F.lit(0))


def slot(day: Column, time: Column, length: int = SLOT_MINUTES) -> tuple[Column, Column]:
    """Local start and end of a match, without a zone."""
    start = F.to_timestamp_ntz(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.lpad(F.floor(minutes(time) / 60).cast("string"), 2, "0")), F.lit("yyyy-MM-dd HH"))
    start = start + F.make_dt_interval(mins=minutes(time) % 60)
    return start, start + F.make_dt_interval(mins=F.lit(length))


def day_display(day: Column) -> Column:
    return F.date_format(day, "d. M. yyyy")


def family(season: Column) -> Column:
    """The middle of YYYY-family-half."""
    return F.regexp_extract(season, r"^[^-]+-(.+)-[^-]+$", 1)


def season_order(season: Column) -> Column:
    """Order of season ids: year, then spring before autumn."""
    return F.substring(season, 1, 4).cast("int") * 2 + season.endswith(AUTUMN).cast("int")


def season_code(season: Column) -> Column:
    """Short code j2026 or p2026. Not for sorting."""
    return F.concat(F.substring(F.substring_index(season, "-", -1), 1, 1), F.substring(season, 1, 4))


def season_label(season: Column) -> Column:
    return F.concat_ws(" ", F.substring_index(season, "-", -1), F.substring(season, 1, 4))


def half_year(day: Column) -> Column:
    """Season order of a date: 2 * year, plus 1 from July on."""
    return (F.year(day) * 2 + (F.month(day) > 6).cast("int")).cast("int")


def level(division: Column) -> Column:
    """The number that a division starts with; null without one."""
    return F.regexp_extract(division, r"^(\d+)", 1).try_cast("int")


def division_label(competition: Column, division: Column) -> Column:
    """Division with the competition's tag. The first tag that fits counts, for the plain one is part of the others."""
    tag = F.when(competition.contains("superveteran"), "super").when(competition.contains("ultraveteran"), "ultra").when(competition.contains("veteran"), "vet")
    return F.when(tag.isNull(), division).otherwise(F.concat_ws(" ", division, tag))


def is_lettered(division: Column) -> Column:
    """Divisions like 3-b."""
    return division.rlike(r"\A\d+-[a-z]\z")
