"""Published forms: calendars, tables as text, content-addressed payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.calendar import slot
from terrace.functions.text import ascii_id, calendar_escape, calendar_fold, digest


def payloads(rows: DataFrame, key: str) -> DataFrame:
    """(key, payload): other columns as JSON; null fields are left out."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("payload"))


def content_name(stem: Column, payload: Column) -> Column:
    """stem.digest.json: a new name for new content."""
    return F.concat_ws(".", stem, digest(payload), F.lit("json"))


def digest_tree(rows: DataFrame, by: list[str], bucket: Column, order: str, payload: str) -> DataFrame:
    """(.., digest, n): per group the digest of its buckets' digests, and those of their payloads' digests in order.

    A bucket holds a bounded part of a group, so no row holds many digests and no task a whole group's payloads.
    """
    joined = lambda column, at: F.expr(f"sha1(listagg({column}, '') within group (order by {at}))")
    each = rows.select(*by, bucket.alias("_bucket"), F.col(order).alias("_order"), F.sha1(F.col(payload)).alias("_digest"))
    parts = each.groupBy(*by, "_bucket").agg(joined("_digest", "_order").alias("_digest"), F.count("*").alias("_n"))
    return parts.groupBy(*by).agg(F.substring(joined("_digest", "_bucket"), 1, 8).alias("digest"), F.sum("_n").alias("n"))


def release_digest(published: DataFrame, key: str) -> DataFrame:
    """(digest): of all payloads, in 4,096 buckets of keys."""
    return digest_tree(published, [], F.crc32(F.col(key).cast("string").cast("binary")) % 4096, key, "payload").select("digest")


def write_release(published: DataFrame, key: str, root: str) -> str:
    """Writes a folder of payloads by key, named by their common digest; returns its path. Older releases stay."""
    name = release_digest(published, key).first()["digest"]
    path = f"{root}/h-{name}"
    published.write.mode("overwrite").partitionBy(key).text(path)
    return path


def markdown_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """(line): rows of a Markdown table; null is empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def calendar_events(fixtures: DataFrame) -> DataFrame:
    """(.., event): one calendar event for each fixture (team, opponent, day, time, ground, home), lines folded."""
    start, end = slot(F.col("day"), F.col("time"))
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
    home = F.when(F.col("home"), F.concat_ws(" – ", "team", "opponent")).otherwise(F.concat_ws(" – ", "opponent", "team"))
    uid = F.concat_ws("-", ascii_id(F.col("team")), ascii_id(F.col("opponent")), F.date_format("day", "yyyyMMdd"))
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART:"), stamp(start)), F.concat(F.lit("DTEND:"), stamp(end)), F.concat(F.lit("SUMMARY:"), calendar_escape(home)), F.concat(F.lit("LOCATION:"), calendar_escape(F.coalesce("ground", F.lit("")))), F.lit("END:VEVENT")]
    return fixtures.withColumn("event", F.concat_ws("\r\n", *map(calendar_fold, lines)))


def calendars(fixtures: DataFrame) -> DataFrame:
    """(team, calendar): a team's events in kick-off order between the calendar's first and last lines."""
    events = calendar_events(fixtures).withColumn("at", F.concat_ws(" ", F.col("day").cast("string"), "time", "opponent"))
    body = F.expr("listagg(event, '\r\n') within group (order by at)")
    head, tail = "BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//terrace//fixtures//EN", "END:VCALENDAR\r\n"
    return events.groupBy("team").agg(body.alias("body")).select("team", F.concat_ws("\r\n", F.lit(head), "body", F.lit(tail)).alias("calendar"))


def coverage(fixtures: DataFrame, parts: int | None = None) -> DataFrame:
    """One row of counts: teams, fixtures, scores, official scores, grounds.

    Teams and grounds are counted after rows are dealt by them, to `parts` tasks where given, so no task holds more than its
    share of either.
    """
    dealt = lambda rows, by: rows.repartition(parts, by) if parts else rows
    known = fixtures.select("team", F.col("score").isNotNull().alias("known"), (F.col("official") & F.col("score").isNotNull()).alias("sure"))
    by_team = dealt(known, "team").groupBy("team").agg(F.count("*").alias("n"), F.count_if("known").alias("known"), F.count_if("sure").alias("sure"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    teams = by_team.agg(F.count("team").alias("teams"), total("n").alias("fixtures"), total("known").alias("scores"), total("sure").alias("official"))
    codes = dealt(fixtures.select("code"), "code").distinct().agg(F.count("code").alias("codes"))
    return teams.crossJoin(codes)
