"""URL filters as a temporal list join, in DataFrame functions alone.

A dated list has entries (pattern, action, listed_at): a pattern is a host and covers its subdomains. Entries of one
pattern become validity intervals, each up to the next one's date, the last one open. Each capture looks up all suffixes
of its host among the entries active when it was fetched; the longest suffix decides.

The as-of join is an equi-join on pattern and time slot (SLOT_DAYS days) with the interval as its condition, so a host
with most captures spreads over its slots, and what is left uneven Spark splits, for each capture needs its own matches
alone. Intervals are repeated once per slot up to the last fetch.

Defined results: a null url, or one without a host, keeps its row and is not blocked; so does a null fetch time; of
entries of one pattern and date the one that sorts last by action holds ("block" over "allow"); entries with nulls are
ignored; an address as host has no parent domains; repeated captures (same id, url and time) are one row; hosts compare lower-cased, without port, user and final
dot; empty tables give no rows or no matches; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_DAYS = 32
#: Hosts that are addresses, of either version.
ADDRESS = r"\A(?:\[.*\]|[0-9]+(?:\.[0-9]+){3})\z"


def host_of(url: Column) -> Column:
    """The lower-cased host, null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)", 1)), r"\.+\z", "")
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and its parent domains, single labels left out unless the host is one. An address has none but itself."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until): until is null while the entry holds."""
    dated = entries.select(F.lower("pattern").alias("pattern"), "action", F.col("listed_at").alias("since")).dropna()
    last = dated.groupBy("pattern", "since").agg(F.max("action").alias("action"))
    following = Window.partitionBy("pattern").orderBy("since")
    return last.withColumn("until", F.lead("since").over(following))


def _slot(day: Column) -> Column:
    return F.floor(F.unix_date(day) / SLOT_DAYS)


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched, host, pattern, action, since, blocked) for captures (page_id, url, fetched: date)."""
    keyed = captures.select("page_id", "url", "fetched", host_of(F.col("url")).alias("host")).distinct()
    looked = keyed.select("*", F.explode_outer(suffixes(F.col("host"))).alias("suffix"), _slot(F.col("fetched")).alias("slot"))
    last = captures.agg(F.max("fetched")).scalar()
    spans = intervals(entries).withColumn("last", last).filter("since <= last")
    spans = spans.select("pattern", "action", "since", "until", F.explode(F.sequence(_slot(F.col("since")), _slot(F.least(F.coalesce("until", "last"), "last")))).alias("of_slot"))
    active = (F.col("suffix") == F.col("pattern")) & (F.col("slot") == F.col("of_slot")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    found = looked.join(spans, active, "left")
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.char_length("pattern").alias("n"), "pattern", "action", "since"))).alias("best")
    return found.groupBy("page_id", "url", "fetched", "host").agg(best).select("page_id", "url", "fetched", "host", "best.pattern", "best.action", "best.since", F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"))


FIRST_DAY, DAYS = "2023-01-01", 730


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of the test table, which has no fetch time: a day for each id."""
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod("page_id", F.lit(DAYS)).cast("int")).alias("fetched"))


def _drawn(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("int")


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and parent domains of the test table: a third of them listed, three entries each."""
    names = pages.select(F.explode(F.slice(suffixes(host_of(F.col("url"))), 1, 2)).alias("pattern")).distinct().filter(_drawn(F.col("pattern")) % 3 == 0)
    entry = names.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), _drawn(F.concat_ws("#", "pattern", "i")) % DAYS)
    return entry.select("pattern", F.when(F.col("i") == 1, "allow").otherwise("block").alias("action"), day.alias("listed_at"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Whether each page's host was blocked when it was fetched."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(page_captures(pages), page_entries(pages)).select("page_id", F.col("fetched").cast("string").alias("fetched"), "host", "pattern", "action", F.col("since").cast("string").alias("since"), "blocked")


OP5_SQL = r"""
WITH p AS (
  SELECT DISTINCT page_id, url, DATE '2023-01-01' + (page_id % 730)::INT AS fetched,
    nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)', 1)), '.'), '') AS host FROM pages
), s AS (
  SELECT page_id, url, fetched, host, i, array_to_string(string_split(host, '.')[i:], '.') AS suffix
  FROM (SELECT *, unnest(generate_series(1, CASE WHEN regexp_matches(host, '^(\[.*\]|[0-9]+(\.[0-9]+){3})$') THEN 1 ELSE greatest(len(string_split(host, '.')) - 1, 1) END)) AS i FROM p WHERE host IS NOT NULL)
), n AS (SELECT DISTINCT suffix AS pattern FROM s WHERE i <= 2 AND ('0x' || substr(md5(suffix), 1, 6))::INT % 3 = 0),
e AS (
  SELECT pattern, CASE WHEN i = 1 THEN 'allow' ELSE 'block' END AS action,
    DATE '2023-01-01' + (('0x' || substr(md5(pattern || '#' || i::VARCHAR), 1, 6))::INT % 730)::INT AS since
  FROM n, (SELECT unnest([0, 1, 2]) AS i)
), v AS (SELECT pattern, since, max(action) AS action FROM e GROUP BY 1, 2),
w AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM v),
m AS (
  SELECT s.page_id, s.url, w.pattern, w.action, w.since, row_number() OVER (PARTITION BY s.page_id, s.url ORDER BY length(w.pattern) DESC) AS r
  FROM s JOIN w ON s.suffix = w.pattern AND s.fetched >= w.since AND (w.until IS NULL OR s.fetched < w.until)
)
SELECT p.page_id, p.fetched::DATE::VARCHAR AS fetched, p.host, m.pattern, m.action, m.since::DATE::VARCHAR AS since, coalesce(m.action = 'block', false) AS blocked
FROM p LEFT JOIN m ON p.page_id = m.page_id AND p.url IS NOT DISTINCT FROM m.url AND m.r = 1
"""
