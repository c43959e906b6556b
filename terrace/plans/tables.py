"""Queries of scalar, programme, merge, search, profile and publishing operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions import geometry, rules
from terrace.functions.text import code_number, code_prefix, fold, strip_tags
from terrace.operators import merge, order_stats, profiles
from terrace.operators.dedupe import first_by, unique_only
from terrace.operators.grams import GramIndex, first_hits
from terrace.operators.programme import fixture_texts, programme
from terrace.plans.league import spread
from terrace.plans.publish import digest_tree
from terrace.plans.release import KeyedRelease
from terrace.sources.html import links
from terrace.streaming.refresh import refresh_once, shared_root


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fixtures: ground = user, code = event type and number, sides by event id."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("ground"),
        F.col("ts").cast("date").alias("day"),
        (F.hour("ts") * 60 + F.minute("ts")).alias("minute"),
        F.concat(F.col("event_type"), (F.col("event_id") % 13).cast("string")).alias("code"),
        (F.col("event_id") % 50).alias("home"),
        (F.col("event_id") % 49).alias("away"),
        F.col("event_id").alias("ord"),
    )


def q12_programme(spark, sf_dir):
    return programme(_fixtures(spark, sf_dir)).select("ground", F.col("day").cast("string").alias("day"), "minute", "code", "home", "away", "slot", "others")


def q13_dedupe_first(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("source", "lang", F.sha1("text").alias("digest"), "doc_id", "n_chars")
    return first_by(docs, ["source", "lang", "digest"], "doc_id")


def _results(spark, sf_dir, part: str) -> DataFrame:
    """Snapshots of all results, a row for each team, day, code and opponent: the first event of a key, then the last one, each with other scores known."""
    e = _read(spark, sf_dir, "events")
    keys = [F.col("user_id").alias("team"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("code"), (F.col("event_id") % 3).alias("opponent")]
    if part == "held":
        chosen = e.select(*keys, F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("score"), (F.col("event_id") % 2 == 0).alias("official"), "event_id")
    else:
        known = (F.col("event_type") != "error") & (F.col("event_id") % 2 == 0)
        chosen = e.select(*keys, F.when(known, F.col("value")).alias("score"), (F.col("event_id") % 4 == 0).alias("official"), "event_id")
    order = F.col("event_id") if part == "held" else -F.col("event_id")
    return first_by(chosen, ["team", "day", "code", "opponent"], order).drop("event_id")


def q14_result_merge(spark, sf_dir):
    return merge.merge_results(_results(spark, sf_dir, "held"), _results(spark, sf_dir, "fresh")).withColumn("day", F.col("day").cast("string"))


TODAY = "2024-01-20"


def q15_stale_window(spark, sf_dir):
    held = _results(spark, sf_dir, "fresh")
    stale = held.filter(merge.is_stale(F.col("day"), F.col("score"), F.col("official"), TODAY))
    return stale.groupBy("team").agg(F.count("*").alias("n_stale"), F.count_if(F.col("score").isNull()).alias("n_missing"), F.min("day").cast("string").alias("oldest"))


SEARCH = "être"


def q16_search_fold(spark, sf_dir):
    """Folded substring search: the first 40 by id, with the number that the list leaves out."""
    hits = _read(spark, sf_dir, "documents").filter(F.contains(fold(F.col("text")), fold(F.lit(SEARCH)))).select("doc_id", "source")
    return first_hits(hits, "doc_id")


def q68_gram_search(spark, sf_dir):
    """The same search by an index of grams: postings of the needle's grams, then the texts of their common documents."""
    index = GramIndex(spark, _read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", "text")
    hits = first_hits(index.search(SEARCH).select("doc_id", "source"), "doc_id")
    index.drop()
    return hits


def q69_keyed_read(spark, sf_dir):
    """Orders published by customer; those of customers in debt are read from the parts that hold them."""
    customers = _read(spark, sf_dir, "customer")
    orders = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").cast("date").alias("last"))
    payload = F.concat_ws("|", "c_name", F.coalesce("n", F.lit(0)).cast("string"), F.col("last").cast("string"))
    release = KeyedRelease(spark, f"{shared_root(spark)}/orders", "c_custkey")
    release.publish(customers.join(orders, "c_custkey", "left").select("c_custkey", payload.alias("payload")))
    return release.get_all(customers.filter("c_acctbal < 0"))


def q17_unique_lookup(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    lookup = unique_only(part, ["name"], "p_partkey", "only_key")
    return part.join(lookup, "name", "left").select("p_partkey", "name", "only_key")


def q18_colour_clash(spark, sf_dir):
    """Vectors as kits: the first dimensions as channels; each against the next one's."""
    v = _read(spark, sf_dir, "embeddings")
    channel = lambda i: F.floor((F.get("embedding", F.lit(i)).cast("double") + 1) * 127.5).cast("int")
    kits = v.select("vec_id", F.array(*map(channel, range(3))).alias("shirt"), F.array(*map(channel, range(3, 6))).alias("second"))
    away = kits.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("opponent"), F.col("shirt").alias("shirt2"), F.col("second").alias("second2"))
    return kits.join(away, "vec_id").select("vec_id", "opponent", rules.clash(F.col("shirt"), F.col("shirt2"), F.col("second"), F.col("second2"), 40.0).alias("clash"), F.round(rules.rgb_distance(F.col("shirt"), F.col("shirt2")), 6).alias("distance"))


def q19_nearest_keyword(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", rules.nearest_verdict(F.col("text"), "tion", ("and",), ("with",)).alias("verdict"))


TYPES = [(("brass", "copper"), "metal"), (("small", "medium"), "size"), (("econ", "stand"), "plain")]


def q20_ordered_case(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", rules.ordered_case(F.col("p_type"), TYPES, "unknown").alias("kind"))


def q21_link_extract(spark, sf_dir):
    found = links(_read(spark, sf_dir, "pages"), "html", r'href="(/[^"]*)"')
    return found.groupBy("link").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("uses"))


def q22_strip_tags(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.sha1(strip_tags(F.col("html"))).alias("text_digest"), F.char_length(strip_tags(F.col("html"))).cast("long").alias("n_chars"))


def q23_season_table(spark, sf_dir):
    """Lines with what is known of part (pitch) and supplier (venue); some sizes and names are not known."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax")
    pitch = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("p_size"), "p_retailprice")
    venue = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("venue"))
    joined = lines.join(pitch, "l_partkey", "left").join(venue, "l_suppkey", "left")
    edges = F.array((F.col("l_quantity") / 10), (F.col("l_tax") * 100))
    return joined.select("l_orderkey", "l_linenumber", "venue", rules.area(F.col("p_size").cast("double") + 0.5, F.col("p_retailprice") / 100).alias("area"), rules.confidence(edges).alias("confidence"))


def q24_venue_extremes(spark, sf_dir):
    p = _read(spark, sf_dir, "part").withColumn("area", F.col("p_size") * F.bround("p_retailprice").cast("long"))
    out = p.groupBy("p_brand").agg(F.count_distinct("area").alias("n_areas"), F.min_by("p_partkey", F.struct("area", "p_partkey")).alias("smallest"), F.max_by("p_partkey", F.struct("area", -F.col("p_partkey"))).alias("largest"), F.min("area").alias("least"), F.max("area").alias("most"))
    return out.withColumn("ratio", F.round(F.col("most") / F.col("least"), 1)).withColumn("share", rules.share_of(F.col("most"), out.agg(F.max("most")).scalar()))


def _profile(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("profile_id"), (F.unix_date(F.col("ts").cast("date")) * 24 + F.hour("ts")).alias("idx")).agg(F.count("*").cast("double").alias("value"))


def _peaks(spark, sf_dir):
    return profiles.local_maxima(_profile(spark, sf_dir), 1.2)


def q28_local_peaks(spark, sf_dir):
    return profiles.local_maxima(_profile(spark, sf_dir), 1.2, top=3).select("profile_id", "idx", "value", F.round("ratio", 4).alias("ratio"), F.round("shift", 4).alias("shift"))


def q29_band_pairs(spark, sf_dir):
    return profiles.band_pairs(_peaks(spark, sf_dir), 5, 40)


def q30_nearest_peak(spark, sf_dir):
    profile = _profile(spark, sf_dir)
    edges = profile.select("profile_id", F.col("idx").alias("edge"))
    return profiles.nearest_peak(edges, _peaks(spark, sf_dir), 12)


def q80_goal_lines(spark, sf_dir):
    """Hours of events as profiles: the two lines of a span, one of which must lie at its flush end."""
    profile = _profile(spark, sf_dir)
    ends = profile.groupBy("profile_id").agg(F.min("idx").alias("low"), F.max("idx").alias("high"))
    flush = F.when(F.col("profile_id") < "d", "start").when(F.col("profile_id") < "q", "end")
    spans = ends.select("profile_id", (F.col("low") + 24).alias("a"), (F.col("high") - 24).alias("b"), F.lit(300).alias("least"), F.lit(500).alias("most"), flush.alias("flush"))
    return profiles.goal_lines(profile, spans, reach=2, margin=150, ratio=1.1).select("profile_id", "i", "j", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "strength")


def q31_robust_stats(spark, sf_dir):
    out = order_stats.robust_stats(spread(_read(spark, sf_dir, "lineitem")), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", *[F.round(c, 3).alias(c) for c in ("median", "p995", "mean", "sigma")])


def q32_digest(spark, sf_dir):
    """Digest of a nation's customers in two levels, by thousands of keys."""
    c = _read(spark, sf_dir, "customer").withColumn("payload", F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment"))
    return digest_tree(c, ["c_nationkey"], F.floor(F.col("c_custkey") / 1000), "c_custkey", "payload")


def q33_calendar_rows(spark, sf_dir):
    """Start and end of a slot of 75 minutes, as text, and an identifier."""
    e = _read(spark, sf_dir, "events").withColumn("start", F.date_trunc("minute", "ts"))
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
    return e.select("event_id", stamp(F.col("start")).alias("dtstart"), stamp(F.col("start") + F.expr("interval 75 minutes")).alias("dtend"), F.concat_ws("-", "event_type", "user_id", F.date_format("start", "yyyyMMdd")).alias("uid"))


def q34_code_order(spark, sf_dir):
    codes = _read(spark, sf_dir, "part").select("p_brand", "p_size").distinct()
    codes = codes.select(F.concat("p_brand", F.lit("/P"), F.col("p_size").cast("string")).alias("code"))
    return codes.withColumn("ord", F.row_number().over(Window.partitionBy(code_prefix(F.col("code"))).orderBy(code_number(F.col("code")))))


def q36_ground_fixtures_text(spark, sf_dir):
    f = _fixtures(spark, sf_dir).withColumn("label", F.concat_ws(" ", F.col("day").cast("string"), "code"))
    return fixture_texts(f)


def q35_stream_refresh(spark, sf_dir):
    return refresh_once(spark, f"{sf_dir}/events.parquet")


def q38_sections(spark, sf_dir):
    """Parts as fields: their equal sections from the west, and a filter's width for their size."""
    num = lambda x: F.expr(x).cast("double")
    field = _read(spark, sf_dir, "part").select("p_partkey", num("p_partkey % 4000 + 5000").alias("fx"), num("p_partkey % 3000 + 5000").alias("fy"), num("p_size + 20").alias("fw"), num("p_partkey % 90 + 15").alias("fh"), num("p_partkey % 180").alias("angle"), F.expr("cast(p_partkey % 3 + 1 as int)").alias("n"), geometry.kernel_pixels(F.col("p_size") / 10, F.lit(0.25)).alias("kernel"))
    parts = field.select("p_partkey", "kernel", F.posexplode(geometry.sections(*map(F.col, ("fx", "fy", "fw", "fh", "angle", "n")))).alias("section", "s"))
    return parts.select("p_partkey", "kernel", "section", *[F.round(f"s.{c}", 3).alias(c) for c in ("cx", "cy", "w", "h")])


def q39_chart(spark, sf_dir):
    """Orders of a customer as a career chart: places of points, and which of them have labels."""
    own = Window.partitionBy("o_custkey")
    points = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 5 + 1).alias("level"))
    points = points.select("*", (F.row_number().over(own.orderBy("o_orderkey")) - 1).alias("i"), F.count("*").over(own).alias("n"), F.min("level").over(own).alias("low"), F.max("level").over(own).alias("high"))
    c = F.col
    return points.select("o_orderkey", F.round(geometry.chart_x(c("i"), c("n")), 3).alias("x"), F.round(geometry.chart_y(c("level"), c("low"), c("high")), 3).alias("y"), geometry.has_label(c("i"), c("n")).alias("labelled"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] == "q" and n[1:3].isdigit()}

_F = """f AS (SELECT user_id AS ground, ts::DATE AS day, (hour(ts) * 60 + minute(ts))::INT AS minute, event_type || (event_id % 13)::VARCHAR AS code,
  event_id % 50 AS home, event_id % 49 AS away, event_id AS ord FROM events)"""
_HELD = """h0 AS (SELECT user_id AS team, ts::DATE AS day, event_type AS code, event_id % 3 AS opponent, CASE WHEN event_id % 3 <> 0 THEN value END AS score, event_id % 2 = 0 AS official,
  row_number() OVER (PARTITION BY user_id, ts::DATE, event_type, event_id % 3 ORDER BY event_id) AS r FROM events), h AS (SELECT * FROM h0 WHERE r = 1)"""
_FRESH = """n0 AS (SELECT user_id AS team, ts::DATE AS day, event_type AS code, event_id % 3 AS opponent, CASE WHEN event_type <> 'error' AND event_id % 2 = 0 THEN value END AS score, event_id % 4 = 0 AS official,
  row_number() OVER (PARTITION BY user_id, ts::DATE, event_type, event_id % 3 ORDER BY event_id DESC) AS r FROM events), n AS (SELECT * FROM n0 WHERE r = 1)"""
_DIST = """(CASE WHEN strpos(substr(text, pos), '{w}') > 0 THEN strpos(substr(text, pos), '{w}') - 1 END), (CASE WHEN strpos(reverse(substr(text, 1, pos + {k} - 2)), '{r}') > 0 THEN strpos(reverse(substr(text, 1, pos + {k} - 2)), '{r}') END)"""
_PROFILE = """pr AS (SELECT event_type AS profile_id, (date_diff('day', DATE '1970-01-01', ts::DATE) * 24 + hour(ts))::INT AS idx, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2),
base AS (SELECT profile_id, median(value) AS base FROM pr WHERE value > 0 GROUP BY 1),
w AS (SELECT *, lag(value) OVER v AS a, lead(value) OVER v AS c FROM pr WINDOW v AS (PARTITION BY profile_id ORDER BY idx)),
pk AS (SELECT w.profile_id, idx, value, value / base AS ratio, CASE WHEN a - 2 * value + c <> 0 THEN 0.5::DOUBLE * (a - c) / (a - 2 * value + c) ELSE 0 END AS shift
  FROM w JOIN base ON w.profile_id = base.profile_id WHERE a IS NOT NULL AND c IS NOT NULL AND value >= a AND value >= c AND value / base > 1.2::DOUBLE)"""
_TAGS = r"""regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
  '[ \t\x{A0}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^\s+|\s+$', '', 'g')"""

ORACLES = {
    "q12_programme": f"""WITH {_F}, o AS (SELECT *, row_number() OVER (PARTITION BY ground, day, minute, code, home, away ORDER BY ord) AS r FROM f)
    SELECT ground, day::VARCHAR AS day, minute, code, home, away, row_number() OVER (PARTITION BY ground, day ORDER BY minute, regexp_extract(code, '^(.*?)(\\d*)$', 1), regexp_extract(code, '(\\d+)$', 1)::INT, home, away)::INT AS slot,
      count(*) OVER (PARTITION BY ground, day) - 1 AS others FROM o WHERE r = 1""",
    "q13_dedupe_first": "SELECT source, lang, sha1(text) AS digest, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1, 2, 3",
    "q14_result_merge": f"""WITH {_HELD}, {_FRESH}
    SELECT n.team, n.day::VARCHAR AS day, n.code, n.opponent, CASE WHEN n.score IS NULL AND h.score IS NOT NULL THEN h.score ELSE n.score END AS score,
      CASE WHEN n.score IS NULL AND h.score IS NOT NULL THEN h.official ELSE n.official END AS official, n.score IS NOT NULL AND n.score IS DISTINCT FROM h.score AS changed
    FROM n LEFT JOIN h ON n.team = h.team AND n.day = h.day AND n.code = h.code AND n.opponent = h.opponent
    UNION ALL SELECT team, day::VARCHAR, code, opponent, score, official, false FROM h WHERE team NOT IN (SELECT team FROM n)""",
    "q15_stale_window": f"""WITH {_FRESH} SELECT team, count(*) AS n_stale, count(*) FILTER (score IS NULL) AS n_missing, min(day)::VARCHAR AS oldest FROM n
    WHERE day BETWEEN DATE '{TODAY}' - 10 AND DATE '{TODAY}' AND NOT official GROUP BY team""",
    "q16_search_fold": f"""WITH h AS (SELECT doc_id, source FROM documents WHERE contains(strip_accents(lower(text)), strip_accents('{SEARCH}')))
    SELECT doc_id, source, greatest((SELECT count(*) FROM h) - 40, 0) AS more FROM h ORDER BY doc_id LIMIT 40""",
    "q69_keyed_read": """WITH o AS (SELECT o_custkey, count(*) AS n, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1)
    SELECT c_custkey, concat_ws('|', c_name, coalesce(n, 0)::VARCHAR, last::VARCHAR) AS payload FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE c_acctbal < 0""",
    "q17_unique_lookup": "WITH u AS (SELECT lower(p_name) AS name, min(p_partkey) AS only_key FROM part GROUP BY 1 HAVING count(*) = 1) SELECT p_partkey, lower(p_name) AS name, only_key FROM part LEFT JOIN u ON lower(p_name) = u.name",
    "q18_colour_clash": """WITH k AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: floor((x::DOUBLE + 1) * 127.5::DOUBLE)::INT::DOUBLE) AS c FROM embeddings),
    j AS (SELECT a.vec_id, b.vec_id AS opponent, list_distance(a.c[1:3], b.c[1:3]) AS d1, list_distance(a.c[4:6], b.c[4:6]) AS d2 FROM k a JOIN k b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, opponent, d1 < 40 AND NOT d2 >= 40 AS clash, round(d1, 6) AS distance FROM j""",
    "q19_nearest_keyword": f"""WITH t AS (SELECT doc_id, text, strpos(text, 'tion') AS pos FROM documents),
    d AS (SELECT doc_id, pos, least({_DIST.format(w="and", r="dna", k=3)}) AS yes, least({_DIST.format(w="with", r="htiw", k=4)}) AS no FROM t)
    SELECT doc_id, CASE WHEN pos = 0 THEN 'unknown' WHEN no IS NULL THEN CASE WHEN yes IS NOT NULL THEN 'allowed' ELSE 'unknown' END WHEN yes IS NULL THEN 'forbidden' WHEN no <= yes THEN 'forbidden' ELSE 'allowed' END AS verdict FROM d""",
    "q20_ordered_case": """SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') OR contains(lower(p_type), 'copper') THEN 'metal' WHEN contains(lower(p_type), 'small') OR contains(lower(p_type), 'medium') THEN 'size'
      WHEN contains(lower(p_type), 'econ') OR contains(lower(p_type), 'stand') THEN 'plain' ELSE 'unknown' END AS kind FROM part""",
    "q21_link_extract": """SELECT link, count(DISTINCT page_id) AS pages, count(*) AS uses FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS link FROM pages) GROUP BY link""",
    "q22_strip_tags": f"SELECT page_id, sha1({_TAGS}) AS text_digest, length({_TAGS})::BIGINT AS n_chars FROM pages",
    "q23_season_table": """SELECT l_orderkey, l_linenumber, CASE WHEN s_acctbal > 0 THEN s_name END AS venue, (round_even(CASE WHEN p_size % 4 <> 0 THEN p_size END + 0.5::DOUBLE, 0) * round_even(p_retailprice / 100, 0))::BIGINT AS area,
      CASE WHEN least(l_quantity / 10, l_tax * 100) >= 4 THEN 'high' WHEN least(l_quantity / 10, l_tax * 100) >= 2 THEN 'medium' ELSE 'low' END AS confidence
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""",
    "q24_venue_extremes": """WITH p AS (SELECT *, p_size * round_even(p_retailprice, 0)::BIGINT AS area FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY area, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY area DESC, p_partkey) AS z FROM p),
    g AS (SELECT p_brand, count(DISTINCT area) AS n_areas, max(p_partkey) FILTER (a = 1) AS smallest, max(p_partkey) FILTER (z = 1) AS largest, min(area) AS least, max(area) AS most FROM r GROUP BY 1)
    SELECT *, round(most / least, 1) AS ratio, round(100 * most / max(most) OVER (), 1) AS share FROM g""",
    "q28_local_peaks": f"""WITH {_PROFILE}, r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY ratio DESC, idx) AS r FROM pk)
    SELECT profile_id, idx, value, round(ratio, 4) AS ratio, CASE WHEN round(shift, 4) = 0 THEN 0 ELSE round(shift, 4) END AS shift FROM r WHERE r <= 3""",
    "q29_band_pairs": f"""WITH {_PROFILE}, b AS (SELECT x.profile_id, x.idx AS i, y.idx AS j, least(x.value, y.value) AS strength FROM pk x JOIN pk y ON x.profile_id = y.profile_id AND y.idx - x.idx BETWEEN 5 AND 40),
    r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY strength DESC, i, j) AS r FROM b) SELECT profile_id, i, j, strength FROM r WHERE r = 1""",
    "q80_goal_lines": f"""WITH {_PROFILE}, s AS (SELECT profile_id, min(idx) + 24 AS a, max(idx) - 24 AS b, CASE WHEN profile_id < 'd' THEN 'start' WHEN profile_id < 'q' THEN 'end' END AS flush FROM pr GROUP BY profile_id),
    t AS (SELECT pr.*, max(value) OVER (PARTITION BY profile_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top, lag(value) OVER v AS l, lead(value) OVER v AS r FROM pr WINDOW v AS (PARTITION BY profile_id ORDER BY idx)),
    i AS (SELECT t.*, a, b, flush, median(value) OVER (PARTITION BY profile_id) AS mid FROM t JOIN s USING (profile_id) WHERE idx >= a AND idx < b),
    n AS (SELECT *, idx - CASE WHEN abs(l - 2 * value + r) >= 1e-9 THEN 0.5::DOUBLE * (r - l) / (l - 2 * value + r) ELSE 0 END AS place FROM i WHERE value >= top AND value > 1.1::DOUBLE * mid)
    SELECT x.profile_id, x.idx AS i, y.idx AS j, round(x.place, 6) AS start, round(y.place, 6) AS "end", round(least(x.value, y.value) / greatest(base, 1e-6), 1) AS strength
    FROM n x JOIN n y ON x.profile_id = y.profile_id AND y.idx - x.idx BETWEEN 300 AND 500 JOIN base ON base.profile_id = x.profile_id
    WHERE CASE x.flush WHEN 'start' THEN x.idx <= x.a + 150 WHEN 'end' THEN y.idx >= x.b - 150 ELSE true END
    QUALIFY row_number() OVER (PARTITION BY x.profile_id ORDER BY least(x.value, y.value) DESC, x.idx, y.idx) = 1""",
    "q30_nearest_peak": f"""WITH {_PROFILE}, e AS (SELECT profile_id, idx AS edge FROM pr),
    r AS (SELECT e.profile_id, edge, pk.idx, row_number() OVER (PARTITION BY e.profile_id, edge ORDER BY abs(pk.idx - edge), ratio DESC, pk.idx) AS r FROM e LEFT JOIN pk ON e.profile_id = pk.profile_id AND abs(pk.idx - edge) <= 12)
    SELECT profile_id, edge, idx, idx - edge AS offset FROM r WHERE r = 1""",
    "q31_robust_stats": """WITH c AS (SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median, quantile_cont(l_extendedprice, 0.995) AS p995, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1, 2),
    s AS (SELECT l.l_returnflag, l.l_linestatus, median(abs(l_extendedprice - c.median)) AS mad FROM lineitem l JOIN c ON l.l_returnflag = c.l_returnflag AND l.l_linestatus = c.l_linestatus GROUP BY 1, 2)
    SELECT c.l_returnflag, c.l_linestatus, round(median, 3) AS median, round(p995, 3) AS p995, round(mean, 3) AS mean, round(mad * 1.4826::DOUBLE, 3) AS sigma FROM c JOIN s ON c.l_returnflag = s.l_returnflag AND c.l_linestatus = s.l_linestatus""",
    "q32_digest": """WITH b AS (SELECT c_nationkey, c_custkey // 1000 AS b, sha1(string_agg(sha1(concat_ws('|', c_custkey, c_name, c_mktsegment)), '' ORDER BY c_custkey)) AS g, count(*) AS n FROM customer GROUP BY 1, 2)
    SELECT c_nationkey, substr(sha1(string_agg(g, '' ORDER BY b)), 1, 8) AS digest, sum(n)::BIGINT AS n FROM b GROUP BY 1""",
    "q33_calendar_rows": """SELECT event_id, strftime(date_trunc('minute', ts), '%Y%m%dT%H%M%S') AS dtstart, strftime(date_trunc('minute', ts) + INTERVAL 75 MINUTE, '%Y%m%dT%H%M%S') AS dtend,
      concat_ws('-', event_type, user_id, strftime(ts, '%Y%m%d')) AS uid FROM events""",
    "q34_code_order": """SELECT code, row_number() OVER (PARTITION BY regexp_extract(code, '^(.*?)(\\d*)$', 1) ORDER BY regexp_extract(code, '(\\d+)$', 1)::INT)::INT AS ord FROM (SELECT DISTINCT p_brand || '/P' || p_size::VARCHAR AS code FROM part)""",
    "q36_ground_fixtures_text": f"WITH {_F} SELECT ground, string_agg(day::VARCHAR || ' ' || code, ', ' ORDER BY ord) AS fixtures, count(*) AS n FROM f GROUP BY ground",
    "q38_sections": """WITH r AS (SELECT p_partkey, (p_partkey % 4000 + 5000)::DOUBLE AS fx, (p_partkey % 3000 + 5000)::DOUBLE AS fy, (p_size + 20)::DOUBLE AS fw, (p_partkey % 90 + 15)::DOUBLE AS fh,
      (p_partkey % 180)::DOUBLE AS angle, (p_partkey % 3 + 1)::INT AS n, greatest(round_even(p_size / 10 / 0.25::DOUBLE, 0)::INT, 3) | 1 AS kernel FROM part),
    t AS (SELECT *, radians(CASE WHEN fw >= fh THEN angle ELSE angle + 90 END) AS turn, unnest(generate_series(0, n - 1))::INT AS section FROM r),
    o AS (SELECT *, CASE WHEN cos(turn) < 0 THEN -1 ELSE 1 END * greatest(fw, fh) / n * (section - (n - 1) / 2) AS off FROM t)
    SELECT p_partkey, kernel, section, round(fx + cos(turn) * off, 3) AS cx, round(fy + sin(turn) * off, 3) AS cy, round(CASE WHEN fw >= fh THEN fw / n ELSE fw END, 3) AS w, round(CASE WHEN fw >= fh THEN fh ELSE fh / n END, 3) AS h FROM o""",
    "q39_chart": """WITH p AS (SELECT o_orderkey, o_orderkey % 5 + 1 AS level, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER c AS n, min(o_orderkey % 5 + 1) OVER c AS low, max(o_orderkey % 5 + 1) OVER c AS high
      FROM orders WINDOW c AS (PARTITION BY o_custkey))
    SELECT o_orderkey, round(62 + i * 590::DOUBLE / greatest(n - 1, 1), 3) AS x, round(CASE WHEN high > low THEN 18 + (level - low) * 142::DOUBLE / (high - low) ELSE 89 END, 3) AS y, i % greatest(ceil(n / 7)::BIGINT, 1) = 0 AS labelled FROM p""",
    "q35_stream_refresh": """WITH r AS (SELECT user_id AS team, event_type AS code, value AS score, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (event_type <> 'error' AND event_id % 7 <> 0) DESC, event_id DESC) AS r FROM events)
    SELECT team, code, CASE WHEN code <> 'error' AND event_id % 7 <> 0 THEN score END AS score FROM r WHERE r = 1""",
}
ORACLES["q68_gram_search"] = ORACLES["q16_search_fold"]
