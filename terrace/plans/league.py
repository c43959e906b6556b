"""League queries over the test tables, each with its SQL.

Season = half-year of the order date, family = market segment, team = customer, opponent = supplier, division = nation,
result = return flag (R won, N drawn, A lost), squad = the nation's parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.calendar import half_year
from terrace.functions.rules import career_dot, share_of
from terrace.operators import careers, meetings, squads
from terrace.operators.dedupe import compare_sets


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores where their scan has fewer splits than there are cores, as what follows parses texts row by row."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_mktsegment").alias("family"), F.col("c_custkey").alias("slug"), half_year(F.col("o_orderdate")).alias("season")).distinct()


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match for each line of an order, with a score that fits the result."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    # Orders meet their customers first: lines, which are the most, are then shuffled by order alone.
    owned = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
    flag, margin = F.col("l_returnflag"), (F.col("l_quantity") % 5).cast("int") + 1
    return joined.select(
        F.col("c_mktsegment").alias("family"),
        F.col("c_custkey").alias("slug"),
        F.col("c_nationkey").alias("division"),
        half_year(F.col("o_orderdate")).alias("season"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("l_suppkey").alias("opponent"),
        F.col("l_orderkey").alias("match_id"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_partkey") % 40).alias("player"),
        F.when(flag == "R", "W").when(flag == "N", "D").otherwise("L").alias("res"),
        (F.col("l_linenumber") + F.when(flag == "R", margin).otherwise(0)).alias("gf"),
        (F.col("l_linenumber") + F.when(flag == "A", margin).otherwise(0)).alias("ga"),
        (F.col("l_linestatus") == "F").alias("official"),
        "l_discount",
        "l_tax",
    )


P = """p AS (
  SELECT DISTINCT c_mktsegment AS family, c_custkey AS slug, (year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END)::INT AS season
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
POS = "pos AS (SELECT family, season, row_number() OVER (PARTITION BY family ORDER BY season DESC)::INT AS pos FROM (SELECT DISTINCT family, season FROM p))"
CAREER = """c1 AS (SELECT p.family, slug, p.season, pos, pos - lag(pos) OVER (PARTITION BY p.family, slug ORDER BY pos) AS step FROM p JOIN pos ON p.family = pos.family AND p.season = pos.season),
c2 AS (SELECT *, sum(CASE WHEN step > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY family, slug ORDER BY pos) AS run FROM c1),
career AS (SELECT family, slug, season, pos FROM c2 WHERE run = 0)"""
M = """m AS (
  SELECT c_mktsegment AS family, c_custkey AS slug, c_nationkey AS division, o_orderdate::DATE AS day, l_suppkey AS opponent, l_orderkey AS match_id,
    l_linenumber AS line, l_partkey % 40 AS player, (year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END)::INT AS season,
    CASE l_returnflag WHEN 'R' THEN 'W' WHEN 'N' THEN 'D' ELSE 'L' END AS res,
    l_linenumber + CASE WHEN l_returnflag = 'R' THEN (l_quantity % 5)::INT + 1 ELSE 0 END AS gf,
    l_linenumber + CASE WHEN l_returnflag = 'A' THEN (l_quantity % 5)::INT + 1 ELSE 0 END AS ga,
    l_linestatus = 'F' AS official, l_discount, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
T = """t1 AS (SELECT family, season, division, slug, count(*) AS played, count(*) FILTER (res = 'W') AS w, count(*) FILTER (res = 'D') AS d,
  count(*) FILTER (res = 'L') AS l, sum(gf)::BIGINT AS gf, sum(ga)::BIGINT AS ga FROM m WHERE official GROUP BY ALL),
t AS (SELECT *, 2 * w + d AS points, row_number() OVER (PARTITION BY family, season, division ORDER BY 2 * w + d DESC, gf - ga DESC, gf DESC, slug)::INT AS place,
  count(*) OVER (PARTITION BY family, season, division) AS out_of FROM t1)"""
LINE = "line AS (SELECT c.family, c.slug, c.season, c.pos, t.division, t.place, t.out_of, t.played, t.points, ((c.slug + c.season) % 3 + 1)::INT AS level FROM career c LEFT JOIN t ON c.family = t.family AND c.season = t.season AND c.slug = t.slug)"
CUR = "cur AS (SELECT family, max(season) AS current FROM m GROUP BY family), past AS (SELECT m.* FROM m JOIN cur ON m.family = cur.family WHERE season <> current)"


def _career(spark, sf_dir):
    p = presence(spark, sf_dir)
    positions = careers.season_positions(p)
    return careers.career(p, positions), positions


def _tables(spark, sf_dir):
    return careers.standings(matches(spark, sf_dir).filter("official"))


def _line(spark, sf_dir):
    career, positions = _career(spark, sf_dir)
    line = careers.career_line(career, _tables(spark, sf_dir))
    return line.withColumn("level", ((F.col("slug") + F.col("season")) % 3 + 1).cast("int")), positions


def q01_career_island(spark, sf_dir):
    career, _ = _career(spark, sf_dir)
    return career.groupBy("family", "slug").agg(F.count("*").alias("n_seasons"), F.min("season").alias("first_season"), F.max("season").alias("last_season"))


def q02_career_line(spark, sf_dir):
    return _line(spark, sf_dir)[0].select("family", "slug", "season", "division", "place", "out_of", "played", "points")


def q03_standings_rank(spark, sf_dir):
    return _tables(spark, sf_dir).select("family", "season", "division", "slug", "played", "w", "d", "l", F.col("gf").cast("long").alias("gf"), F.col("ga").cast("long").alias("ga"), "points", "place", "out_of")


def q04_best_worst_placing(spark, sf_dir):
    return careers.best_and_worst(_line(spark, sf_dir)[0])


def q05_bio_flags(spark, sf_dir):
    line, positions = _line(spark, sf_dir)
    return careers.biography(line, positions)


def _past(spark, sf_dir):
    m = matches(spark, sf_dir)
    return meetings.past_meetings(m, m.groupBy("family").agg(F.max("season").alias("current")))


def _tasks(spark, sf_dir):
    """Tasks for pairs of teams, of which there can be as many as lines; the count reads footers alone."""
    return meetings.tasks(spark, _read(spark, sf_dir, "lineitem").count())


def q06_h2h_balance(spark, sf_dir):
    return meetings.balance(_past(spark, sf_dir), _tasks(spark, sf_dir))


def q07_h2h_tally(spark, sf_dir):
    return meetings.tally(_past(spark, sf_dir), _tasks(spark, sf_dir)).withColumn("last_day", F.col("last_day").cast("string"))


def _squads(spark, sf_dir):
    """Line-ups and goals: teams are nations; some scorers are in no line-up."""
    m = matches(spark, sf_dir).withColumn("team", F.col("division"))
    flags = [(F.col("l_tax") > 0.07).alias("best"), (F.col("line") == 1).alias("gk"), (F.col("line") == 2).alias("cap")]
    lineups = m.filter("l_discount < 0.08").select("team", "season", "player", "match_id", "line", "day", *flags)
    goals = m.filter("official and res = 'W'").select("team", "season", "player", "match_id", "line", "day", (F.col("line") % 3 + 1).alias("goals"))
    return lineups.join(squads.eligible(lineups), "team", "left_semi"), goals.join(squads.eligible(lineups), "team", "left_semi")


SQ = """lu AS (SELECT division AS team, season, player, match_id, line, day, l_tax > 0.07 AS best, line = 1 AS gk, line = 2 AS cap FROM m WHERE l_discount < 0.08),
el AS (SELECT team FROM lu GROUP BY team HAVING count(DISTINCT match_id) >= 5),
go AS (SELECT division AS team, season, player, match_id, line, day, line % 3 + 1 AS goals FROM m WHERE official AND res = 'W'),
parts AS (SELECT team, season, player, sum(a)::BIGINT AS apps, sum(g)::BIGINT AS goals, sum(b)::BIGINT AS best, sum(k)::BIGINT AS gk, sum(c)::BIGINT AS cap FROM (
  SELECT team, season, player, 1 AS a, 0 AS g, best::INT AS b, gk::INT AS k, cap::INT AS c FROM lu
  UNION ALL SELECT team, season, player, 0, goals, 0, 0, 0 FROM go) WHERE team IN (SELECT team FROM el) GROUP BY ALL)"""


def q08_squad_partials(spark, sf_dir):
    return squads.partials(*_squads(spark, sf_dir))


RANGE = (3999, 3994)


def q09_squad_range_rollup(spark, sf_dir):
    return squads.roll_up(squads.partials(*_squads(spark, sf_dir)), *RANGE)


def q10_extreme_match(spark, sf_dir):
    return meetings.extremes(matches(spark, sf_dir))


def q11_player_ordinal(spark, sf_dir):
    return squads.ordinals(*_squads(spark, sf_dir))


def q25_opt_out(spark, sf_dir):
    lineups, goals = _squads(spark, sf_dir)
    out = lineups.sparkSession.range(0, 40, 7).select(F.col("id").alias("player"))
    return squads.partials(lineups, goals, out)


def q26_season_pruning(spark, sf_dir):
    archive = presence(spark, sf_dir).select("slug", "season", ((F.col("slug") + F.col("season")) % 3).alias("division"))
    fixtures = archive.select("slug").distinct().withColumn("opponent", F.col("slug") + 3)
    kept, _ = _career(spark, sf_dir)
    return careers.shared_seasons(archive, fixtures, kept, archive.agg(F.max("season").alias("season")))


def q27_set_ops(spark, sf_dir):
    """Suppliers per segment: in either of two years, in both, and only in the first; and whether the second covers the first."""
    m = matches(spark, sf_dir)
    return compare_sets(m, ["family"], "opponent", F.year("day") == 1996, F.year("day") == 1997)


def q37_share_and_dots(spark, sf_dir):
    career, _ = _career(spark, sf_dir)
    within = squads.in_range(F.col("season"), *RANGE)
    line = careers.career_line(career.filter(within), careers.standings(matches(spark, sf_dir).filter(within & F.col("official"))))
    most = line.groupBy("family").agg(F.max("points").alias("most"))
    return line.join(most, "family").select("family", "slug", "season", career_dot(F.col("place"), F.col("out_of")).alias("dot"), share_of(F.col("points"), F.col("most")).alias("share"))


QUERIES = {f.__name__: f for f in (q01_career_island, q02_career_line, q03_standings_rank, q04_best_worst_placing, q05_bio_flags, q06_h2h_balance, q07_h2h_tally, q08_squad_partials, q09_squad_range_rollup, q10_extreme_match, q11_player_ordinal, q25_opt_out, q26_season_pruning, q27_set_ops, q37_share_and_dots)}

_L = f"WITH {P}, {POS}, {CAREER}, {M}, {T}, {LINE} "
ORACLES = {
    "q01_career_island": f"WITH {P}, {POS}, {CAREER} SELECT family, slug, count(*) AS n_seasons, min(season) AS first_season, max(season) AS last_season FROM career GROUP BY ALL",
    "q02_career_line": _L + "SELECT family, slug, season, division, place, out_of, played, points FROM line",
    "q03_standings_rank": f"WITH {M}, {T} SELECT family, season, division, slug, played, w, d, l, gf, ga, points, place, out_of FROM t",
    "q04_best_worst_placing": _L + """, r AS (SELECT *, row_number() OVER (PARTITION BY family, slug ORDER BY level, place, season DESC) AS a,
      row_number() OVER (PARTITION BY family, slug ORDER BY level DESC, place DESC, season DESC) AS z FROM line WHERE place IS NOT NULL)
    SELECT family, slug, max(level) FILTER (a = 1) AS best_level, max(place) FILTER (a = 1) AS best_place, max(season) FILTER (a = 1) AS best_season,
      max(level) FILTER (z = 1) AS worst_level, max(place) FILTER (z = 1) AS worst_place, max(season) FILTER (z = 1) AS worst_season,
      count(*) FILTER (place = 1) AS titles, max(season) FILTER (place = 1) AS last_title FROM r GROUP BY family, slug""",
    "q05_bio_flags": _L + """, r AS (SELECT *, lead(level) OVER (PARTITION BY family, slug ORDER BY pos) AS prev, row_number() OVER (PARTITION BY family, slug ORDER BY pos) AS r FROM line),
    g AS (SELECT family, slug, count(*) AS n, min(season) AS oldest, max(CASE WHEN r = 1 AND prev <> level THEN prev END) AS previous_level, min(level) AS high_level, max(level) AS lo,
      max(pos) AS last_pos, max(pos) - min(pos) + 1 <> count(*) AS has_gap FROM r GROUP BY family, slug),
    h AS (SELECT r.family, r.slug, max(season) AS high_season FROM r JOIN g ON r.family = g.family AND r.slug = g.slug AND r.level = g.high_level GROUP BY ALL),
    e AS (SELECT family, max(pos) AS first_pos FROM pos GROUP BY family)
    SELECT g.family, g.slug, n, oldest, previous_level, high_level, high_season, CASE WHEN lo <> high_level THEN lo END AS low_level, last_pos = first_pos AS from_start, has_gap
    FROM g JOIN h ON g.family = h.family AND g.slug = h.slug JOIN e ON g.family = e.family""",
    "q06_h2h_balance": f"WITH {M}, {CUR} SELECT family, slug, opponent, count(*) AS n, count(*) FILTER (res = 'W') AS w, count(*) FILTER (res = 'D') AS d, count(*) FILTER (res = 'L') AS l FROM past GROUP BY ALL",
    "q07_h2h_tally": f"WITH {M}, {CUR} SELECT family, slug, opponent, count(*) AS n, count(*) FILTER (res = 'W') AS w, count(*) FILTER (res = 'D') AS d, sum(gf)::BIGINT AS gf, sum(ga)::BIGINT AS ga, max(day)::VARCHAR AS last_day, count(*) FILTER (res = 'L') AS l FROM past GROUP BY family, slug, opponent",
    "q08_squad_partials": f"WITH {M}, {SQ} SELECT * FROM parts",
    "q09_squad_range_rollup": f"""WITH {M}, {SQ}, r AS (SELECT team, player, sum(apps)::BIGINT AS apps, sum(goals)::BIGINT AS goals, sum(best)::BIGINT AS best, sum(gk)::BIGINT AS gk, sum(cap)::BIGINT AS cap,
      min(season) AS first_season, max(season) AS last_season FROM parts WHERE season BETWEEN 3994 AND 3999 GROUP BY team, player)
    SELECT * FROM (SELECT *, sum(CASE WHEN apps = 0 THEN goals ELSE 0 END) OVER (PARTITION BY team)::BIGINT AS own_goals FROM r) WHERE apps > 0""",
    "q10_extreme_match": f"""WITH {M}, r AS (SELECT *, gf - ga AS margin, row_number() OVER (PARTITION BY family, slug, season ORDER BY gf - ga DESC, day, match_id, line) AS b,
      row_number() OVER (PARTITION BY family, slug, season ORDER BY gf - ga, day, match_id, line) AS w FROM m)
    SELECT family, slug, season, max(match_id) FILTER (b = 1) AS best_match, max(margin) FILTER (b = 1) AS best_margin, max(match_id) FILTER (w = 1) AS worst_match, max(margin) FILTER (w = 1) AS worst_margin FROM r GROUP BY ALL""",
    "q11_player_ordinal": f"""WITH {M}, {SQ}, f AS (SELECT team, player, day, 0 AS kind, match_id, line FROM lu UNION ALL SELECT team, player, day, 1, match_id, line FROM go),
    g AS (SELECT *, row_number() OVER (PARTITION BY team, player ORDER BY day, kind, match_id, line) AS r FROM f WHERE team IN (SELECT team FROM el))
    SELECT team, player, dense_rank() OVER (PARTITION BY team ORDER BY day, kind, match_id, line)::INT AS ordinal FROM g WHERE r = 1""",
    "q25_opt_out": f"WITH {M}, {SQ} SELECT * FROM parts WHERE player % 7 <> 0",
    "q26_season_pruning": f"""WITH {P}, {POS}, {CAREER}, a AS (SELECT DISTINCT slug, season, (slug + season) % 3 AS division FROM p)
    SELECT DISTINCT x.slug, x.season FROM a x WHERE EXISTS (SELECT 1 FROM a y WHERE y.slug = x.slug + 3 AND y.season = x.season AND y.division = x.division)
      AND season < (SELECT max(season) FROM a) AND EXISTS (SELECT 1 FROM career c WHERE c.slug = x.slug AND c.season = x.season)""",
    "q27_set_ops": f"""WITH {M}, a AS (SELECT DISTINCT family, opponent FROM m WHERE year(day) = 1996), b AS (SELECT DISTINCT family, opponent FROM m WHERE year(day) = 1997),
    j AS (SELECT coalesce(a.family, b.family) AS family, a.opponent AS x, b.opponent AS y FROM a FULL JOIN b ON a.family = b.family AND a.opponent = b.opponent)
    SELECT family, count(*) AS either, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS "both", count(*) FILTER (y IS NULL) AS only_first, count(*) FILTER (y IS NULL) = 0 AS complete
    FROM j GROUP BY family HAVING count(x) > 0 AND count(y) > 0""",
    "q37_share_and_dots": _L + """, f AS (SELECT *, max(points) OVER (PARTITION BY family) AS most FROM line WHERE season BETWEEN 3994 AND 3999)
    SELECT family, slug, season, CASE WHEN place IS NULL THEN 'no table' WHEN place = 1 THEN 'first' WHEN place <= 3 THEN 'top three' WHEN place = out_of THEN 'last' ELSE 'other' END AS dot,
      round(100 * points / most, 1) AS share FROM f""",
}
