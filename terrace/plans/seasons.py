"""Queries of seasons, squads, grounds, texts and publishing over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions import calendar, rules, text
from terrace.operators import dedupe, meetings, merge, programme, squads
from terrace.plans import publish
from terrace.plans.league import CUR, M, RANGE, SQ, _past, _read, _squads, _tasks, matches, spread
from terrace.sources.documents import FilledTable, seasons_by_family
from terrace.streaming.refresh import shared_root


def _side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).withColumn("team", F.col("division"))


def q40_footwear(spark, sf_dir):
    """Ground notes made of a part's name and one of eight lines: their footwear rule and their surface."""
    line = F.get(F.array(*map(F.lit, LINES)), (F.col("p_partkey") % len(LINES)).cast("int"))
    notes = F.concat_ws("\n", "p_name", line, "p_type")
    p = spread(_read(spark, sf_dir, "part")).select("p_partkey", rules.footwear(notes).alias("f"), rules.surface(F.concat_ws(" ", "p_name", line)).alias("surface"))
    return p.select("p_partkey", "f.text", "f.studs", "f.artificial", "f.summary", "surface", rules.boots_label(F.col("f.studs")).alias("label"))


LINES = [
    "Obuv: kopačky povoleny i s lisovanými kolíky",
    " OBUV povoleny turfy a AG, zakázány lisovky",
    "Povrch: umělá tráva UMT",
    "obuv zakázány lisovky, AG; povolena sálová",
    "Obuv: lisovky",
    "škvára, obuv libovolná",
    "Obuv: magnet lisovky povoleny, ag zakázán",
    "přírodní tráva",
]


def q41_squad_range_totals(spark, sf_dir):
    totals = squads.range_totals(squads.season_records(_side(spark, sf_dir)), *RANGE)
    extreme = [F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in ("biggest", "worst") for x in ("margin", "season")]
    return totals.select("team", "n", "w", "d", "l", F.col("gf").cast("long").alias("gf"), F.col("ga").cast("long").alias("ga"), *extreme)


def q42_squad_order(spark, sf_dir):
    """Places in a squad by default, and by goals with ties by appearances in the same direction."""
    rolled = squads.roll_up(squads.partials(*_squads(spark, sf_dir)), *RANGE)
    team = Window.partitionBy("team")
    place = lambda order: F.row_number().over(team.orderBy(*order))
    by_goals = [*squads.squad_order("goals", False), F.asc("player")]
    return rolled.select("team", "player", place(squads.default_order()).alias("place"), place(by_goals).alias("by_goals"))


def q43_team_summaries(spark, sf_dir):
    """Lines as fixtures of customers on grounds that are parts; every fourth part size is not measured."""
    return programme.team_summaries(_placed(spark, sf_dir))


def _placed(spark, sf_dir):
    m = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    score = F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))
    fixtures = m.select(F.col("o_custkey").alias("team"), F.col("l_suppkey").alias("opponent"), F.col("l_partkey").alias("code"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), score.alias("score"), (F.col("l_linestatus") == "F").alias("official"), F.when(F.col("l_returnflag") == "R", "W").when(F.col("l_returnflag") == "A", F.when(F.col("l_quantity") > 25, "L").otherwise("D")).alias("res"), (F.col("l_suppkey") % 2 == 0).alias("met"))
    measured = lambda c: F.when(F.col("p_size") % 4 != 0, F.col(c))
    venues = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), measured("p_name").alias("name"), measured("p_size").alias("area"))
    return programme.placed(fixtures, venues)


def q44_ground_names(spark, sf_dir):
    return _placed(spark, sf_dir).groupBy("code", "ground").agg(F.count("*").alias("n"), F.max("area").alias("area"))


def q45_grounds_by_area(spark, sf_dir):
    return programme.grounds_by_area(_placed(spark, sf_dir), "pos")


def q46_meeting_lists(spark, sf_dir):
    """Pairs of this season with what happened before, as text."""
    m = matches(spark, sf_dir)
    current = m.groupBy("family").agg(F.max("season").alias("season"))
    fixtures = m.join(F.broadcast(current), ["family", "season"]).select("family", "slug", "opponent").distinct()
    lists = meetings.meeting_lists(fixtures, _past(spark, sf_dir))
    shown = F.array_join(F.transform("meetings", lambda x: F.concat_ws(" ", x["day"].cast("string"), x["match_id"].cast("string"), F.concat_ws(":", x["gf"].cast("string"), x["ga"].cast("string")), x["res"])), "; ")
    return lists.select("family", "slug", "opponent", "w", "d", "l", shown.alias("meetings"))


def q47_chosen_teams(spark, sf_dir):
    """Teams of one family with a fixture, the first hundred by slug."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("team"), F.col("c_mktsegment").alias("family"), F.col("c_nationkey").alias("code"))
    fixtures = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("team"))
    return programme.chosen(programme.with_fixtures(c, fixtures), codes=list(range(10)), family="BUILDING", limit=100, order=("team",))


def q48_team_opt_out(spark, sf_dir):
    lineups, goals = _squads(spark, sf_dir)
    teams = spark.range(0, 25, 4).select(F.col("id").alias("team"))
    return squads.partials(lineups, goals, opted_teams=teams)


def q49_season_texts(spark, sf_dir):
    """Season ids made of an order's half-year and priority, and what is read from them."""
    o = _read(spark, sf_dir, "orders")
    half = F.when(F.month("o_orderdate") > 6, calendar.AUTUMN).otherwise(calendar.SPRING)
    fam = F.get(F.array(*map(F.lit, ["mestska-liga", "veteranska-liga", "superveteranska-liga", "ultraveteranska-liga"])), (F.col("o_orderkey") % 4).cast("int"))
    o = o.select("o_orderkey", F.concat_ws("-", F.year("o_orderdate").cast("string"), fam, half).alias("s"), F.concat_ws("-", (F.col("o_custkey") % 8 + 1).cast("string"), F.when(F.col("o_custkey") % 3 == 0, "a")).alias("division"), F.col("o_orderdate").cast("date").alias("day"))
    c = F.col
    return o.select("o_orderkey", calendar.family(c("s")).alias("family"), calendar.season_order(c("s")).alias("ord"), calendar.season_code(c("s")).alias("code"), calendar.season_label(c("s")).alias("label"), calendar.level(c("division")).alias("level"), calendar.division_label(c("s"), c("division")).alias("shown"), calendar.is_lettered(c("division")).alias("lettered"), calendar.day_display(c("day")).alias("day"))


def q50_parsed_days(spark, sf_dir):
    """Dates and times of orders in the forms that pages use, read again."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.concat(F.lpad((F.col("o_custkey") % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0")).alias("time"))
    forms = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("day", "'Po' d.M.yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("day", "d. M. yyyy")).otherwise(F.lit("31.2.2024"))
    start, end = calendar.slot(F.col("day"), F.col("time"))
    stamp = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm")
    return o.select("o_orderkey", calendar.parse_day(forms).cast("string").alias("day"), calendar.minutes(F.col("time")).alias("minutes"), stamp(start).alias("dtstart"), stamp(end).alias("dtend"))


def q51_text_keys(spark, sf_dir):
    name = F.concat(F.lit("Šťastný & "), F.col("c_name"), F.lit(' <Č>, "x"; (Brno)'))
    c = _read(spark, sf_dir, "customer").select("c_custkey", name.alias("n"))
    n = F.col("n")
    return c.select("c_custkey", text.key(n).alias("key"), text.ascii_id(n).alias("ascii_id"), text.html_escape(n).alias("escaped"), text.surname_key(n).alias("surname"), text.calendar_escape(n).alias("calendar"), text.label_lookup_key(n).alias("lookup"))


def q52_scores(spark, sf_dir):
    """Scores of lines as text, read from one side, and what pages say of them."""
    line = _read(spark, sf_dir, "lineitem")
    score = F.when(F.col("l_returnflag") != "N", F.concat_ws(" : ", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"))).otherwise("-")
    style = F.when(F.col("l_linestatus") == "F", "cell is-result").otherwise("cell is-result is-gray")
    rows = line.select("l_orderkey", "l_linenumber", score.alias("score"), (F.col("l_suppkey") % 2 == 0).alias("home"), style.alias("style"), (F.col("l_partkey") % 12).alias("k"), (F.col("l_suppkey") % 20).alias("m"))
    gf, ga = rules.score_side(F.col("score"), F.col("home"))
    c = F.col
    return rows.select("l_orderkey", "l_linenumber", gf.alias("gf"), ga.alias("ga"), rules.result(gf, ga).alias("res"), rules.is_official(c("style"), c("score")).alias("official"), rules.keeper_badge(c("k"), c("m")).alias("keeper"), rules.captain_badge(c("k"), c("m")).alias("captain"), rules.compass(c("k") - 6, c("m") - 9).alias("side"))


def q53_published(spark, sf_dir):
    """Customers of a nation as named payloads and as rows of Markdown."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name", "c_nationkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("segment"))
    lines = publish.markdown_rows(c, ["id", "c_name", "segment"])
    named = publish.payloads(c, "id")
    named = named.select("id", publish.content_name(F.col("id"), F.col("payload")).alias("name"), F.sha1("payload").alias("payload_digest"))
    return named.join(lines.select("line", F.regexp_extract("line", r"^\| (\d+) ", 1).alias("id")), "id")


def q54_calendar_text(spark, sf_dir):
    """Orders as fixtures in calendars of customers, by digest of the text."""
    o = spread(_read(spark, sf_dir, "orders"))
    f = o.select(F.col("o_custkey").cast("string").alias("team"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("opponent"), F.col("o_orderdate").cast("date").alias("day"), F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":30")).alias("time"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("Hall, "), F.col("o_orderpriority"))).alias("ground"), (F.col("o_orderkey") % 2 == 0).alias("home"))
    return publish.calendars(f).select("team", F.sha1("calendar").alias("digest"), F.char_length("calendar").cast("long").alias("n_chars"))


def q55_coverage(spark, sf_dir):
    return publish.coverage(_placed(spark, sf_dir).withColumn("official", F.coalesce("official", F.lit(False))), _tasks(spark, sf_dir))


def q56_refreshed_archive(spark, sf_dir):
    """Held orders with fresh ones over them by key, and fresh half-years, a customer's first order each, in the place of held ones."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", calendar.half_year(F.col("o_orderdate")).alias("season"), F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    fresh = o.join(F.broadcast(o.agg((F.max("season") - 1).alias("since"))), F.col("season") >= F.col("since")).drop("since")
    again = fresh.withColumn("o_totalprice", F.lit(0).cast(o.schema["o_totalprice"].dataType))
    merged = dedupe.top_up(merge.upsert(o, again, ["o_orderkey"]), dedupe.first_by(fresh, ["season", "o_custkey"], "o_orderkey").select(*o.columns), "season", "day")
    return dedupe.assert_unique(merged, ["o_orderkey"]).groupBy("season").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") == 0).alias("n_zero"), F.max("day").cast("string").alias("newest"))


def q57_overlay(spark, sf_dir):
    """Suppliers as grounds, with customers' rows laid over those of three times their number; keys of comments start with _."""
    key = lambda k: F.concat(F.when(F.col(k) % 10 == 0, "_").otherwise(""), F.lit("G"), F.col(k).cast("string"))
    base = _read(spark, sf_dir, "supplier").select(key("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("area"))
    extra = _read(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") * 3).select(key("k").alias("code"), F.col("c_name").alias("name"))
    return dedupe.overlay(base, extra, "code")


def q58_release_digest(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("|", "c_custkey", "c_name").alias("payload"))
    return publish.digest_tree(c, [], F.floor(F.col("id") / 1000), "id", "payload")


def q81_filled_archive(spark, sf_dir):
    """Orders by customer and half-year, kept in a table that is filled on demand: first for one segment, then for who is still missing."""
    customers = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("team"), "c_mktsegment")
    orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("team"), calendar.half_year(F.col("o_orderdate")).alias("season"))
    archive = FilledTable(spark, f"{shared_root(spark)}/archive", "team", "team long, season int, n long")
    fill = lambda keys: orders.join(keys, "team", "left_semi").groupBy("team", "season").agg(F.count("*").alias("n"))
    archive.get(customers.filter("c_mktsegment = 'BUILDING'"), fill)
    return archive.get(customers, fill).select("team", "season", "n")


def q82_seasons_by_family(spark, sf_dir):
    """Half-years in which a segment's customers ordered, newest first."""
    o = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    index = o.select(F.col("c_mktsegment").alias("family"), calendar.half_year(F.col("o_orderdate")).alias("ord")).distinct()
    index = index.withColumn("season", F.concat_ws("-", "family", F.col("ord").cast("string")))
    return seasons_by_family(index, "family", "season", "ord").select("family", F.array_join("seasons", ",").alias("seasons"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] == "q" and n[1:3].isdigit()}

_RES = "CASE WHEN l_returnflag = 'R' THEN 'W' WHEN l_returnflag = 'A' THEN CASE WHEN l_quantity > 25 THEN 'L' ELSE 'D' END END"
_PL = f"""fx AS (SELECT o_custkey AS team, l_suppkey AS opponent, l_partkey AS code, l_orderkey * 8 + l_linenumber AS pos, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS score,
  l_linestatus = 'F' AS official, {_RES} AS res, l_suppkey % 2 = 0 AS met, coalesce(CASE WHEN p_size % 4 <> 0 THEN p_name END, l_partkey::VARCHAR) AS ground, CASE WHEN p_size % 4 <> 0 THEN p_size END AS area
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey)"""
_SIDE = f"""{M}, s AS (SELECT *, division AS team, gf - ga AS margin FROM m), sr AS (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY margin DESC, day, match_id, line) AS b,
  row_number() OVER (PARTITION BY team, season ORDER BY margin, day, match_id, line) AS z FROM s WHERE season BETWEEN 3994 AND 3999),
rec AS (SELECT team, season, count(*) AS n, count(*) FILTER (res = 'W') AS w, count(*) FILTER (res = 'D') AS d, count(*) FILTER (res = 'L') AS l, sum(gf)::BIGINT AS gf, sum(ga)::BIGINT AS ga,
  max(margin) FILTER (b = 1) AS bm, max(margin) FILTER (z = 1) AS wm FROM sr GROUP BY team, season)"""
_ROLL = f"""WITH {M}, {SQ}, r AS (SELECT team, player, sum(apps)::BIGINT AS apps, sum(goals)::BIGINT AS goals FROM parts WHERE season BETWEEN 3994 AND 3999 GROUP BY team, player)"""
_LINES = "[" + ", ".join(f"'{x}'" for x in LINES) + "]"
_NEAR = """least((CASE WHEN strpos(substr(t, {at}), '{w}') > 0 THEN strpos(substr(t, {at}), '{w}') - 1 END), (CASE WHEN strpos(reverse(substr(t, 1, {at} + {k} - 2)), '{r}') > 0 THEN strpos(reverse(substr(t, 1, {at} + {k} - 2)), '{r}') END))"""


def _verdict(at: str) -> str:
    yes, no = _NEAR.format(at=at, w="povolen", k=7, r="nelovop"), _NEAR.format(at=at, w="zakazan", k=7, r="nazakaz")
    return f"CASE WHEN t IS NULL OR {at} = 0 THEN 'unknown' WHEN {no} IS NULL THEN CASE WHEN {yes} IS NOT NULL THEN 'allowed' ELSE 'unknown' END WHEN {yes} IS NULL THEN 'forbidden' WHEN {no} <= {yes} THEN 'forbidden' ELSE 'allowed' END"


_NAME = """'Šťastný & ' || c_name || ' <Č>, "x"; (Brno)'"""
_FOLDED = f"strip_accents(lower({_NAME}))"

ORACLES = {
    "q40_footwear": f"""WITH a AS (SELECT p_partkey, p_name, {_LINES}[p_partkey % 8 + 1] AS line FROM part),
    b AS (SELECT *, CASE WHEN starts_with(strip_accents(lower(p_name)), 'obuv') THEN trim(p_name) WHEN starts_with(strip_accents(lower(line)), 'obuv') THEN trim(line) END AS text FROM a),
    c AS (SELECT *, strip_accents(lower(text)) AS t, strip_accents(lower(p_name || ' ' || line)) AS n FROM b),
    d AS (SELECT *, strpos(t, 'lisov') AS x, CASE WHEN regexp_matches(t, '\\bag\\b') THEN length(regexp_extract(t, '^(.*?)\\bag\\b', 1)) + 1 ELSE 0 END AS y FROM c),
    e AS (SELECT *, {_verdict("x")} AS studs, {_verdict("y")} AS artificial FROM d)
    SELECT p_partkey, coalesce(text, '') AS text, studs, artificial, CASE WHEN text IS NULL THEN '' WHEN studs = 'allowed' THEN 'lisovky OK' WHEN artificial = 'forbidden' THEN 'turf / indoor only'
      WHEN artificial = 'allowed' THEN 'AG or turf, no lisovky' ELSE 'no lisovky' END AS summary, CASE WHEN contains(n, 'umela') OR contains(n, 'umt') THEN 'artificial' WHEN contains(n, 'skvara') OR contains(n, 'antuka') THEN 'gravel/clay'
      WHEN contains(n, 'prirodni') OR contains(n, 'trava') THEN 'grass' ELSE 'unknown' END AS surface, CASE studs WHEN 'allowed' THEN 'studs' WHEN 'forbidden' THEN 'no studs' ELSE '' END AS label FROM e""",
    "q41_squad_range_totals": f"""WITH {_SIDE} SELECT team, sum(n)::BIGINT AS n, sum(w)::BIGINT AS w, sum(d)::BIGINT AS d, sum(l)::BIGINT AS l, sum(gf)::BIGINT AS gf, sum(ga)::BIGINT AS ga, max(bm) AS biggest_margin, arg_max(season, bm * 100000 - season) AS biggest_season,
      min(wm) AS worst_margin, arg_min(season, wm * 100000 + season) AS worst_season FROM rec GROUP BY team""",
    "q42_squad_order": f"""{_ROLL} SELECT team, player, row_number() OVER (PARTITION BY team ORDER BY apps DESC, goals DESC, player)::INT AS place, row_number() OVER (PARTITION BY team ORDER BY goals, apps, player)::INT AS by_goals FROM r WHERE apps > 0""",
    "q43_team_summaries": f"""WITH {_PL} SELECT team, count(res) AS played, count(*) FILTER (res = 'W') AS w, count(*) FILTER (res = 'D') AS d, count(*) FILTER (res = 'L') AS l, count(*) FILTER (score IS NOT NULL AND NOT official) AS provisional,
      count(DISTINCT CASE WHEN met THEN opponent END) AS met, count(*) FILTER (area IS NULL) AS unmeasured, round(max(area) / min(area), 1) AS ratio FROM fx GROUP BY team""",
    "q44_ground_names": f"WITH {_PL} SELECT code, ground, count(*) AS n, max(area) AS area FROM fx GROUP BY code, ground",
    "q45_grounds_by_area": f"WITH {_PL}, g AS (SELECT team, code, max(area) AS area, min(pos) AS pos FROM fx WHERE area IS NOT NULL GROUP BY team, code) SELECT team, code, area, row_number() OVER (PARTITION BY team ORDER BY area DESC, pos, code)::INT AS place FROM g",
    "q46_meeting_lists": f"""WITH {M}, {CUR}, fx AS (SELECT DISTINCT m.family, slug, opponent FROM m JOIN cur ON m.family = cur.family AND season = current)
    SELECT family, slug, opponent, count(*) FILTER (res = 'W')::INT AS w, count(*) FILTER (res = 'D')::INT AS d, count(*) FILTER (res = 'L')::INT AS l,
      string_agg(day::VARCHAR || ' ' || match_id::VARCHAR || ' ' || gf::VARCHAR || ':' || ga::VARCHAR || ' ' || res, '; ' ORDER BY day, match_id, line, gf, ga, res) AS meetings FROM past JOIN fx USING (family, slug, opponent) GROUP BY family, slug, opponent""",
    "q47_chosen_teams": "SELECT c_custkey AS team, c_mktsegment AS family, c_nationkey AS code FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 10 AND c_custkey IN (SELECT o_custkey FROM orders) ORDER BY 1 LIMIT 100",
    "q48_team_opt_out": f"WITH {M}, {SQ} SELECT * FROM parts WHERE team % 4 <> 0",
    "q49_season_texts": """WITH s AS (SELECT o_orderkey, ['mestska-liga', 'veteranska-liga', 'superveteranska-liga', 'ultraveteranska-liga'][o_orderkey % 4 + 1] AS family, year(o_orderdate) AS y, month(o_orderdate) > 6 AS autumn, o_custkey % 8 + 1 AS level, o_custkey % 3 = 0 AS lettered, o_orderdate::DATE AS d FROM orders),
    t AS (SELECT *, level::VARCHAR || CASE WHEN lettered THEN '-a' ELSE '' END AS division FROM s)
    SELECT o_orderkey, family, (y * 2 + autumn::INT)::INT AS ord, CASE WHEN autumn THEN 'p' ELSE 'j' END || y::VARCHAR AS code, CASE WHEN autumn THEN 'podzim ' ELSE 'jaro ' END || y::VARCHAR AS label, level::INT AS level,
      division || CASE o_orderkey % 4 WHEN 2 THEN ' super' WHEN 3 THEN ' ultra' WHEN 1 THEN ' vet' ELSE '' END AS shown, lettered, day(d)::VARCHAR || '. ' || month(d)::VARCHAR || '. ' || y::VARCHAR AS day FROM t""",
    "q50_parsed_days": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, ((o_custkey % 24) * 60 + o_custkey % 60)::INT AS minutes FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN d::VARCHAR END AS day, minutes, strftime(d + to_minutes(minutes), '%Y-%m-%d %H:%M') AS dtstart, strftime(d + to_minutes(minutes + 75), '%Y-%m-%d %H:%M') AS dtend FROM o""",
    "q51_text_keys": f"""SELECT c_custkey, regexp_replace({_FOLDED}, '[^a-z0-9]+', '', 'g') AS key, regexp_replace(regexp_replace({_FOLDED}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS ascii_id,
      replace(replace(replace(replace({_NAME}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, '(Brno) ' || {_NAME} AS surname, replace(replace({_NAME}, ';', '\\;'), ',', '\\,') AS calendar,
      trim(strip_accents(lower(replace({_NAME}, ' (Brno)', '')))) AS lookup FROM customer""",
    "q52_scores": """WITH r AS (SELECT *, l_returnflag <> 'N' AS known, l_suppkey % 2 = 0 AS home, l_quantity::INT AS q, l_linenumber::INT AS n, l_partkey % 12 AS k, l_suppkey % 20 AS m FROM lineitem),
    s AS (SELECT *, CASE WHEN known THEN CASE WHEN home THEN q ELSE n END END AS gf, CASE WHEN known THEN CASE WHEN home THEN n ELSE q END END AS ga FROM r)
    SELECT l_orderkey, l_linenumber, gf, ga, CASE WHEN gf > ga THEN 'W' WHEN gf = ga THEN 'D' WHEN gf < ga THEN 'L' END AS res, l_linestatus = 'F' AS official, k >= 5 AND 2 * k >= m AS keeper, k >= 5 AND 5 * k >= m AS captain,
      CASE WHEN abs(k - 6) >= abs(m - 9) THEN CASE WHEN k > 6 THEN 'E' ELSE 'W' END WHEN m > 9 THEN 'S' ELSE 'N' END AS side FROM s""",
    "q53_published": """WITH c AS (SELECT c_custkey::VARCHAR AS id, c_name, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS seg, '{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey::VARCHAR || CASE WHEN c_custkey % 5 > 0 THEN ',"segment":"' || c_mktsegment || '"' ELSE '' END || '}' AS payload FROM customer)
    SELECT id, id || '.' || substr(sha1(payload), 1, 8) || '.json' AS name, sha1(payload) AS payload_digest, '| ' || id || ' | ' || c_name || ' | ' || coalesce(seg, '') || ' |' AS line FROM c""",
    "q54_calendar_text": r"""WITH f AS (SELECT o_custkey::VARCHAR AS team, 'O' || o_orderkey::VARCHAR AS opponent, o_orderdate::DATE AS d, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':30' AS t, (o_orderkey % 24) * 60 + 30 AS mi, o_orderkey % 2 = 0 AS home, CASE WHEN o_orderkey % 3 > 0 THEN 'Hall\, ' || o_orderpriority ELSE '' END AS g FROM orders),
    e AS (SELECT team, d::VARCHAR || ' ' || t || ' ' || opponent AS k, array_to_string(['BEGIN:VEVENT', 'UID:' || team || '-' || lower(opponent) || '-' || strftime(d, '%Y%m%d'), 'DTSTART:' || strftime(d + to_minutes(mi::INT), '%Y%m%dT%H%M%S'), 'DTEND:' || strftime(d + to_minutes(mi::INT + 75), '%Y%m%dT%H%M%S'),
      'SUMMARY:' || CASE WHEN home THEN team || ' – ' || opponent ELSE opponent || ' – ' || team END, 'LOCATION:' || g, 'END:VEVENT'], chr(13) || chr(10)) AS event FROM f),
    c AS (SELECT team, array_to_string(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//terrace//fixtures//EN', string_agg(event, chr(13) || chr(10) ORDER BY k), 'END:VCALENDAR' || chr(13) || chr(10)], chr(13) || chr(10)) AS calendar FROM e GROUP BY team)
    SELECT team, sha1(calendar) AS digest, length(calendar)::BIGINT AS n_chars FROM c""",
    "q55_coverage": f"WITH {_PL} SELECT count(DISTINCT team) AS teams, count(*) AS fixtures, count(score) AS scores, count(*) FILTER (official AND score IS NOT NULL) AS official, count(DISTINCT code) AS codes FROM fx",
    "q56_refreshed_archive": """WITH o AS (SELECT *, (year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END)::INT AS season FROM orders), mx AS (SELECT max(season) - 1 AS since FROM o),
    r AS (SELECT *, row_number() OVER (PARTITION BY season, o_custkey ORDER BY o_orderkey) AS nth FROM o)
    SELECT season, count(*) AS n, count(*) FILTER (o_totalprice = 0) AS n_zero, max(o_orderdate)::DATE::VARCHAR AS newest FROM r, mx WHERE season < since OR nth = 1 GROUP BY season""",
    "q57_overlay": """WITH b AS (SELECT 'G' || s_suppkey::VARCHAR AS code, s_name AS name, s_nationkey AS area FROM supplier WHERE s_suppkey % 10 <> 0), x AS (SELECT 'G' || (c_custkey * 3)::VARCHAR AS code, c_name AS name FROM customer WHERE c_custkey * 3 % 10 <> 0)
    SELECT coalesce(x.code, b.code) AS code, coalesce(x.name, b.name) AS name, CASE WHEN x.code IS NULL THEN area END AS area FROM b FULL JOIN x ON b.code = x.code""",
    "q58_release_digest": """WITH p AS (SELECT c_custkey // 1000 AS b, sha1(string_agg(sha1(concat_ws('|', c_custkey, c_name)), '' ORDER BY c_custkey)) AS g, count(*) AS n FROM customer GROUP BY 1) SELECT substr(sha1(string_agg(g, '' ORDER BY b)), 1, 8) AS digest, sum(n)::BIGINT AS n FROM p""",
    "q81_filled_archive": """SELECT o_custkey AS team, (year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END)::INT AS season, count(*) AS n FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1, 2""",
    "q82_seasons_by_family": """WITH i AS (SELECT DISTINCT c_mktsegment AS family, (year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END)::INT AS ord FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT family, string_agg(family || '-' || ord, ',' ORDER BY ord DESC) AS seasons FROM i GROUP BY family""",
}
