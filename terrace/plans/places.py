"""Queries of map coordinates, collated order, lookups and isolated failures over the test tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrace.functions import geometry
from terrace.functions import projection as p
from terrace.operators import lookup, ordering, programme, squads


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def q74_map_places(spark, sf_dir):
    """Customers as pixels of images on the grid: their degrees on world maps, and how many millimetres the way back is off."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", (-450000.0 - F.col("c_custkey") * 37 % 400000).alias("x0"), (-950000.0 - F.col("c_custkey") * 53 % 250000).alias("y1"), (F.col("c_custkey") % 4096).cast("double").alias("px"), (F.col("c_nationkey") * 100).cast("double").alias("py"))
    at = [F.col("x0") + F.col("px") * 0.05, F.col("y1") - F.col("py") * 0.05]
    lon, lat = p.pixel_to_world(*map(F.col, ("px", "py", "x0", "y1")), F.lit(0.05))
    world = c.select("c_custkey", at[0].alias("east"), at[1].alias("north"), lon.alias("lon"), lat.alias("lat"))
    east, north = p.from_world(F.col("lon"), F.col("lat"))
    off = F.greatest(F.abs(east - F.col("east")), F.abs(north - F.col("north")))
    return world.select("c_custkey", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), (off < 0.001).alias("within_mm"))


SURNAMES = ("Cibulka", "Čech", "Dvořák", "Hájek", "Horák", "Chalupa", "Chytil", "Šimek", "Svoboda", "Žák", "Zeman", "Říha", "Rybář")


def q75_squad_by_name(spark, sf_dir):
    """Customers of a nation as a squad, by surname in Czech order both ways, and the number of them with an equal first letter in that order."""
    surnames = F.array(*map(F.lit, SURNAMES))
    rows = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.concat_ws(" ", F.element_at(F.array(F.lit("Jan"), F.lit("Čeněk"), F.lit("Chrudoš")), (F.col("c_custkey") % 3 + 1).cast("int")), F.element_at(surnames, (F.col("c_custkey") * 7 % len(SURNAMES) + 1).cast("int"))).alias("player"), F.pmod("c_custkey", F.lit(11)).alias("apps"))
    place = lambda down: F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*squads.squad_order("name", down), "c_custkey"))
    initial = F.regexp_extract("player", r" (Ch|.)\S*$", 1)
    same = F.count("*").over(Window.partitionBy("c_nationkey", F.collate(initial, "cs")))
    return rows.select("c_custkey", "player", place(False).alias("place"), place(True).alias("place_down"), same.alias("same_initial"))


def q76_isolated_failures(spark, sf_dir):
    """A user's measures from the events' fields, some cut short: users keep what is good, and every user has a row."""
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "value", F.when(F.col("event_id") % 11 == 0, F.substring("props", 1, 5)).when(F.col("user_id") % 50 == 7, F.lit('{"k": "x"}')).otherwise(F.col("props")).alias("props"))
    field = F.try_parse_json("props")
    k = F.try_variant_get(field, "$.k", "int")
    good, bad = lookup.isolated(events, {"not json": field.isNotNull()}, {"k": k, "measure": F.try_divide(F.round(F.col("value") * 100), k)})
    results = good.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("measure"), 4).alias("measure"))
    return lookup.results_by_key(events, "user_id", results, bad)


def q77_team_lookup(spark, sf_dir):
    """Suppliers as teams, some of one name; customers ask for them by labels of last season's division."""
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    teams = _read(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    teams = teams.select("s_suppkey", F.concat(F.lit("Tým Č. "), (F.col("s_suppkey") % 70).cast("string")).alias("name"), "n_name")
    asked = _read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = asked.select("c_custkey", F.concat(F.lit("tym č. "), (F.col("c_custkey") % 80).cast("string"), F.lit(" ("), F.lower("n_name"), F.lit(")")).alias("label"))
    return lookup.lookup_cascade(asked, "label", teams, "s_suppkey", "name", "n_name").select("c_custkey", "label", "found", "by")


def q83_measured_sections(spark, sf_dir):
    """Parts as fields with edges measured by hand: the section of a number, from the north, and a rectangle from bounds."""
    num = lambda x: F.expr(x).cast("double")
    field = _read(spark, sf_dir, "part").select("p_partkey", num("p_partkey % 4000").alias("cx"), num("p_partkey % 3000").alias("cy"), num("p_size * 2 + 60").alias("w"), num("p_partkey % 90 + 50").alias("h"), num("p_partkey % 60 - 30").alias("angle"), F.expr("cast(p_partkey % 3 + 1 as int)").alias("number"))
    edges = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0.5, 4.0), (4.5, 8.0), (8.5, 12.0))])
    bounds = F.array(F.lit(1.0), F.lit(5.0), F.lit(2.0), F.lit(4.5))
    place = [F.col(c) for c in ("cx", "cy", "w", "h", "angle")]
    found = field.select("p_partkey", F.element_at(geometry.measured_sections(*place, edges, F.lit(0.1), "N"), F.col("number")).alias("s"), geometry.bounded_rectangle(*place, bounds, F.lit(0.1)).alias("r"))
    return found.select("p_partkey", *[F.round(f"{k}.{c}", 4).alias(f"{k}_{c}") for k in ("s", "r") for c in ("cx", "cy", "w", "h")])


def q84_publication_order(spark, sf_dir):
    """Suppliers as teams in publication order, those with fixtures alone, joined with what the season holds of their slug."""
    teams = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("slug"), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "tým ").otherwise("Tým "), (F.col("s_suppkey") % 30).cast("string")).alias("name"), F.concat(F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string")).alias("division"))
    season = _read(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("slug")).agg(F.count("*").alias("fixtures"))
    published = ordering.publication_order(teams.join(season.select("slug"), "slug", "left_semi"), "name", "division")
    return published.join(season, "slug").select("slug", "name", "division", "place", "fixtures")


def q86_shown_grounds(spark, sf_dir):
    """Suppliers as grounds: training grounds, comments and grounds without a line are not shown."""
    code = lambda k: F.concat(F.when(F.col(k) % 10 == 0, "_").otherwise("G"), F.col(k).cast("string"))
    venues = _read(spark, sf_dir, "supplier").select(code("s_suppkey").alias("code"), "s_name", F.when(F.col("s_acctbal") > 0, F.col("s_nationkey") % 5 == 0).alias("training"))
    return programme.shown_grounds(venues, _read(spark, sf_dir, "lineitem").select(code("l_suppkey").alias("code")), "code").select("code", "s_name", "candidates")


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] == "q" and n[1:3].isdigit()}


def _map_sql() -> str:
    e2, b2 = p.FLATTENING * (2 - p.FLATTENING), p.WORLD_FLATTENING * (2 - p.WORLD_FLATTENING)
    e, q, z, n = math.sqrt(e2), math.pi / 4, math.radians(p.CONE_AZIMUTH), math.sin(math.radians(p.PARALLEL))
    d = lambda x: f"{x!r}::DOUBLE"
    steps = [
        f"SELECT *, sqrt(east * east + north * north) AS r, atan(east / north) / {d(n)} AS d FROM g",
        f"SELECT *, 2 * (atan(pow({d(p._R0)} / r, {d(1 / n)}) * {d(math.tan(q + math.radians(p.PARALLEL) / 2))}) - {d(q)}) AS t FROM (%s)",
        f"SELECT *, asin({d(math.cos(z))} * sin(t) - {d(math.sin(z))} * cos(t) * cos(d)) AS u FROM (%s)",
        f"SELECT *, {d(p.ORIGIN_LONGITUDE)} - degrees(asin(cos(t) * sin(d) / cos(u)) / {d(p._B)}) AS lam, {d(p._T0 ** (-1 / p._B))} * pow(tan(u / 2 + {d(q)}), {d(1 / p._B)}) AS base, u AS phi0 FROM (%s)",
        *[f"SELECT *, 2 * (atan(base * pow((1 + {d(e)} * sin(phi{i})) / (1 - {d(e)} * sin(phi{i})), {d(e / 2)})) - {d(q)}) AS phi{i + 1} FROM (%s)" for i in range(8)],
        f"SELECT *, {d(p.SEMI_MAJOR)} / sqrt(1 - {d(e2)} * sin(phi8) * sin(phi8)) AS nu, radians(lam) AS l FROM (%s)",
        f"SELECT *, nu * cos(phi8) * cos(l) AS x, nu * cos(phi8) * sin(l) AS y, nu * {d(1 - e2)} * sin(phi8) AS z FROM (%s)",
    ]
    dx, dy, dz = p.SHIFT[:3]
    rx, ry, rz = (math.radians(s / 3600) for s in p.SHIFT[3:6])
    m, a, b = 1 + p.SHIFT[6] * 1e-6, p.WORLD_SEMI_MAJOR, p.WORLD_SEMI_MAJOR * (1 - p.WORLD_FLATTENING)
    steps += [
        f"SELECT c_custkey, {dx} + {d(m)} * (x - {d(rz)} * y + {d(ry)} * z) AS x, {dy} + {d(m)} * ({d(rz)} * x + y - {d(rx)} * z) AS y, {dz} + {d(m)} * (-{d(ry)} * x + {d(rx)} * y + z) AS z FROM (%s)",
        f"SELECT *, sqrt(x * x + y * y) AS p, atan2(z * {d(a)}, sqrt(x * x + y * y) * {d(b)}) AS t FROM (%s)",
        f"SELECT c_custkey, round(degrees(atan2(y, x)), 7) AS lon, round(degrees(atan2(z + {d(b2 / (1 - b2) * b)} * pow(sin(t), 3), p - {d(b2 * a)} * pow(cos(t), 3))), 7) AS lat, true AS within_mm FROM (%s)",
    ]
    sql = steps[0]
    for step in steps[1:]:
        sql = step.replace("%s", sql)
    return f"WITH g AS (SELECT c_custkey, -450000.0::DOUBLE - c_custkey * 37 % 400000 + c_custkey % 4096 * 0.05::DOUBLE AS east, -950000.0::DOUBLE - c_custkey * 53 % 250000 - c_nationkey * 100 * 0.05::DOUBLE AS north FROM customer) {sql}"


_NAMES = "[" + ", ".join(f"'{s}'" for s in SURNAMES) + "]"
_PROPS = """CASE WHEN event_id % 11 = 0 THEN substr(props, 1, 5) WHEN user_id % 50 = 7 THEN '{"k": "x"}' ELSE props END"""
ORACLES = {
    "q74_map_places": _map_sql(),
    "q86_shown_grounds": """SELECT 'G' || s_suppkey AS code, s_name, count(*) AS candidates FROM supplier JOIN lineitem ON l_suppkey = s_suppkey
    WHERE s_suppkey % 10 <> 0 AND NOT (s_acctbal > 0 AND s_nationkey % 5 = 0) GROUP BY s_suppkey, s_name""",
    "q83_measured_sections": """WITH f AS (SELECT p_partkey, (p_partkey % 4000)::DOUBLE AS cx, (p_partkey % 3000)::DOUBLE AS cy, (p_size * 2 + 60)::DOUBLE AS w, (p_partkey % 90 + 50)::DOUBLE AS h, radians(p_partkey % 60 - 30) AS a, p_partkey % 3 + 1 AS number FROM part),
    e AS (SELECT f.*, t.lo / 0.1::DOUBLE AS lo, t.hi / 0.1::DOUBLE AS hi FROM f, (VALUES (0.5::DOUBLE, 4.0::DOUBLE), (4.5::DOUBLE, 8.0::DOUBLE), (8.5::DOUBLE, 12.0::DOUBLE)) t(lo, hi)),
    s AS (SELECT *, (lo + hi) / 2 - greatest(w, h) / 2 AS off FROM e), p AS (SELECT *, cx + off * CASE WHEN w >= h THEN cos(a) ELSE -sin(a) END AS x, cy + off * CASE WHEN w >= h THEN sin(a) ELSE cos(a) END AS y FROM s),
    q AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY y, x) AS i FROM p)
    SELECT p_partkey, round(x, 4) AS s_cx, round(y, 4) AS s_cy, round(CASE WHEN w >= h THEN hi - lo ELSE w END, 4) AS s_w, round(CASE WHEN w >= h THEN h ELSE hi - lo END, 4) AS s_h,
      round(cx + (30 - w / 2) * cos(a) - (32.5::DOUBLE - h / 2) * sin(a), 4) AS r_cx, round(cy + (30 - w / 2) * sin(a) + (32.5::DOUBLE - h / 2) * cos(a), 4) AS r_cy, 40.0::DOUBLE AS r_w, 25.0::DOUBLE AS r_h FROM q WHERE i = number""",
    "q84_publication_order": """WITH t AS (SELECT 't' || s_suppkey AS slug, CASE WHEN s_suppkey % 2 = 0 THEN 'tým ' ELSE 'Tým ' END || (s_suppkey % 30) AS name, s_nationkey || '/' || s_suppkey AS division FROM supplier),
    s AS (SELECT 't' || l_suppkey AS slug, count(*) AS fixtures FROM lineitem GROUP BY 1)
    SELECT slug, name, division, row_number() OVER (ORDER BY lower(name), division) AS place, fixtures FROM t JOIN s USING (slug)""",
    "q75_squad_by_name": f"""WITH s AS (SELECT c_custkey, c_nationkey, ['Jan', 'Čeněk', 'Chrudoš'][c_custkey % 3 + 1] AS given, {_NAMES}[c_custkey * 7 % {len(SURNAMES)} + 1] AS surname, c_custkey % 11 AS apps FROM customer)
    SELECT c_custkey, given || ' ' || surname AS player,
      row_number() OVER (PARTITION BY c_nationkey ORDER BY surname || ' ' || given || ' ' || surname COLLATE cs, apps, c_custkey)::INT AS place,
      row_number() OVER (PARTITION BY c_nationkey ORDER BY surname || ' ' || given || ' ' || surname COLLATE cs DESC, apps DESC, c_custkey)::INT AS place_down,
      count(*) OVER (PARTITION BY c_nationkey, CASE WHEN surname LIKE 'Ch%' THEN 'Ch' ELSE left(surname, 1) END) AS same_initial FROM s""",
    "q76_isolated_failures": f"""WITH e AS (SELECT event_id, user_id, value, {_PROPS} AS props FROM events),
    k AS (SELECT *, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.k') AS INT) END AS k, json_valid(props) AS ok FROM e),
    f AS (SELECT *, CASE WHEN NOT ok THEN 'not json' WHEN k IS NULL THEN 'no k' WHEN k = 0 THEN 'no measure' END AS error, round(value * 100) / nullif(k, 0) AS m FROM k)
    SELECT user_id, nullif(count(*) FILTER (error IS NULL), 0) AS n, round(sum(m) FILTER (error IS NULL), 4) AS measure, count(error) AS failed, min(error) AS error FROM f GROUP BY user_id""",
    "q77_team_lookup": """WITH t AS (SELECT s_suppkey, 'tym c. ' || (s_suppkey % 70) AS name, lower(n_name) AS division FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    l AS (SELECT name || ' (' || division || ')' AS label, min(s_suppkey) AS whole FROM t GROUP BY 1), b AS (SELECT name, min(s_suppkey) AS bare_only FROM t GROUP BY 1 HAVING count(*) = 1),
    a AS (SELECT c_custkey, 'tym č. ' || (c_custkey % 80) || ' (' || lower(n_name) || ')' AS label, 'tym c. ' || (c_custkey % 80) AS bare, 'tym c. ' || (c_custkey % 80) || ' (' || lower(n_name) || ')' AS folded FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, a.label, coalesce(whole, bare_only) AS found, CASE WHEN whole IS NOT NULL THEN 'label' WHEN bare_only IS NOT NULL THEN 'name' END AS "by" FROM a LEFT JOIN l ON l.label = folded LEFT JOIN b ON b.name = bare""",
}
