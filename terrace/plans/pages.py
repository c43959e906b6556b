"""Queries of the page parsers: pages are written from the test tables' rows, and the parsed rows are held against the tables by SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.plans.league import _read, spread
from terrace.sources import html


def _page(rows: DataFrame, by: str, row: Column, order: str) -> DataFrame:
    """(by, html): per key a table of rows in order, with a header row. A key's rows are those of one page."""
    joined = F.expr("listagg(_row, '\n') within group (order by _order)")
    return rows.select(by, row.alias("_row"), F.col(order).alias("_order")).groupBy(by).agg(F.concat(F.lit("<table><tr><th>#</th></tr>\n"), joined, F.lit("</table>")).alias("html"))


def _cells(*cells: Column | str) -> Column:
    parts = [c if isinstance(c, Column) else F.lit(c) for c in cells]
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), p, F.lit("</td>")) for p in parts], F.lit("</tr>"))


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def q60_parsed_fixtures(spark, sf_dir):
    """Orders as a customer's fixture page: dates, times, grounds, sides and scores, some not official, some not played."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("Tým "), _text("o_custkey")).alias("team"), F.col("o_orderdate").cast("date").alias("day"))
    other = F.concat(F.lit("Soupeř "), (F.col("o_orderkey") % 97).cast("string"))
    home = F.col("o_orderkey") % 2 == 0
    sides = F.concat_ws(" - ", F.when(home, F.col("team")).otherwise(other), F.when(home, other).otherwise(F.col("team")))
    style = F.when(F.col("o_orderkey") % 5 == 0, "is-result is-gray").otherwise("is-result")
    score = F.when(F.col("o_orderkey") % 3 > 0, F.concat_ws(":", (F.col("o_orderkey") % 7).cast("string"), (F.col("o_custkey") % 4).cast("string"))).otherwise("")
    row = F.concat(F.lit("<tr><td></td><td>Po "), F.date_format("day", "d.M.yyyy"), F.lit("</td><td>"), F.lpad((F.col("o_orderkey") % 12 + 8).cast("string"), 2, "0"), F.lit(':15</td><td><a href="/hriste/#G'), _text("o_orderkey"), F.lit('">g</a></td><td>'), sides, F.lit('</td><td class="'), style, F.lit('">'), score, F.lit("</td></tr>"))
    parsed = html.fixtures(_page(o, "team", row, "o_orderkey"))
    full = html.results_of(parsed)
    return full.select("team", F.substring("code", 2, 20).cast("long").alias("o_orderkey"), F.col("day").cast("string").alias("day"), "time", "opponent", "home", "score", "official", "gf", "ga", "res")


def q61_parsed_standings(spark, sf_dir):
    """Customers as tables of nations: every other page is wrapped in JSON, some rows are too short."""
    c = _read(spark, sf_dir, "customer")
    n = lambda k: (F.col("c_custkey") % k).cast("string")
    row = _cells(F.concat(_text("c_custkey"), F.lit(".")), F.concat(F.lit('<a href="/tymy/t-'), _text("c_custkey"), F.lit('/">'), F.col("c_name"), F.lit("</a>")), n(22), n(9), n(5), n(7), F.concat_ws(" : ", n(50), n(40)), n(30))
    short = _cells("x", F.concat(F.lit('<a href="/tymy/t-'), _text("c_custkey"), F.lit('/">'), F.col("c_name"), F.lit("</a>")))
    pages = _page(c.withColumn("nation", F.col("c_nationkey")), "nation", F.when(F.col("c_custkey") % 11 == 0, short).otherwise(row), "c_custkey")
    wrapped = F.when(F.col("nation") % 2 == 0, F.to_json(F.struct("html"))).otherwise(F.col("html"))
    return html.standings(pages.select("nation", wrapped.alias("html"))).select("nation", "place", "slug", "played", "w", "d", "l", "score", "points")


def q62_parsed_venues(spark, sf_dir):
    """Suppliers as ground pages of nations, with coordinates inside an escaped map link; repeated codes take the last row."""
    s = _read(spark, sf_dir, "supplier").withColumn("nation", F.col("s_nationkey"))
    link = F.concat(F.lit('<a href="https://mapy.example/?x=1&amp;q='), F.concat_ws("%2C", F.concat_ws(".", (F.col("s_suppkey") % 80).cast("string"), F.lpad(_text("s_suppkey"), 4, "0")), F.concat(F.lit("14."), F.lpad((F.col("s_suppkey") * 7 % 10000).cast("string"), 4, "0"))), F.lit('">mapa</a>'))
    code = F.concat(F.lit("V"), (F.col("s_suppkey") % 6).cast("string"))
    row = _cells(F.concat(F.lit('<a name="'), code, F.lit('"></a>'), F.col("s_name")), F.concat(F.lit("Ulice "), _text("s_suppkey"), F.lit("<br/>Praha")), F.lit("Obuv: &amp; AG"), link)
    return html.venues(_page(s, "nation", row, "s_suppkey")).select("nation", "code", "name", "lat", "lon", "address", "notes")


def q63_parsed_details(spark, sf_dir):
    """Orders as blocks of match details: half-time score, referee and report, each missing at times."""
    o = _read(spark, sf_dir, "orders").withColumn("customer", F.col("o_custkey"))
    part = lambda condition, body: F.when(condition, body).otherwise("")
    block = F.concat(F.lit('<div id="game-'), _text("o_orderkey"), F.lit('"><p>'), part(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("3:1 ("), (F.col("o_orderkey") % 5).cast("string"), F.lit(":0)"))), F.lit("</p><br>Rozhodčí: "), part(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("R "), F.col("o_orderpriority"))), F.lit("<br>Zpráva: "), part(F.col("o_orderkey") % 2 > 0, F.concat(F.lit("<b>bez</b> závad "), _text("o_orderkey"))), F.lit("</div>"))
    return html.match_details(_page(o, "customer", block, "o_orderkey"))


def q64_parsed_sheets(spark, sf_dir):
    """Lines as team sheets: who keeps goal, leads and was best, and the goals by minute."""
    li = spread(_read(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", F.concat(F.lit("P"), (F.col("l_partkey") % 40).cast("string")).alias("a"), F.concat(F.lit("Q"), (F.col("l_suppkey") % 40).cast("string")).alias("b"), (F.col("l_quantity").cast("int") + 1).alias("m"))
    lineup = F.concat(F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Ann Gate"), F.lit(" - "))).otherwise(""), F.lit('<b class="is-captain">'), F.col("a"), F.lit('</b>, <i class="x is-best">'), F.col("b"), F.lit("</i>"))
    goals = F.concat(_text("m"), F.lit("., "), (F.col("m") + 9).cast("string"), F.lit(". Ray Ox, 88. Cid"))
    s = li.select("l_orderkey", "l_linenumber", html.people(lineup).alias("p"), html.scorers(goals).alias("g"))
    shown = F.transform("p", lambda x: F.concat(x["n"], F.when(x["gk"], "/g").otherwise(""), F.when(x["cap"], "/c").otherwise(""), F.when(x["best"], "/b").otherwise("")))
    scored = F.transform("g", lambda x: F.concat_ws(" ", F.array_join(F.transform(x["m"], lambda m: m.cast("string")), "+"), x["n"]))
    return s.select("l_orderkey", "l_linenumber", F.array_join(shown, ",").alias("people"), F.array_join(scored, ",").alias("goals"))


def q65_query_ids(spark, sf_dir):
    """Parameters of links, escaped as in pages."""
    o = _read(spark, sf_dir, "orders")
    ids = html.query_ids(F.concat(F.lit("/zapas/?team="), _text("o_custkey"), F.lit("&amp;game="), _text("o_orderkey"), F.lit("#detail")))
    return o.select("o_orderkey", F.element_at(ids, "team").cast("long").alias("team"), F.element_at(ids, "game").cast("long").alias("game"), F.size(ids).alias("n"))


def q78_season_with_sheets(spark, sf_dir):
    """Orders as matches of a customer's page, with blocks of details and sheets below: one row a match, the customer's own side of each sheet."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("team"), F.col("o_orderdate").cast("date").alias("day"))
    k, team, text = F.col("o_orderkey"), _text("team"), lambda c: c.cast("string")
    home = k % 2 == 0
    link = lambda slug, name: F.concat(F.lit('<a href="/souteze/x/1-a/tymy/'), slug, F.lit('/">'), name, F.lit("</a>"))
    own, other = (F.concat(F.lit("t"), team), F.concat(F.lit("Tým "), team)), (F.concat(F.lit("s"), text(k % 97)), F.concat(F.lit("Soupeř "), text(k % 97)))
    sides = F.when(home, F.concat(link(*own), F.lit(" - "), link(*other))).otherwise(F.concat(link(*other), F.lit(" - "), link(*own)))
    score = F.when(k % 3 > 0, F.concat_ws(":", text(k % 7), text(k % 4))).otherwise("-")
    row = F.concat(F.lit("<tr><td>Po "), F.date_format("day", "d.M.yyyy"), F.lit('</td><td><a href="/hriste/#G'), text(k), F.lit('">g</a> <i data-gameid="'), text(k), F.lit('"></i></td><td>'), sides, F.lit("</td><td>"), score, F.lit("</td></tr>"))
    line = lambda mine: F.concat(F.lit("<td>"), F.when(mine, F.concat(F.lit("Ann Gate - <b class=\"is-captain\">P"), text(k % 40), F.lit("</b>, Cid"))).otherwise(F.lit("Other - Man")), F.lit("</td>"))
    goal = lambda mine: F.concat(F.lit("<td>"), F.when(mine, F.concat(text(k % 59 + 1), F.lit("., 60. Ray Ox"))).otherwise(F.lit("1. Foe")), F.lit("</td><td>"), F.when(mine & (k % 4 == 1), F.lit("5. Cid<br/>9. P")).otherwise(""), F.lit("</td>"))
    head = lambda mine: F.concat(F.lit("<th>"), F.when(mine, own[1]).otherwise(other[1]), F.lit("</th>"))
    sheet = F.concat(F.lit('<table class="has-smaller-text"><tr>'), head(home), F.lit("<th> </th>"), head(~home), F.lit("</tr> <tr>"), line(home), F.lit("<td>-</td>"), line(~home), F.lit("</tr></table><table><tr><th>Góly</th></tr> <tr>"), goal(home), F.lit("<td>-</td>"), goal(~home), F.lit("</tr></table>"))
    block = F.concat(F.lit('<div id="game-'), text(k), F.lit('"><p>3:1 ('), text(k % 5), F.lit(":0)</p><br>Rozhodčí: R"), text(k % 9), F.lit("<br>"), F.when(k % 5 > 0, sheet).otherwise(""), F.lit("</div>"))
    pages = _page(o, "team", row, "o_orderkey").join(_page(o, "team", block, "o_orderkey").withColumnRenamed("html", "below"), "team")
    pages = pages.select(F.concat(F.lit("t"), _text("team")).alias("slug"), F.concat(F.col("html"), F.lit('<a name="gameResults"></a>'), F.col("below")).alias("html"))
    found = html.season_with_sheets(pages)
    shown = F.array_join(F.transform("line", lambda x: F.concat(x["n"], F.when(x["gk"], "/g").otherwise(""), F.when(x["cap"], "/c").otherwise(""))), ",")
    scored = F.array_join(F.transform("goals", lambda x: F.concat_ws(" ", F.array_join(F.transform(x["m"], lambda m: m.cast("string")), "+"), x["n"])), ",")
    return found.select("slug", "gameid", F.col("day").cast("string").alias("day"), "code", "opponent", "opp_slug", "home", "score", "half", "referee", shown.alias("line"), scored.alias("goals"), F.array_join("cards", ",").alias("cards"), "gf", "ga", "res")


def q79_jersey_colours(spark, sf_dir):
    """Suppliers as teams of nations with the colours that their nation's page of jerseys gives; some teams are not on it."""
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("division"), F.concat(F.lit("Šípy č. "), _text("s_suppkey")).alias("name"))
    colours = F.element_at(F.array(*map(F.lit, ("bílá, černá", "modro-žlutá", "tmavě modrá &amp; bílá"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    cells = _cells(F.when(F.col("s_suppkey") % 4 > 0, F.upper("name")).otherwise("Jiní"), F.when(F.col("s_suppkey") % 7 > 0, F.concat(F.lit("<b>"), colours, F.lit("</b>"))).otherwise(" "))
    pages = _page(s, "division", cells, "s_suppkey").withColumn("html", F.concat(F.lit("<tr><th>Tým</th><th>Barva dresu</th></tr>"), "html"))
    return html.with_colours(s, html.jersey_colours(pages), ["division"], "name").select("s_suppkey", "name", "colours")


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] == "q" and n[1:3].isdigit()}

ORACLES = {
    "q60_parsed_fixtures": """WITH o AS (SELECT *, o_orderkey % 2 = 0 AS home, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 7 END AS x, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 4 END AS y FROM orders),
    g AS (SELECT *, (CASE WHEN home THEN x ELSE y END)::INT AS gf, (CASE WHEN home THEN y ELSE x END)::INT AS ga FROM o)
    SELECT 'Tým ' || o_custkey::VARCHAR AS team, o_orderkey, o_orderdate::DATE::VARCHAR AS day, lpad((o_orderkey % 12 + 8)::VARCHAR, 2, '0') || ':15' AS time, 'Soupeř ' || (o_orderkey % 97)::VARCHAR AS opponent, home,
      x::VARCHAR || ':' || y::VARCHAR AS score, x IS NOT NULL AND o_orderkey % 5 <> 0 AS official, gf, ga, CASE WHEN gf > ga THEN 'W' WHEN gf = ga THEN 'D' WHEN gf < ga THEN 'L' END AS res FROM g""",
    "q61_parsed_standings": """SELECT c_nationkey AS nation, c_custkey::INT AS place, 't-' || c_custkey::VARCHAR AS slug, (c_custkey % 22)::INT AS played, (c_custkey % 9)::INT AS w, (c_custkey % 5)::INT AS d, (c_custkey % 7)::INT AS l,
      (c_custkey % 50)::VARCHAR || ':' || (c_custkey % 40)::VARCHAR AS score, (c_custkey % 30)::INT AS points FROM customer WHERE c_custkey % 11 <> 0""",
    "q62_parsed_venues": """WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 6 ORDER BY s_suppkey DESC) AS r FROM supplier)
    SELECT s_nationkey AS nation, 'V' || (s_suppkey % 6)::VARCHAR AS code, s_name AS name, ((s_suppkey % 80)::VARCHAR || '.' || substr(lpad(s_suppkey::VARCHAR, 4, '0'), 1, 4))::DOUBLE AS lat, ('14.' || lpad((s_suppkey * 7 % 10000)::VARCHAR, 4, '0'))::DOUBLE AS lon,
      'Ulice ' || s_suppkey::VARCHAR || chr(10) || 'Praha' AS address, 'Obuv: & AG' AS notes FROM s WHERE r = 1""",
    "q63_parsed_details": """SELECT o_custkey AS customer, o_orderkey AS gameid, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 5)::VARCHAR || ':0' END AS half, CASE WHEN o_orderkey % 3 > 0 THEN 'R ' || o_orderpriority END AS referee,
      CASE WHEN o_orderkey % 2 > 0 THEN 'bez závad ' || o_orderkey::VARCHAR END AS report FROM orders""",
    "q64_parsed_sheets": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'Ann Gate/g,' ELSE '' END || 'P' || (l_partkey % 40)::VARCHAR || '/c,Q' || (l_suppkey % 40)::VARCHAR || '/b' AS people,
      (l_quantity::INT + 1)::VARCHAR || '+' || (l_quantity::INT + 10)::VARCHAR || ' Ray Ox,88 Cid' AS goals FROM lineitem""",
    "q65_query_ids": "SELECT o_orderkey, o_custkey AS team, o_orderkey AS game, 2 AS n FROM orders",
    "q78_season_with_sheets": """WITH o AS (SELECT *, o_orderkey AS k, o_orderdate::DATE AS d, o_orderkey % 2 = 0 AS home, o_orderkey % 3 > 0 AS played, o_orderkey % 5 > 0 AS sheet FROM orders),
    g AS (SELECT *, CASE WHEN played THEN CASE WHEN home THEN k % 7 ELSE k % 4 END END::INT AS gf, CASE WHEN played THEN CASE WHEN home THEN k % 4 ELSE k % 7 END END::INT AS ga FROM o)
    SELECT 't' || o_custkey AS slug, k AS gameid, d::VARCHAR AS day, 'G' || k AS code, 'Soupeř ' || (k % 97) AS opponent, 's' || (k % 97) AS opp_slug, home, CASE WHEN played THEN (k % 7) || ':' || (k % 4) END AS score,
      (k % 5) || ':0' AS half, 'R' || (k % 9) AS referee, CASE WHEN sheet THEN 'Ann Gate/g,P' || (k % 40) || '/c,Cid' END AS line, CASE WHEN sheet THEN (k % 59 + 1) || '+60 Ray Ox' END AS goals,
      CASE WHEN sheet THEN CASE WHEN k % 4 = 1 THEN '5. Cid,9. P' ELSE '' END END AS cards, gf, ga, CASE WHEN gf > ga THEN 'W' WHEN gf = ga THEN 'D' WHEN gf < ga THEN 'L' END AS res FROM g""",
    "q79_jersey_colours": """SELECT s_suppkey, 'Šípy č. ' || s_suppkey AS name, CASE WHEN s_suppkey % 4 > 0 AND s_suppkey % 7 > 0 THEN ['bílá, černá', 'modro-žlutá', 'tmavě modrá & bílá'][s_suppkey % 3 + 1] END AS colours FROM supplier""",
}
