"""Tables, links and cells out of HTML pages, as Column expressions and DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.calendar import parse_day
from terrace.functions.rules import is_official, result, score_side
from terrace.functions.text import ascii_id, bound, key, strip_tags
from terrace.operators.dedupe import first_by

ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"
CELL_TAG = r"(?is)(<t[dh][^>]*>.*?</t[dh]>)"


def links(pages: DataFrame, column: str, pattern: str) -> DataFrame:
    """A row for each match of the pattern's first group."""
    return pages.select(*[c for c in pages.columns if c != column], F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("link"))


def rows(pages: DataFrame, column: str) -> DataFrame:
    """A row for each table row with its place, raw cells and their text."""
    split = pages.select(*[c for c in pages.columns if c != column], F.posexplode(F.regexp_extract_all(column, F.lit(ROW), F.lit(1))).alias("row", "row_html"))
    cells = split.withColumn("cells", F.regexp_extract_all("row_html", F.lit(CELL), F.lit(1))).withColumn("cell_tags", F.regexp_extract_all("row_html", F.lit(CELL_TAG), F.lit(1)))
    return cells.withColumn("texts", F.transform("cells", strip_tags))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often filters and further columns name them.

    They come out of a generator: Spark moves a filter below projections, with a copy of each expression for each mention, but
    not below a generator.
    """
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_once")
    return df.select("*", made).select(*df.columns, *[F.col(f"_once.{name}").alias(name) for name in columns])


def query_ids(url: Column) -> Column:
    """The parameters of a link as a map."""
    return F.str_to_map(F.regexp_extract(F.replace(url, F.lit("&amp;"), F.lit("&")), r"\?([^#]*)", 1), F.lit("&"), F.lit("="))


def body_of(page: Column) -> Column:
    """The HTML of a page that may be wrapped as {"html": ...}."""
    return F.when(F.startswith(F.ltrim(page), F.lit("{")), F.get_json_object(page, "$.html")).otherwise(page)


def standings(pages: DataFrame, column: str = "html") -> DataFrame:
    """(.., place, slug, played, w, d, l, score, points) from table rows with at least six numbers and a team link."""
    found = rows(pages.withColumn(column, body_of(F.col(column))), column)
    found = found.withColumn("slug", F.regexp_extract("row_html", r'(?i)href="[^"]*?/([a-z0-9-]+)/?"', 1))
    numbers = F.filter(F.transform("texts", lambda t: F.regexp_extract(t, r"^\s*(\d+)\.?\s*$", 1)), lambda t: t != "")
    score = F.get(F.filter("texts", lambda t: t.rlike(r"^\s*\d+\s*:\s*\d+\s*$")), F.lit(0))
    n = lambda i: F.get(F.col("numbers"), F.lit(i)).cast("int")
    kept = found.withColumn("numbers", numbers).filter((F.size("numbers") >= 6) & (F.col("slug") != ""))
    base = [c for c in pages.columns if c != column]
    return kept.select(*base, n(0).alias("place"), "slug", n(1).alias("played"), n(2).alias("w"), n(3).alias("d"), n(4).alias("l"), F.regexp_replace(score, r"\s", "").alias("score"), n(5).alias("points"))


def venues(pages: DataFrame, column: str = "html") -> DataFrame:
    """(.., code, name, lat, lon, address, notes): rows of three cells or more, one for each anchor that names a code."""
    found = rows(pages, column).filter(F.size("cells") >= 3)
    anchors = found.withColumn("code", F.explode(F.regexp_extract_all("row_html", F.lit(r'(?i)<a[^>]*(?:id|name)="([^"]+)"'), F.lit(1))))
    place = F.url_decode(F.replace(F.regexp_extract("row_html", r'(?i)href="([^"]*(?:mapy|maps)[^"]*)"', 1), F.lit("&amp;"), F.lit("&")))
    part = lambda i: F.regexp_extract(place, r"(-?\d{1,3}\.\d+)\D+?(-?\d{1,3}\.\d+)", i).try_cast("double")
    base = [c for c in pages.columns if c != column]
    last = anchors.groupBy(*base, "code").agg(F.max_by(F.struct("texts", part(1).alias("lat"), part(2).alias("lon")), "row").alias("v"))
    text = lambda i: F.get(F.col("v.texts"), F.lit(i))
    return last.select(*base, "code", text(0).alias("name"), "v.lat", "v.lon", text(1).alias("address"), text(2).alias("notes"))


def fixtures(pages: DataFrame, team: str = "team", column: str = "html") -> DataFrame:
    """(.., round, day, time, code, opponent, home, score, official) of the team that each page belongs to.

    A row needs a date, a time and two named sides of which one is the team. Repeats of date, time and code go to the
    first row; a row without a round gets its place among those kept.
    """
    found = rows(pages, column)
    first = lambda p: F.get(F.filter("texts", lambda t: t.rlike(p)), F.lit(0))
    sides = F.get(F.filter("texts", lambda t: t.rlike(r"\S\s+[-–]\s+\S")), F.lit(0))
    pair = F.transform(F.split(sides, r"\s+[-–]\s+", 2), lambda x: F.trim(x))
    code = F.regexp_extract("row_html", r'(?i)href="[^"]*#([^"]+)"', 1)
    # The first cell of this form is the time, the last one after it the score.
    timed = F.filter(F.arrays_zip("cell_tags", "texts"), lambda c: c["texts"].rlike(r"^\d+\s*:\s*\d+$"))
    score_cell = F.when(F.size(timed) > 1, F.element_at(timed, -1)["cell_tags"])
    base = [c for c in pages.columns if c != column]
    read = once(found, date_raw=first(r"\d{1,2}\.\s*\d{1,2}\."), time=first(r"^\d{1,2}:\d{2}$"), pair=pair).filter(F.col("date_raw").isNotNull() & F.col("time").isNotNull())
    home_name, away_name = F.get("pair", F.lit(0)), F.get("pair", F.lit(1))
    read = once(read, own=key(F.col(team)), home_key=key(home_name), away_key=key(away_name))
    read = read.filter((F.col("home_key") == F.col("own")) | (F.col("away_key") == F.col("own"))).withColumn("home", F.col("home_key") == F.col("own"))
    text = F.regexp_replace(strip_tags(F.col("score_cell")), r"\s", "")
    out = read.select(*base, "row", F.regexp_extract(first(r"^\d+\.?$"), r"(\d+)", 1).try_cast("int").alias("round"), "date_raw", "time", code.alias("code"), "home", F.when(F.col("home"), away_name).otherwise(home_name).alias("opponent"), score_cell.alias("score_cell"))
    out = once(out, day=parse_day(F.col("date_raw")), score=F.nullif(F.coalesce(text, F.lit("")), F.lit("")))
    out = out.withColumn("official", F.coalesce(is_official(F.col("score_cell"), F.col("score")), F.lit(False)))
    kept = first_by(out.drop("score_cell"), [*base, "day", "time", "code"], "row")
    place = F.row_number().over(Window.partitionBy(*base).orderBy("row"))
    return kept.withColumn("round", F.coalesce("round", place)).select(*base, "round", "date_raw", "day", "time", "code", "opponent", "home", "score", "official")


def match_blocks(pages: DataFrame, column: str = "html") -> DataFrame:
    """(.., block): a row for each match's anchor, with what follows up to the next one."""
    blocks = F.filter(F.split(column, r'(?i)(?=id="game-\d+")'), lambda b: b.rlike(r'(?i)\Aid="game-\d+"'))
    return pages.select(*[c for c in pages.columns if c != column], F.explode(blocks).alias("block"))


def _gameid() -> Column:
    return F.regexp_extract("block", r'id="game-(\d+)"', 1).cast("long").alias("gameid")


def match_details(pages: DataFrame, column: str = "html") -> DataFrame:
    """(.., gameid, half, referee, report) from the blocks that follow each match's anchor."""
    return _with_details(match_blocks(pages, column)).select(*[c for c in pages.columns if c != column], _gameid(), "half", "referee", "report")


def _with_details(blocks: DataFrame) -> DataFrame:
    grab = lambda p: F.nullif(F.trim(F.regexp_extract("text", p, 1)), F.lit(""))
    read = once(blocks, text=strip_tags(F.regexp_replace("block", r"<[^>]*\z", "")))
    return read.select(*blocks.columns, grab(r"\((\d+:\d+)\)").alias("half"), grab(r"(?im)^\s*(?:rozhod\S*|referee):[ \t]*([^\n]*)").alias("referee"), grab(r"(?ims)^\s*(?:zpr\S*|report):\s*(.*)\z").alias("report"))


def people(cell: Column) -> Column:
    """Line-up of a cell: names by comma; the name before the first dash keeps goal; classes mark captain and best."""

    def person(raw: Column, gk: bool) -> Column:
        # Bare names have no class to look for.
        marked = lambda word: (raw.contains('="') & raw.rlike(f'(?i)class="[^"]*{word}')).alias
        return F.struct(F.trim(strip_tags(raw)).alias("n"), F.lit(gk).alias("gk"), marked("captain")("cap"), marked("best")("best"))

    def both(halves: Column) -> Column:
        kind = "array<struct<n:string,gk:boolean,cap:boolean,best:boolean>>"
        keepers = F.when(F.size(halves) > 1, F.split(F.get(halves, F.lit(0)), ",")).otherwise(F.array().cast("array<string>"))
        return F.concat(F.transform(keepers, lambda x: person(x, True)).cast(kind), F.transform(F.split(F.element_at(halves, -1), ","), lambda x: person(x, False)).cast(kind))

    return F.filter(bound(F.split(cell, r"\s+[-–]\s+", 2), both), lambda p: p["n"] != "")


def scorers(cell: Column) -> Column:
    """Goals of a cell: minutes and a name, for each comma-free group like "42., 46. Name"."""
    groups = F.regexp_extract_all(strip_tags(cell), F.lit(r"((?:\d+\.\s*,?\s*)+[^\d,]+)"), F.lit(1))
    return F.transform(groups, lambda g: F.struct(F.transform(F.regexp_extract_all(g, F.lit(r"(\d+)"), F.lit(1)), lambda m: m.cast("int")).alias("m"), F.trim(F.regexp_replace(g, r"[\d.,]+", "")).alias("n")))


def results_of(matches: DataFrame) -> DataFrame:
    """Adds gf, ga and res to rows with score and home."""
    gf, ga = score_side(F.col("score"), F.col("home"))
    return matches.withColumn("gf", gf).withColumn("ga", ga).withColumn("res", result(F.col("gf"), F.col("ga")))


def season_matches(pages: DataFrame, slug: str = "slug", column: str = "html") -> DataFrame:
    """(.., row, gameid, day, code, opponent, opp_slug, own_name, home, score) of a team's own matches on its page.

    A row counts if it names a ground and two sides by links, one of them the page's team; of rows of one day and ground the
    first. The score is the last cell, if it is one.
    """
    base = [c for c in pages.columns if c != column]
    head = pages.withColumn(column, F.split_part(F.col(column), F.lit('name="gameResults"'), F.lit(1)))
    found = rows(head, column).withColumn("code", F.regexp_extract("row_html", r'href="/hriste/#([A-Z0-9]+)"', 1)).filter("code <> ''")
    side = r'(?s)href="/souteze/[^"]*/tymy/([^"/]+)/"[^>]*>(.*?)</a>'
    found = once(found, slugs=F.regexp_extract_all("row_html", F.lit(side), F.lit(1)), names=F.transform(F.regexp_extract_all("row_html", F.lit(side), F.lit(2)), strip_tags))
    found = found.filter((F.size("slugs") == 2) & F.array_contains("slugs", F.col(slug)))
    day = F.get(F.filter(F.transform("texts", parse_day), lambda d: d.isNotNull()), F.lit(0))
    last = F.try_element_at("texts", F.lit(-1))
    home = F.get("slugs", F.lit(0)) == F.col(slug)
    own, other = F.when(home, 0).otherwise(1), F.when(home, 1).otherwise(0)
    score = F.when(last.rlike(r"^\d{1,2}:\d{1,2}$"), last)
    out = found.select(*base, "row", F.regexp_extract("row_html", r'data-gameid="(\d+)"', 1).try_cast("long").alias("gameid"), day.alias("day"), "code", F.get("names", other).alias("opponent"), F.get("slugs", other).alias("opp_slug"), F.get("names", own).alias("own_name"), home.alias("home"), score.alias("score"))
    return first_by(out, [*base, "day", "code"], "row")


def match_sheets(pages: DataFrame, column: str = "html") -> DataFrame:
    """(.., gameid, sides, lines, goals, cards) from match blocks: names of the two sides and, in their order, who played, scored and was booked."""
    return _with_sheets(match_blocks(pages, column)).select(*[c for c in pages.columns if c != column], _gameid(), "sides", "lines", "goals", "cards")


def _with_sheets(each: DataFrame) -> DataFrame:
    base = each.columns
    line = r"(?s)has-smaller-text.*?<tr>(.*?)</tr>\s*<tr>(.*?)</tr>"
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))
    each = once(each, heads=F.regexp_extract("block", line, 1), line_cells=cells(F.regexp_extract("block", line, 2)), goal_cells=cells(F.regexp_extract("block", r"(?s)Góly.*?</tr>\s*<tr>(.*?)</tr>", 1)))
    sides = F.filter(F.transform(F.regexp_extract_all("heads", F.lit(r"(?s)<th[^>]*>(.*?)</th>"), F.lit(1)), strip_tags), lambda t: t != "")
    cell = lambda name, i: F.get(name, F.lit(i))
    booked = lambda c: F.filter(F.transform(F.split(c, r"<br\s*/?>"), strip_tags), lambda t: t != "")
    whole, scored = (F.size("sides") == 2) & (F.size("line_cells") >= 3), F.size("goal_cells") >= 5
    each = once(each, sides=sides)
    return each.select(
        *base,
        F.when(whole, F.col("sides")).alias("sides"),
        F.when(whole, F.array(people(cell("line_cells", 0)), people(cell("line_cells", 2)))).alias("lines"),
        F.when(scored, F.array(scorers(cell("goal_cells", 0)), scorers(cell("goal_cells", 3)))).alias("goals"),
        F.when(scored, F.array(booked(cell("goal_cells", 1)), booked(cell("goal_cells", 4)))).alias("cards"),
    )


def season_with_sheets(pages: DataFrame, slug: str = "slug", column: str = "html") -> DataFrame:
    """A team's matches with their details, and its own side of each sheet: line by name, goals and cards by side.

    Details and sheets are read from a block in one pass.
    """
    base = [c for c in pages.columns if c != column]
    below = _with_sheets(_with_details(match_blocks(pages, column))).withColumn("gameid", _gameid()).drop("block")
    joined = season_matches(pages, slug, column).join(first_by(below, [*base, "gameid"], "gameid"), [*base, "gameid"], "left")
    shown = [c for c in joined.columns if c not in below.columns or c in (*base, "gameid")]
    at = F.when(F.col("home"), 0).otherwise(1)
    named = F.array_position("sides", F.col("own_name"))
    own_line = F.when(F.col("sides").isNotNull() & (named > 0), F.get("lines", (named - 1).cast("int")))
    return results_of(joined.select(*shown, "half", "referee", "report", own_line.alias("line"), F.get("goals", at).alias("goals"), F.get("cards", at).alias("cards")))


def jersey_colours(pages: DataFrame, column: str = "html") -> DataFrame:
    """(.., team, colours): rows of a division's page of jerseys, by the identifier of the team's name; the last of one name."""
    base = [c for c in pages.columns if c != column]
    found = rows(pages, column).withColumn("filled", F.filter("texts", lambda t: t != ""))
    kept = found.filter((F.size("filled") >= 2) & (F.lower(F.get("filled", F.lit(0))) != "tým"))
    named = kept.select(*base, "row", ascii_id(F.get("filled", F.lit(0))).alias("team"), F.get("filled", F.lit(1)).alias("colours"))
    return named.groupBy(*base, "team").agg(F.max_by("colours", "row").alias("colours"))


def with_colours(teams: DataFrame, colours: DataFrame, by: list[str], name: str) -> DataFrame:
    """Teams with the colours of their division's page; teams that it lacks stay without."""
    return teams.withColumn("team", ascii_id(F.col(name))).join(colours, [*by, "team"], "left").drop("team")
