import json

from pyspark.sql import functions as F

from terrace.plans import publish
from terrace.sources import documents, html

FIXTURES = """<table>
<tr><th>R</th><th>Date</th></tr>
<tr><td>1.</td><td>Čt 17.9.26</td><td>18:30</td><td><a href="/v#MIKU4">MIKU4</a></td><td>Red Lions - Blue Owls</td><td class="is-result">3:1</td></tr>
<tr><td></td><td>24. 9. 26</td><td>19:00</td><td><a href="/v#P2">P2</a></td><td>Green Foxes - Red Lions</td><td class="is-result is-gray">0:2</td></tr>
<tr><td>3.</td><td>Čt 17.9.26</td><td>18:30</td><td><a href="/v#MIKU4">MIKU4</a></td><td>Red Lions - Blue Owls</td><td></td></tr>
<tr><td>4.</td><td>1.10.26</td><td>19:00</td><td><a href="/v#P2">P2</a></td><td>Green Foxes - Blue Owls</td><td></td></tr>
</table>"""


def test_fixtures(spark):
    pages = spark.createDataFrame([("Red Lions", FIXTURES)], "team string, html string")
    rows = {r["code"]: r.asDict() for r in html.fixtures(pages).collect()}
    assert set(rows) == {"MIKU4", "P2"}
    assert rows["MIKU4"]["official"] and rows["MIKU4"]["score"] == "3:1" and rows["MIKU4"]["opponent"] == "Blue Owls" and rows["MIKU4"]["home"]
    assert not rows["P2"]["official"] and rows["P2"]["score"] == "0:2" and not rows["P2"]["home"] and rows["P2"]["round"] == 2


def test_standings_in_either_wrapping(spark):
    body = '<table><tr><td>1.</td><td><a href="/team/red-lions/">Red Lions</a></td><td>10</td><td>8</td><td>1</td><td>1</td><td>30 : 9</td><td>17</td></tr><tr><td>x</td></tr></table>'
    pages = spark.createDataFrame([(1, body), (2, json.dumps({"html": body}))], "page int, html string")
    rows = [tuple(r) for r in html.standings(pages).collect()]
    assert sorted(rows) == [(p, 1, "red-lions", 10, 8, 1, 1, "30:9", 17) for p in (1, 2)]


def test_venues_last_repeat_wins(spark):
    row = '<tr><td><a name="{c}">x</a>{n}</td><td>Street 1</td><td>notes</td><td><a href="https://maps.example/?q=50.0865%2C14.4111">map</a></td></tr>'
    page = "<table>" + row.format(c="AA", n="Old") + row.format(c="AA", n="New") + "<tr><td>one</td></tr></table>"
    r = html.venues(spark.createDataFrame([(page,)], "html string")).first()
    assert r["code"] == "AA" and "New" in r["name"] and (r["lat"], r["lon"]) == (50.0865, 14.4111)


def test_people_and_scorers(spark):
    df = spark.createDataFrame([('Ann Gate - Bob Hill, <b class="is-captain">Cid Ray</b>, <i class="is-best">Dan Oak</i>', "42., 46. Bob Hill, 7. Cid Ray")], "l string, s string")
    r = df.select(html.people(F.col("l")).alias("p"), html.scorers(F.col("s")).alias("g")).first()
    assert [(p["n"], p["gk"], p["cap"], p["best"]) for p in r["p"]] == [("Ann Gate", True, False, False), ("Bob Hill", False, False, False), ("Cid Ray", False, True, False), ("Dan Oak", False, False, True)]
    assert [(g["m"], g["n"]) for g in r["g"]] == [([42, 46], "Bob Hill"), ([7], "Cid Ray")]


def test_query_ids(spark):
    assert spark.createDataFrame([("/x?a=1&amp;b=2#t",)], "u string").select(html.query_ids(F.col("u")).alias("m")).first()["m"] == {"a": "1", "b": "2"}


def test_match_details(spark):
    page = '<div id="game-7">(1:0)<br>Referee: Jo Fox<br>Report: fine game</div><div id="game-8">none</div>'
    rows = {r["gameid"]: r for r in html.match_details(spark.createDataFrame([(page,)], "html string")).collect()}
    assert (rows[7]["half"], rows[7]["referee"], rows[7]["report"]) == ("1:0", "Jo Fox", "fine game") and rows[8]["half"] is None


def test_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/2020-x-jaro.json").write_text(json.dumps({"red": "1-a"}))
    (tmp_path / "a/2020-x-podzim.json").write_text("{}")
    (tmp_path / "t").mkdir()
    (tmp_path / "t/2020-x-jaro.json").write_text(json.dumps({"1-a": [[1, "red", "10", "8", "1", "1", "30:9", "13"]]}))
    (tmp_path / "v.json").write_text(json.dumps({"A": {"code": "A", "name": "old", "lat": 1.5}, "B": {"name": "b"}}))
    (tmp_path / "e.json").write_text(json.dumps({"A": {"name": "new"}, "_c": {"name": "comment"}}))
    (tmp_path / "o.json").write_text(json.dumps({"players": ["X"], "teams": []}))
    at = f"file://{tmp_path}"
    assert documents.archive(spark, f"{at}/a").collect() == [("2020-x-jaro", "red", "1-a")] and documents.seasons(spark, f"{at}/a").count() == 2
    assert tuple(documents.standings(spark, f"{at}/t").first()) == ("2020-x-jaro", "1-a", 1, "red", 10, 8, 1, 1, "30:9", 13)
    assert sorted((r["code"], r["name"]) for r in documents.venues(spark, f"{at}/v.json", f"{at}/e.json").collect()) == [("A", "new"), ("B", "b")]
    assert documents.opt_outs(spark, f"{at}/o.json").collect() == [("player", "X")]


def test_publish(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, None), ("a", 2, "x")], "slug string, n int, note string")
    p = publish.payloads(rows, "slug")
    assert {r["slug"]: r["payload"] for r in p.collect()} == {"b": '{"n":1}', "a": '{"n":2,"note":"x"}'}
    path = publish.write_release(p, "slug", f"file://{tmp_path}")
    assert publish.write_release(p.orderBy("slug"), "slug", f"file://{tmp_path}") == path
    assert spark.read.text(path).count() == 2
    assert publish.markdown_rows(rows, ["slug", "note"]).collect()[0]["line"] == "| b |  |"


def test_calendars(spark):
    f = spark.sql("select 'Red' team, 'Blue, FC' opponent, date'2026-09-17' day, '18:30' time, 'P2' ground, false home")
    text = publish.calendars(f).first()["calendar"]
    assert text.startswith("BEGIN:VCALENDAR\r\n") and text.endswith("END:VCALENDAR\r\n")
    assert "DTSTART:20260917T183000" in text and "DTEND:20260917T194500" in text and "SUMMARY:Blue\\, FC – Red" in text
