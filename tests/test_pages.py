"""Season pages with sheets, jersey pages, tables filled on demand, lines with a flush end."""

import random
import statistics

import pytest

from terrace.operators import profiles
from terrace.sources import html
from terrace.sources.documents import FilledTable, seasons_by_family

LINK = '<a href="/souteze/s/1-a/tymy/{}/">{}</a>'


def row(day: str, code: str, first: tuple, second: tuple, score: str, game: str = "") -> str:
    return f'<tr><td>{day}</td><td><a href="/hriste/#{code}">x</a><i data-gameid="{game}"></i></td><td>{LINK.format(*first)}</td><td>{LINK.format(*second)}</td><td>{score}</td></tr>'


US, THEM, THIRD = ("capi", "Čápi &amp; synové"), ("vlci", "Vlci"), ("rysi", "Rysi")
SHEET = (
    '<div id="game-7"><p>2:1 (1:0)</p><br>Rozhodčí: Jan Novák<br>Zpráva: klid<table class="has-smaller-text"><tr><th>Vlci</th><th> </th><th>Čápi &amp; synové</th></tr>\n<tr><td>A B - C D</td><td>-</td>'
    '<td>E F - <b class="is-captain">G H</b>, <i class="is-best">I J</i></td></tr></table><table><tr><th>Góly</th></tr><tr><td>3. C D</td><td>9. A B<br> </td><td></td><td>42., 46. G H</td><td>5. I J<br/>7. E F</td></tr></table></div>'
)


def test_a_season_page_gives_own_sides_of_sheets(spark):
    page = "<table>" + row("So 5.9.26", "HAB", THEM, US, "2:1", "7") + row("So 5.9.26", "HAB", US, THIRD, "0:0") + row("Ne 6.9.26", "P2", THEM, THIRD, "3:3") + row("Ne 13.9.26", "P2", US, THIRD, "-") + '</table><a name="gameResults"></a>' + SHEET
    got = html.season_with_sheets(spark.createDataFrame([("capi", page)], "slug string, html string")).orderBy("row").collect()
    assert [(str(r["day"]), r["code"], r["opp_slug"], r["opponent"], r["home"], r["score"], r["gameid"]) for r in got] == [("2026-09-05", "HAB", "vlci", "Vlci", False, "2:1", 7), ("2026-09-13", "P2", "rysi", "Rysi", True, None, None)]
    one, two = got
    assert (one["half"], one["referee"], one["gf"], one["ga"], one["res"]) == ("1:0", "Jan Novák", 1, 2, "L")
    assert [(p["n"], p["gk"], p["cap"], p["best"]) for p in one["line"]] == [("E F", True, False, False), ("G H", False, True, False), ("I J", False, False, True)]
    assert [(g["m"], g["n"]) for g in one["goals"]] == [([42, 46], "G H")] and one["cards"] == ["5. I J", "7. E F"]
    assert two["line"] is None and two["goals"] is None and two["res"] is None


def test_jersey_pages(spark):
    page = "<tr><th>Tým</th><th>Barva dresu</th></tr><tr><td>Čápi</td><td> </td><td><b>bílá</b>, černá</td></tr><tr><td>Vlci</td><td></td></tr><tr><td>ČÁPI</td><td>modrá</td></tr>"
    found = html.jersey_colours(spark.createDataFrame([("x", "1", page), ("y", "1", "")], "comp string, division string, html string"))
    teams = spark.createDataFrame([("x", "1", "Čápi"), ("y", "1", "Čápi"), ("x", "1", "Vlci")], "comp string, division string, name string")
    got = {(r["comp"], r["name"]): r["colours"] for r in html.with_colours(teams, found, ["comp", "division"], "name").collect()}
    assert got == {("x", "Čápi"): "modrá", ("y", "Čápi"): None, ("x", "Vlci"): None}


def test_a_filled_table_asks_once_for_each_key(spark, tmp_path):
    asked = []

    def fill(keys):
        held = sorted(r["k"] for r in keys.collect())
        asked.append(held)
        return spark.createDataFrame([(k, f"v{k}") for k in held if k != "none" for _ in range(2)], "k string, v string")

    make = lambda: FilledTable(spark, f"file://{tmp_path}/t", "k", "k string, v string")
    keys = lambda *names: spark.createDataFrame([(n,) for n in names], "k string")
    assert sorted(map(tuple, make().get(keys("a", "none", "a"), fill).collect())) == [("a", "va")] * 2
    assert sorted(map(tuple, make().get(keys("a", "b", "none"), fill).collect())) == [("a", "va")] * 2 + [("b", "vb")] * 2
    assert asked == [["a", "none"], ["b"]]
    # A fill that was cut off does not count and is done anew.
    (tmp_path / "t" / "fill-cut" / "keys").mkdir(parents=True)
    assert make().get(keys("c"), fill).count() == 2 and asked[-1] == ["c"]


def test_families_newest_first(spark):
    rows = [("f", "2024-p", 4049), ("f", "2025-j", 4050), ("f", "2024-p", 4049), ("g", "x", 1)]
    got = {r["family"]: r["seasons"] for r in seasons_by_family(spark.createDataFrame(rows, "family string, season string, o int"), "family", "season", "o").collect()}
    assert got == {"f": ["2025-j", "2024-p"], "g": ["x"]}


def brute_lines(v: list, a: int, b: int, least: int, most: int, flush, reach: int, margin: int):
    base = statistics.median(v[a:b])
    lines = [i for i in range(a, b) if v[i] >= max(v[max(i - reach, 0) : i + reach + 1]) and v[i] > 2 * base]
    best, score = None, -1.0
    for i in lines:
        for j in lines:
            if least <= j - i <= most and not (flush == "start" and i > a + margin) and not (flush == "end" and j < b - margin) and min(v[i], v[j]) > score:
                best, score = (i, j), min(v[i], v[j])
    return best


@pytest.mark.parametrize("flush", [None, "start", "end"])
def test_goal_lines_equal_all_pairs(spark, flush):
    rng, data, want = random.Random(8), [], {}
    for k in range(12):
        v = [float(rng.choice([0, 1, 1, 2, 3, 9, 12])) for _ in range(120)]
        data += [(k, i, x) for i, x in enumerate(v)]
        want[k] = brute_lines(v, 10, 110, 30, 60, flush, 2, 8)
    spans = spark.createDataFrame([(k, 10, 110, 30, 60, flush) for k in range(12)], "profile_id int, a int, b int, least int, most int, flush string")
    got = {r["profile_id"]: (r["i"], r["j"]) for r in profiles.goal_lines(spark.createDataFrame(data, "profile_id int, idx int, value double"), spans, 2, 8).collect()}
    assert got == {k: w for k, w in want.items() if w}
