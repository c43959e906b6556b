import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from terrace.operators import careers, dedupe, meetings, merge, profiles, programme, squads
from terrace.streaming.log import ResultTable, latest_known


def walk(seasons, played, gap):
    """The direct walk from the newest season back."""
    out, missed = [], None
    for s in sorted(seasons, reverse=True):
        if s in played:
            out.append(s)
            missed = 0
        elif missed is not None:
            missed += 1
            if missed == gap:
                break
    return out


def test_career_equals_a_walk(spark):
    rng = random.Random(1)
    seasons = [s for s in range(4000, 4040) if s != 4017]
    teams = {t: {s for s in seasons if rng.random() < rng.choice([0.1, 0.3, 0.6])} for t in range(120)}
    presence = spark.createDataFrame([("f", t, s) for t, p in teams.items() for s in p], "family string, slug int, season int")
    positions = careers.season_positions(spark.createDataFrame([("f", s) for s in seasons], "family string, season int"))
    got = {}
    for r in careers.career(presence, positions).collect():
        got.setdefault(r["slug"], []).append(r["season"])
    assert {t: sorted(v, reverse=True) for t, v in got.items()} == {t: walk(seasons, p, 4) for t, p in teams.items() if p}


@pytest.mark.parametrize(("missed", "kept"), [(3, 2), (4, 1), (5, 1)])
def test_career_gap(spark, missed, kept):
    seasons = list(range(100, 120))
    presence = spark.createDataFrame([("f", 1, 119), ("f", 1, 119 - missed - 1)], "family string, slug int, season int")
    positions = careers.season_positions(spark.createDataFrame([("f", s) for s in seasons], "family string, season int"))
    assert careers.career(presence, positions).count() == kept


def test_equal_placings_go_to_the_newest(spark):
    line = spark.createDataFrame([("f", 1, 10, 2, 3), ("f", 1, 12, 2, 3), ("f", 1, 11, 1, None)], "family string, slug int, season int, level int, place int")
    r = careers.best_and_worst(line).first()
    assert (r["best_season"], r["worst_season"], r["titles"], r["last_title"]) == (12, 12, 0, None)


def test_equal_margins_go_to_the_earliest(spark):
    rows = [("f", 1, 10, date(2024, 1, d), d, 1, 2, 1) for d in (3, 1, 2)]
    m = spark.createDataFrame(rows, "family string, slug int, season int, day date, match_id int, line int, gf int, ga int")
    r = meetings.extremes(m).first()
    assert r["best_match"] == 1 and r["worst_match"] == 1


def test_first_by_and_unique(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert sorted(map(tuple, dedupe.first_by(df, ["k"], "o").collect())) == [("a", 1, "y"), ("b", 1, "z")]
    assert dedupe.unique_only(df, ["k"], "v", "only").collect() == [("b", "z")]
    with pytest.raises(Exception, match="repeated key"):
        dedupe.assert_unique(df, ["k"]).collect()
    assert dedupe.assert_unique(df, ["k", "o"]).count() == 3


def test_merge_never_erases(spark):
    held = spark.createDataFrame([(1, "d", "c", 1, "2:1", False), (1, "d", "c", 2, "0:0", True), (1, "d", "c", 9, "5:5", True), (2, "d", "c", 1, "1:1", True)], "team int, day string, code string, opponent int, score string, official boolean")
    fresh = spark.createDataFrame([(1, "d", "c", 1, None, True), (1, "d", "c", 2, "0:1", False), (1, "d", "c", 3, None, False)], held.schema)
    got = {tuple(r)[:1] + (r["opponent"],): (r["score"], r["official"], r["changed"]) for r in merge.merge_results(held, fresh).collect()}
    assert got == {(1, 1): ("2:1", False, False), (1, 2): ("0:1", False, True), (1, 3): (None, False, False), (2, 1): ("1:1", True, False)}


def test_stale(spark):
    df = spark.createDataFrame([("2024-01-10", "1:0", False), ("2024-01-09", None, False), ("2024-01-20", None, None), ("2024-01-21", None, None), ("2024-01-15", "1:1", True)], "day string, score string, official boolean")
    day = F.col("day").cast("date")
    assert df.filter(merge.is_stale(day, F.col("score"), F.col("official"), "2024-01-20")).count() == 2
    assert df.filter(merge.is_stale(day, F.col("score"), F.col("official"), "2024-01-20", missing_only=True)).count() == 1


def test_range_roll_up_of_everything_is_the_direct_sum(spark):
    rng = random.Random(2)
    lineups = [(1, rng.randrange(10), f"p{rng.randrange(8)}", i, i, date(2024, 1, 1), rng.random() < 0.2, False, False) for i in range(200)]
    goals = [(1, rng.randrange(10), f"p{rng.randrange(12)}", i, i, date(2024, 1, 1), 2) for i in range(100)]
    a = spark.createDataFrame(lineups, "team int, season int, player string, match_id int, line int, day date, best boolean, gk boolean, cap boolean")
    g = spark.createDataFrame(goals, "team int, season int, player string, match_id int, line int, day date, goals int")
    rows = squads.roll_up(squads.partials(a, g), None, 3).collect()
    assert sum(r["apps"] for r in rows) == 200
    seen = {p for _, _, p, *_ in lineups}
    assert {r["own_goals"] for r in rows} == {2 * sum(p not in seen for _, _, p, *_ in goals)}
    assert squads.roll_up(squads.partials(a, g), 7, 4).select(F.min("first_season"), F.max("last_season")).first() == (4, 7)
    out = spark.createDataFrame([("p1",)], "player string")
    assert squads.partials(a, g, out).filter("player = 'p1'").count() == 0


def test_programme_orders_codes_by_number(spark):
    f = spark.createDataFrame([("g", "d", 600, "P10", "a", "b", 1), ("g", "d", 600, "P2", "c", "d", 2), ("g", "d", 540, "P3", "e", "f", 3), ("g", "d", 600, "P2", "c", "d", 9)], "ground string, day string, minute int, code string, home string, away string, ord int")
    rows = programme.programme(f).orderBy("slot").collect()
    assert [r["code"] for r in rows] == ["P3", "P2", "P10"] and rows[1]["ord"] == 2 and rows[0]["others"] == 2


def _profile(spark, values):
    return spark.createDataFrame([("p", i, float(v)) for i, v in enumerate(values)], "profile_id string, idx int, value double")


def test_peaks_bands_and_nearest(spark):
    rng = random.Random(3)
    values = [rng.randrange(1, 30) for _ in range(300)]
    peaks = profiles.local_maxima(_profile(spark, values), 1.1)
    base = sorted(values)[149:151]
    base = sum(base) / 2
    want = [i for i in range(1, 299) if values[i] >= max(values[i - 1], values[i + 1]) and values[i] / base > 1.1]
    got = sorted(r["idx"] for r in peaks.collect())
    assert got == want
    best = min(((-min(values[i], values[j]), i, j) for i in want for j in want if 5 <= j - i <= 17))
    r = profiles.band_pairs(peaks, 5, 17).first()
    assert (r["i"], r["j"], r["strength"]) == (best[1], best[2], -best[0])
    edges = spark.createDataFrame([("p", e) for e in range(0, 300, 11)], "profile_id string, edge int")
    for r in profiles.nearest_peak(edges, peaks, 9).collect():
        near = sorted((abs(i - r["edge"]), -values[i], i) for i in want if abs(i - r["edge"]) <= 9)
        assert r["idx"] == (near[0][2] if near else None)


def test_empty_profile(spark):
    assert profiles.local_maxima(_profile(spark, [0, 0, 0]), 2.0).count() == 0


def test_division_grid_finds_planted_lines(spark):
    values = [1.0] * 100
    for i in (10, 40, 70):
        values[i] = 50.0
    r = profiles.division_grid(_profile(spark, values), 2, [0, 4], [40, 50, 60, 70], [0, 5, 10, 15]).first()
    assert (r["gap"], r["start"], r["length"]) == (0, 10, 60)


def test_stream_table_is_idempotent_and_order_free(spark, tmp_path):
    rows = [(t, "c", None if (t + i) % 3 == 0 else f"{i}:0", i) for t in range(5) for i in range(12)]
    df = spark.createDataFrame(rows, "team int, code string, score string, event_id int")
    table = ResultTable(spark, f"file://{tmp_path}", ["team", "code"], "event_id")
    for n, part in enumerate((df.filter("event_id < 5"), df.filter("event_id >= 5"), df.filter("event_id < 3"))):
        table.merge(part, n)
    want = latest_known(df, ["team", "code"], "event_id")
    assert sorted(table.read().collect()) == sorted(want.collect())
    assert want.filter("score is null").count() == 0
