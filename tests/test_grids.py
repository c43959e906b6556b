"""Grid operators, map coordinates, lookups and isolated failures on small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrace.functions import geometry, projection
from terrace.functions.text import fold, key
from terrace.operators import grids, lookup, ordering

CELL = "grid string, y int, x int, value long"


def random_cells(seed: int, height: int, width: int) -> list:
    rng = random.Random(seed)
    return [("g", y, x, rng.randint(-9, 9)) for y in range(height) for x in range(width)]


@pytest.mark.parametrize("tile", [1, 3, 64])
def test_summed_area_carries_between_tiles(spark, tile):
    cells = random_cells(1, 7, 10)
    got = {(r["y"], r["x"]): (r["area"], r["squares"]) for r in grids.summed_area(spark.createDataFrame(cells, CELL), tile).collect()}
    for y in range(7):
        for x in range(10):
            inside = [v for _, cy, cx, v in cells if cy <= y and cx <= x]
            assert got[y, x] == (sum(inside), sum(v * v for v in inside))


def test_background_is_clipped_at_the_ends(spark):
    cells = random_cells(2, 5, 6)
    for r in grids.local_background(spark.createDataFrame(cells, CELL), reach=2, tile=2).collect():
        near = [v for _, y, x, v in cells if abs(y - r["y"]) <= 2 and abs(x - r["x"]) <= 2]
        mean = sum(near) / len(near)
        assert (r["n"], r["mean"]) == (len(near), pytest.approx(mean))
        assert r["sd"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in near) / len(near)), abs=1e-6)


def regions(cells: list, strict: int, loose: int) -> dict:
    held = {(y, x): v for _, y, x, v in cells if v >= loose}
    out, seen = {}, set()
    for start in sorted(held):
        if start in seen:
            continue
        part, todo = set(), [start]
        while todo:
            y, x = todo.pop()
            if (y, x) in part or (y, x) not in held:
                continue
            part.add((y, x))
            todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        seen |= part
        if any(held[c] >= strict for c in part):
            out |= dict.fromkeys(part, start)
    return out


def test_regions_grow_through_loose_cells_and_by_corners(spark):
    spiral = ["#######", "......#", "#####.#", "#...#.#", "#.###.#", "#.....#", "#######"]
    drawn = [("g", y, x, 1 if c == "#" else 0) for y, row in enumerate(spiral) for x, c in enumerate(row)]
    drawn[0] = ("g", 0, 0, 5)
    for cells in (drawn, random_cells(3, 12, 12), random_cells(4, 20, 9)):
        strict, loose = (5, 1) if cells is drawn else (9, 4)
        found = grids.grown_regions(spark.createDataFrame(cells, CELL), F.col("value") >= strict, F.col("value") >= loose)
        assert {(r["y"], r["x"]): tuple(r["region"]) for r in found.collect()} == regions(cells, strict, loose)


def test_an_angle_is_found_and_a_plain_grid_takes_the_first(spark):
    turn = math.radians(4)
    lines = [("g", y, x, 100 if round((x - 20) * math.cos(turn) + (y - 20) * math.sin(turn)) % 8 == 0 else 0) for y in range(41) for x in range(41)]
    flat = [("flat", y, x, 7) for y in range(3) for x in range(3)]
    got = {r["grid"]: r["angle"] for r in grids.best_angle(spark.createDataFrame(lines + flat, CELL), (20, 20), [float(d) for d in range(-6, 7)]).collect()}
    assert got == {"g": 4.0, "flat": -6.0}


def test_edges_settle_on_lines_and_stay_in_their_bands(spark):
    def value(y: int, x: int) -> int:
        return 100 * ((x in (5, 26) and 8 <= y <= 22) or (y in (8, 22) and 5 <= x <= 26)) + (60 if x == 0 else 0)

    cells = [(g, y, x, value(y, x)) for g in ("a", "b") for y in range(31) for x in range(31)]
    start = spark.createDataFrame([("a", 4, 27, 7, 23), ("b", 15, 16, 7, 23)], "grid string, left int, right int, top int, bottom int")
    got = {r["grid"]: r for r in grids.fitted_edges(spark.createDataFrame(cells, CELL), start, 3, 3).collect()}
    assert [round(got["a"][e]) for e in grids.EDGES] == [5, 26, 8, 22]
    assert got["a"]["passes"] < 4
    assert abs(got["b"]["left"] - 15) <= 4 and abs(got["b"]["right"] - 16) <= 4


def test_projection_meets_its_published_example_and_returns(spark):
    lon, lat = 16 + 50 / 60 + 59.179 / 3600, 50 + 12 / 60 + 32.442 / 3600
    df = spark.createDataFrame([(lon, lat)], "lon double, lat double")
    east, north = projection.project(F.col("lon"), F.col("lat"))
    r = df.select(east.alias("e"), north.alias("n")).first()
    assert (r["e"], r["n"]) == (pytest.approx(-568991.0, abs=0.02), pytest.approx(-1050538.63, abs=0.02))
    places = spark.createDataFrame([(-900000.0 + 90000 * i, -950000.0 - 35000 * i) for i in range(7)], "e double, n double")
    lon, lat = projection.to_world(F.col("e"), F.col("n"))
    east, north = projection.from_world(F.col("lon"), F.col("lat"))
    for r in places.withColumns({"lon": lon, "lat": lat}).withColumns({"e2": east, "n2": north}).collect():
        assert abs(r["e"] - r["e2"]) < 1e-3 and abs(r["n"] - r["n2"]) < 1e-3
        assert 12 < r["lon"] < 20 and 48 < r["lat"] < 51.5


def test_fold_follows_unicode(spark):
    cases = {"Nguyễn": "nguyen", "été": "ete", "Ștefan": "stefan", "ÅNGSTRÖM": "angstrom", "Łódź": "łodz", "Ώ": "ω", "x²": "x2", "plain": "plain", "ß": "ß"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["f"] for r in df.select("s", fold(F.col("s")).alias("f")).collect()} == cases
    assert df.filter("s = 'Nguyễn'").select(key(F.col("s"))).first()[0] == "nguyen"


def test_lookup_by_label_then_by_unique_name(spark):
    teams = spark.createDataFrame([(1, "Čápi", "2.A"), (2, "Čápi", "3.B"), (3, "Volavky", "1.A"), (4, "Volavky", "1.A")], "id int, name string, division string")
    asked = ["capi (2.a)", "Čápi (9.Z)", "Volavky (1.A)", "Volavky", "Nikdo", None, "Čápi (3.B) "]
    one = teams.filter("id in (1, 3)")
    both = lambda t: {r["label"]: (r["found"], r["by"]) for r in lookup.lookup_cascade(spark.createDataFrame([(a,) for a in asked], "label string"), "label", t, "id", "name", "division").collect()}
    assert both(teams) == {"capi (2.a)": (1, "label"), "Čápi (9.Z)": (None, None), "Volavky (1.A)": (3, "label"), "Volavky": (None, None), "Nikdo": (None, None), None: (None, None), "Čápi (3.B) ": (None, None)}
    assert both(one)["Čápi (9.Z)"] == (1, "name") and both(one)["Volavky"] == (3, "name")


def test_a_failed_key_neither_stops_nor_vanishes(spark):
    rows = spark.createDataFrame([("a", "4"), ("a", "x"), ("b", None), ("c", "2"), ("c", "0")], "k string, raw string")
    number = F.col("raw").try_cast("int")
    good, bad = lookup.isolated(rows, {"blank": F.col("raw").isNotNull()}, {"number": number, "share": F.try_divide(F.lit(8), number)})
    got = lookup.results_by_key(rows, "k", good.groupBy("k").agg(F.sum("share").alias("share")), bad).collect()
    assert {r["k"]: (r["share"], r["failed"], r["error"]) for r in got} == {"a": (2.0, 1, "no number"), "b": (None, 1, "blank"), "c": (4.0, 1, "no share")}
    assert sorted((r["k"], r["raw"], r["error"]) for r in bad.collect() if r["raw"]) == [("a", "x", "no number"), ("c", "0", "no share")]


def test_measured_sections_turn_with_their_field(spark):
    """A field of 100 x 40 pixels, upright: the long axis points south, and the first section lies at the end named."""
    edges = F.array(F.array(F.lit(1.0), F.lit(4.0)), F.array(F.lit(5.0), F.lit(9.0)))
    at = lambda w, h, angle, end: [tuple(round(x, 6) for x in s) for s in spark.range(1).select(geometry.measured_sections(F.lit(200.0), F.lit(300.0), F.lit(w), F.lit(h), F.lit(angle), edges, F.lit(0.1), end).alias("s")).first()["s"]]
    assert at(100.0, 40.0, 0.0, "W") == [(175.0, 300.0, 30.0, 40.0), (220.0, 300.0, 40.0, 40.0)]
    assert at(100.0, 40.0, 0.0, "E") == [(220.0, 300.0, 40.0, 40.0), (175.0, 300.0, 30.0, 40.0)]
    assert at(40.0, 100.0, 0.0, "S") == [(200.0, 320.0, 40.0, 40.0), (200.0, 275.0, 40.0, 30.0)]
    assert at(100.0, 40.0, 90.0, "N") == [(200.0, 275.0, 30.0, 40.0), (200.0, 320.0, 40.0, 40.0)]
    r = spark.range(1).select(geometry.bounded_rectangle(F.lit(200.0), F.lit(300.0), F.lit(100.0), F.lit(40.0), F.lit(90.0), F.array(F.lit(0.0), F.lit(5.0), F.lit(0.0), F.lit(4.0)), F.lit(0.1)).alias("r")).first()["r"]
    assert tuple(round(x, 6) for x in r) == (200.0, 275.0, 50.0, 40.0)


def test_places_over_many_ranges(spark):
    rows = [(i * 37 % 101, "x") for i in range(101)]
    got = ordering.numbered(spark.createDataFrame(rows, "k int, v string").repartition(5), F.col("k").desc()).collect()
    assert sorted((r["place"], r["k"]) for r in got) == [(i + 1, 100 - i) for i in range(101)]
    assert ordering.numbered(spark.createDataFrame([], "k int"), F.col("k")).count() == 0
