import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from terrace.functions import calendar, geometry, rules, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int' if isinstance(v, int) else 'array<double>'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("c")).first()["c"]


def test_accents_match_unicode(spark):
    bare = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    assert "".join(map(bare, text.ACCENTED)) == text.PLAIN and set("áčďéěíňóřšťúůýžễșǧώ") <= set(text.ACCENTED)


@pytest.mark.parametrize(("raw", "want"), [("Žižkov Č.2", "zizkovc2"), ("ÚJEZD straße", "ujezdstraße".replace("ß", "")), ("", "")])
def test_key(spark, raw, want):
    assert one(spark, text.key(F.col("t")), t=raw) == want


def test_strip_tags_decodes_in_order(spark):
    assert one(spark, text.strip_tags(F.col("t")), t="<p>A<br/>B &amp;lt; <b>C</b>&nbsp; D</p>") == "A\nB < C D"


def test_calendar_fold_keeps_characters_whole(spark):
    line = "SUMMARY:" + "é" * 80 + "x" * 90
    folded = one(spark, text.calendar_fold(F.col("t")), t=line)
    parts = folded.split("\r\n")
    assert all(len(p.encode()) <= 73 for p in parts) and parts[0] + "".join(p[1:] for p in parts[1:]) == line
    assert one(spark, text.calendar_fold(F.col("t")), t="") == ""


def test_calendar_escape(spark):
    assert one(spark, text.calendar_escape(F.col("t")), t="a,b;c\\d\ne") == r"a\,b\;c\\d\ne"


@pytest.mark.parametrize(("raw", "want"), [("Čt 17.9.26", "2026-09-17"), ("17. 9. 2026", "2026-09-17"), ("31. 2. 26", None), ("soon", None), (None, None)])
def test_parse_day(spark, raw, want):
    got = one(spark, calendar.parse_day(F.col("t")), t=raw)
    assert (str(got) if got else None) == want


def test_minutes_and_slot(spark):
    assert one(spark, calendar.minutes(F.col("t")), t="18:05") == 1085
    assert one(spark, calendar.minutes(F.col("t")), t="") == 0
    start, end = calendar.slot(F.lit("2026-09-17").cast("date"), F.col("t"))
    assert str(one(spark, start, t="23:15")) == "2026-09-17 23:15:00" and str(one(spark, end, t="23:15")) == "2026-09-18 00:30:00"


def test_seasons(spark):
    s = "2026-veteranska-liga-podzim"
    assert one(spark, calendar.family(F.col("s")), s=s) == "veteranska-liga"
    assert one(spark, calendar.season_order(F.col("s")), s=s) == 4053
    assert one(spark, calendar.season_code(F.col("s")), s=s) == "p2026"
    assert one(spark, calendar.season_label(F.col("s")), s=s) == "podzim 2026"
    assert one(spark, calendar.level(F.col("s")), s="3-b") == 3 and one(spark, calendar.level(F.col("s")), s="x") is None
    assert one(spark, calendar.is_lettered(F.col("s")), s="3-b") and not one(spark, calendar.is_lettered(F.col("s")), s="3-b\n")


def test_division_label_tries_the_longer_tag_first(spark):
    assert one(spark, calendar.division_label(F.col("c"), F.lit("2-a")), c="2026-superveteranska-liga-jaro") == "2-a super"
    assert one(spark, calendar.division_label(F.col("c"), F.lit("2-a")), c="2026-veteranska-liga-jaro") == "2-a vet"


@pytest.mark.parametrize(
    ("line", "want"),
    [("boots allowed", "allowed"), ("no boots", "forbidden"), ("boots", "unknown"), ("allowed", "unknown"), ("no boots: ok allowed", "forbidden"), ("allowed boots nothing", "forbidden"), ("allowed boots then nothing", "allowed"), ("xx boots xxno allowed", "forbidden")],
)
def test_nearest_verdict(spark, line, want):
    def brute(t):
        at = t.find("boots")
        if at < 0:
            return "unknown"
        near = lambda ws: min((abs(i - at) for w in ws for i in range(len(t)) if t.startswith(w, i)), default=None)
        yes, no = near(["allowed"]), near(["no"])
        if no is None:
            return "allowed" if yes is not None else "unknown"
        return "forbidden" if yes is None or no <= yes else "allowed"

    got = one(spark, rules.nearest_verdict(F.col("t"), "boots", ("allowed",), ("no",)), t=line)
    assert got == brute(line) == want


def test_scores(spark):
    gf, ga = rules.score_side(F.col("s"), F.lit(False))
    assert (one(spark, gf, s="2:5"), one(spark, ga, s="2:5")) == (5, 2)
    assert one(spark, rules.result(gf, ga), s="2:5") == "W" and one(spark, rules.result(gf, ga), s="") is None


def test_confidence_and_area(spark):
    assert [one(spark, rules.confidence(F.col("e")), e=e) for e in ([4.0, 9.0], [2.5, 9.0], [0.5])] == ["high", "medium", "low"]
    assert one(spark, rules.confidence(F.array().cast("array<double>"))) == "low"
    assert one(spark, rules.area(F.lit(2.5), F.lit(3.5))) == 8


def test_colours(spark):
    stems = {"cerven": "#FF0000", "modr": "#0000FF", "bil": "#FFFFFF"}
    assert one(spark, rules.colours(F.col("t"), stems), t="červeno-modré, bílé a zelené") == ["#FF0000", "#0000FF", "#FFFFFF"]
    assert one(spark, rules.colours(F.col("t"), stems, shirt_only=True), t="modré, bílé") == ["#0000FF"]
    assert one(spark, rules.colours(F.col("t"), stems), t="tmavě modré") == ["#000099"]


def test_clash(spark):
    rgb = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, rules.clash(rgb(0, 0, 0), rgb(10, 0, 0)))
    assert not one(spark, rules.clash(rgb(0, 0, 0), rgb(10, 0, 0), rgb(0, 0, 0), rgb(255, 255, 255)))
    assert not one(spark, rules.clash(F.lit(None).cast("array<int>"), rgb(10, 0, 0)))


def test_badges(spark):
    assert one(spark, rules.keeper_badge(F.lit(5), F.lit(10))) and not one(spark, rules.keeper_badge(F.lit(4), F.lit(4)))
    assert one(spark, rules.captain_badge(F.lit(5), F.lit(25))) and not one(spark, rules.captain_badge(F.lit(5), F.lit(26)))


def lits(*values):
    return [F.lit(v) for v in values]


def test_kernel_and_roi(spark):
    assert [one(spark, geometry.kernel_pixels(*lits(m, 0.1))) for m in (0.05, 0.5, 0.65, 0.8)] == [3, 5, 7, 9]
    assert tuple(one(spark, geometry.roi_box(*lits(400, 0.5, -20.0, 10.0, -300.0, 40.0)))) == (160, 0, 220, 280)
    assert tuple(one(spark, geometry.to_plane(*lits(10, 20, 1000.0, 2000.0, 0.5)))) == (1005.0, 1990.0)


@pytest.mark.parametrize(("angle", "w", "h"), [(0.0, 60.0, 30.0), (30.0, 60.0, 30.0), (120.0, 30.0, 60.0)])
@pytest.mark.parametrize("end", ["W", "E", "N", "S"])
def test_sections_tile_the_field_from_the_named_end(spark, angle, w, h, end):
    parts = one(spark, geometry.sections(*lits(100.0, 50.0, w, h, angle, 3), first_end=end))
    assert sum(p["w"] * p["h"] for p in parts) == pytest.approx(w * h)
    assert (sum(p["cx"] for p in parts) / 3, sum(p["cy"] for p in parts) / 3) == pytest.approx((100, 50))
    key = {"W": "cx", "E": "cx", "N": "cy", "S": "cy"}[end]
    order = [p[key] * (1 if end in "WN" else -1) for p in parts]
    assert all(b > a - 1e-9 for a, b in zip(order, order[1:], strict=False))
    assert math.dist((parts[0]["cx"], parts[0]["cy"]), (parts[1]["cx"], parts[1]["cy"])) == pytest.approx(20)


def test_corners_centroid_and_nudges(spark):
    points = one(spark, geometry.corners(*lits(10.0, 20.0, 6.0, 4.0, 90.0)))
    assert [(round(p["x"]), round(p["y"])) for p in points] == [(12, 17), (12, 23), (8, 23), (8, 17)]
    middle = one(spark, geometry.centroid(geometry.corners(*lits(10.0, 20.0, 6.0, 4.0, 33.0))))
    assert tuple(middle) == pytest.approx((10, 20))
    moved = one(spark, geometry.nudged(*lits(10.0, 20.0, 6.0, 4.0, 0.0), {"E": F.lit(2.0), "N": F.lit(-1.0)}))
    assert tuple(moved) == pytest.approx((9.0, 19.5, 4.0, 5.0))
    assert tuple(one(spark, geometry.nudged(*lits(1.0, 2.0, 3.0, 4.0, 5.0), {}))) == pytest.approx((1, 2, 3, 4))


def test_focal_point(spark):
    box = lambda x, y, w, h: geometry.corners(*lits(float(x), float(y), float(w), float(h), 0.0))
    at = lambda field, play: one(spark, geometry.focal(field, play, F.lit(1.0), F.lit(400)))
    assert tuple(at(box(200, 100, 100, 40), box(200, 100, 20, 20))) == (50, 50)
    assert at(box(200, 100, 100, 40), box(200, 100, 90, 20)) is None
    assert tuple(at(box(200, 100, 100, 40), box(175, 100, 20, 20))) == (8, 50)


def test_chart(spark):
    assert [one(spark, geometry.chart_x(*lits(i, n))) for i, n in ((0, 1), (0, 3), (2, 3))] == [62, 62, 652]
    assert [one(spark, geometry.chart_y(*lits(*v))) for v in ((2, 2, 2), (1, 1, 3), (3, 1, 3))] == [89, 18, 160]
    assert [one(spark, geometry.has_label(*lits(i, 15))) for i in range(4)] == [True, False, False, True]
