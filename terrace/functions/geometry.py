"""Rectangles in pixels, their sections and crops, and chart places, as column functions.

A rectangle is a centre (cx, cy), a size (w, h) and an angle in degrees; +x is east and +y south. Halves round to even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.functions.rules import compass

CHART = {"width": 660, "height": 186, "left": 62, "top": 18, "bottom": 26, "right": 8}
LABELS = 7


def kernel_pixels(metres: Column, res: Column, odd: bool = True) -> Column:
    """A filter's width for a length, at least 3, odd unless told otherwise."""
    n = F.greatest(F.bround(metres / res).cast("int"), F.lit(3))
    return n.bitwiseOR(F.lit(1)) if odd else n


def roi_box(size: Column, res: Column, west: Column, east: Column, north: Column, south: Column) -> Column:
    """(x0, y0, x1, y1): pixels of a region given in metres from the middle of a square tile, inside the tile."""
    place = lambda metres: F.bround(size / 2 + metres / res).cast("int")
    return F.struct(F.greatest(place(west), F.lit(0)).alias("x0"), F.greatest(place(north), F.lit(0)).alias("y0"), F.least(place(east), size).alias("x1"), F.least(place(south), size).alias("y1"))


def to_plane(px: Column, py: Column, x0: Column, y1: Column, res: Column) -> Column:
    """Map coordinates, in metres, of a pixel of a tile whose north-west corner is (x0, y1)."""
    return F.struct((x0 + px * res).alias("x"), (y1 - py * res).alias("y"))


def centroid(points: Column) -> Column:
    """Mean of an array of points (x, y)."""
    mean = lambda name: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[name]) / F.size(points)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """The four corners, in the order of turning."""
    cos, sin = F.cos(F.radians(angle)), F.sin(F.radians(angle))

    def at(a: int, b: int) -> Column:
        return F.struct((cx + (a * w * cos - b * h * sin) / 2).alias("x"), (cy + (a * w * sin + b * h * cos) / 2).alias("y"))

    return F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1))


def sections(cx: Column, cy: Column, w: Column, h: Column, angle: Column, n: Column, first_end: str = "W") -> Column:
    """n equal parts along the longer side as (cx, cy, w, h), the first at the end named."""
    along_w = w >= h
    turn = F.radians(F.when(along_w, angle).otherwise(angle + 90))
    east, south = F.cos(turn), F.sin(turn)
    away = {"W": east, "E": -east, "N": south, "S": -south}.get(first_end, east)
    sign = F.when(away < 0, -1.0).otherwise(1.0)
    step = F.greatest(w, h) / n

    def part(i: Column) -> Column:
        off = sign * step * (i - (n - 1) / 2)
        return F.struct((cx + east * off).alias("cx"), (cy + south * off).alias("cy"), F.when(along_w, step).otherwise(w).alias("w"), F.when(along_w, h).otherwise(step).alias("h"))

    return F.transform(F.sequence(F.lit(0), n - 1), part)


def bounded_rectangle(cx: Column, cy: Column, w: Column, h: Column, angle: Column, bounds: Column, res: Column) -> Column:
    """(cx, cy, w, h) of a rectangle measured by hand: `bounds` are [x low, x high, y low, y high] in metres from its field's low corner, along its axes."""
    x0, x1, y0, y1 = (F.get(bounds, F.lit(i)) / res for i in range(4))
    dx, dy = (x0 + x1) / 2 - w / 2, (y0 + y1) / 2 - h / 2
    cos, sin = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return F.struct((cx + dx * cos - dy * sin).alias("cx"), (cy + dx * sin + dy * cos).alias("cy"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def measured_sections(cx: Column, cy: Column, w: Column, h: Column, angle: Column, edges: Column, res: Column, first_end: str = "W") -> Column:
    """(cx, cy, w, h) of sections whose edges were measured: [low, high] in metres along the field's longer axis, the first at the end named."""
    along_w = w >= h
    cos, sin = F.cos(F.radians(angle)), F.sin(F.radians(angle))

    def part(edge: Column) -> Column:
        low, high = F.get(edge, F.lit(0)) / res, F.get(edge, F.lit(1)) / res
        off = (low + high) / 2 - F.greatest(w, h) / 2
        east, south = F.when(along_w, cos).otherwise(-sin), F.when(along_w, sin).otherwise(cos)
        x, y = cx + off * east, cy + off * south
        key = {"W": x, "E": -x, "N": y, "S": -y}.get(first_end, x)
        return F.struct(key.alias("key"), x.alias("cx"), y.alias("cy"), F.when(along_w, high - low).otherwise(w).alias("w"), F.when(along_w, h).otherwise(high - low).alias("h"))

    return F.transform(F.array_sort(F.transform(edges, part)), lambda s: F.struct(s["cx"].alias("cx"), s["cy"].alias("cy"), s["w"].alias("w"), s["h"].alias("h")))


def nudged(cx: Column, cy: Column, w: Column, h: Column, angle: Column, inward: dict[str, Column]) -> Column:
    """(cx, cy, w, h) after edges move inward by pixels, named by the side they face."""
    cos, sin = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    of = F.create_map(*[x for side, d in inward.items() for x in (F.lit(side), d.cast("double"))]) if inward else None

    def moved(nx: Column, ny: Column) -> Column:
        return F.coalesce(F.try_element_at(of, compass(nx, ny)), F.lit(0.0)) if inward else F.lit(0.0)

    right, left, below, above = moved(cos, sin), moved(-cos, -sin), moved(-sin, cos), moved(sin, -cos)
    x = cx - cos * (right - left) / 2 + sin * (below - above) / 2
    y = cy - sin * (right - left) / 2 - cos * (below - above) / 2
    return F.struct(x.alias("cx"), y.alias("cy"), (w - right - left).alias("w"), (h - below - above).alias("h"))


def focal(all_points: Column, play: Column, res: Column, size: Column, pad_metres: float = 12.0) -> Column:
    """(x, y) per cent that centre the played rectangle in a square crop of the padded frame; null if it does not fit."""
    least = lambda points, name: F.array_min(F.transform(points, lambda p: p[name]))
    most = lambda points, name: F.array_max(F.transform(points, lambda p: p[name]))
    pad = pad_metres / res
    low = {k: F.greatest(least(all_points, k) - pad, F.lit(0)) for k in "xy"}
    length = {k: F.least(most(all_points, k) + pad, size) - low[k] for k in "xy"}
    side = F.least(length["x"], length["y"])
    middle = centroid(play)

    def place(k: str) -> Column:
        share = (middle[k] - low[k] - side / 2) / (length[k] - side)
        return F.when(length[k] <= side, 50).otherwise(F.bround(100 * F.least(F.greatest(share, F.lit(0)), F.lit(1))).cast("int"))

    fits = F.greatest(*[most(play, k) - least(play, k) for k in "xy"]) <= side
    return F.when(fits, F.struct(place("x").alias("x"), place("y").alias("y")))


def chart_x(i: Column, n: Column) -> Column:
    """Place of the i-th (from 0) of n points."""
    return CHART["left"] + i * (CHART["width"] - CHART["left"] - CHART["right"]) / F.greatest(n - 1, F.lit(1))


def chart_y(level: Column, low: Column, high: Column) -> Column:
    """Place of a level between the lowest and highest; the middle where they are one."""
    top, bottom = CHART["top"], CHART["height"] - CHART["bottom"]
    return F.when(high > low, top + (level - low) * (bottom - top) / (high - low)).otherwise((top + bottom) / 2)


def has_label(i: Column, n: Column) -> Column:
    """Whether the i-th of n points has a label: every k-th, so that about LABELS have one."""
    return i % F.greatest(F.ceil(n / LABELS), F.lit(1)) == 0
