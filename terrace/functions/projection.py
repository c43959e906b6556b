"""Map coordinates both ways: an oblique conic projection on one ellipsoid, and the shift to the ellipsoid that maps use.

All are Column expressions on doubles. Angles are degrees at the edges and radians within. The inverse finds latitudes by a
fixed point, in a lambda over a short sequence, so the expression does not grow with its rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The national grid's ellipsoid, projection and shift, and the ellipsoid of world maps.
SEMI_MAJOR, FLATTENING = 6377397.155, 1 / 299.1528128
CENTRE_LATITUDE, ORIGIN_LONGITUDE, CONE_AZIMUTH, PARALLEL, SCALE = 49.5, 24 + 50 / 60, 30.28813975277778, 78.5, 0.9999
SHIFT = (570.8, 85.7, 462.8, 4.998, 1.587, 5.261, 3.56)
WORLD_SEMI_MAJOR, WORLD_FLATTENING = 6378137.0, 1 / 298.257223563
ROUNDS = 8

_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)
_C = math.radians(CENTRE_LATITUDE)
_P = math.radians(PARALLEL)
_Z = math.radians(CONE_AZIMUTH)
_A = SEMI_MAJOR * math.sqrt(1 - _E2) / (1 - _E2 * math.sin(_C) ** 2)
_B = math.sqrt(1 + _E2 * math.cos(_C) ** 4 / (1 - _E2))
_N = math.sin(_P)
_R0 = SCALE * _A / math.tan(_P)
_Q = math.pi / 4
_T0 = math.tan(_Q + math.asin(math.sin(_C) / _B) / 2) * ((1 + _E * math.sin(_C)) / (1 - _E * math.sin(_C))) ** (_E * _B / 2) / math.tan(_Q + _C / 2) ** _B


def _stretch(latitude: Column, power: float) -> Column:
    return F.pow((1 + _E * F.sin(latitude)) / (1 - _E * F.sin(latitude)), F.lit(power))


def project(longitude: Column, latitude: Column) -> tuple[Column, Column]:
    """East and north, both negative, of degrees on the grid's own ellipsoid."""
    phi, v = F.radians(latitude), _B * F.radians(F.lit(ORIGIN_LONGITUDE) - longitude)
    u = 2 * (F.atan(_T0 * F.pow(F.tan(phi / 2 + _Q), F.lit(_B)) / _stretch(phi, _E * _B / 2)) - _Q)
    t = F.asin(math.cos(_Z) * F.sin(u) + math.sin(_Z) * F.cos(u) * F.cos(v))
    theta = _N * F.asin(F.cos(u) * F.sin(v) / F.cos(t))
    r = _R0 * math.tan(_Q + _P / 2) ** _N / F.pow(F.tan(t / 2 + _Q), F.lit(_N))
    return -r * F.sin(theta), -r * F.cos(theta)


def unproject(east: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees on the grid's own ellipsoid."""
    r, theta = F.sqrt(east * east + north * north), F.atan(east / north)
    d = theta / _N
    t = 2 * (F.atan(F.pow(F.lit(_R0) / r, F.lit(1 / _N)) * math.tan(_Q + _P / 2)) - _Q)
    u = F.asin(math.cos(_Z) * F.sin(t) - math.sin(_Z) * F.cos(t) * F.cos(d))
    v = F.asin(F.cos(t) * F.sin(d) / F.cos(u))
    # The pair (fixed part, latitude so far), so that the fixed part is computed once.
    base = _T0 ** (-1 / _B) * F.pow(F.tan(u / 2 + _Q), F.lit(1 / _B))
    start = F.struct(base.alias("base"), u.alias("phi"))
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    phi = F.aggregate(rounds, start, lambda s, _: F.struct(s["base"].alias("base"), (2 * (F.atan(s["base"] * _stretch(s["phi"], _E / 2)) - _Q)).alias("phi")), lambda s: s["phi"])
    return F.lit(ORIGIN_LONGITUDE) - F.degrees(v / _B), F.degrees(phi)


def _geocentric(longitude: Column, latitude: Column, a: float, f: float) -> tuple[Column, Column, Column]:
    e2 = f * (2 - f)
    lam, phi = F.radians(longitude), F.radians(latitude)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), F.lit(2.0)))
    return n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * (1 - e2) * F.sin(phi)


def _geodetic(x: Column, y: Column, z: Column, a: float, f: float) -> tuple[Column, Column]:
    e2, b = f * (2 - f), a * (1 - f)
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * a, p * b)
    phi = F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(t), F.lit(3.0)), p - e2 * a * F.pow(F.cos(t), F.lit(3.0)))
    return F.degrees(F.atan2(y, x)), F.degrees(phi)


def _shifted(longitude: Column, latitude: Column, forward: bool) -> tuple[Column, Column]:
    """Degrees on the other ellipsoid, at its surface: a shift, a small turn and a scale of geocentric coordinates."""
    own, other = (SEMI_MAJOR, FLATTENING), (WORLD_SEMI_MAJOR, WORLD_FLATTENING)
    if not forward:
        own, other = other, own
    x, y, z = _geocentric(longitude, latitude, *own)
    dx, dy, dz = SHIFT[:3]
    rx, ry, rz = (math.radians(s / 3600) for s in SHIFT[3:6])
    m = 1 + SHIFT[6] * 1e-6
    if forward:
        moved = (dx + m * (x - rz * y + ry * z), dy + m * (rz * x + y - rx * z), dz + m * (-ry * x + rx * y + z))
    else:
        # The inverse of the turn itself, so that both ways cancel to rounding.
        x, y, z = (x - dx) / m, (y - dy) / m, (z - dz) / m
        k = 1 + rx * rx + ry * ry + rz * rz
        moved = (((1 + rx * rx) * x + (rx * ry + rz) * y + (rx * rz - ry) * z) / k, ((rx * ry - rz) * x + (1 + ry * ry) * y + (ry * rz + rx) * z) / k, ((rx * rz + ry) * x + (ry * rz - rx) * y + (1 + rz * rz) * z) / k)
    return _geodetic(*moved, *other)


def to_world(east: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude on world maps of a place on the grid."""
    return _shifted(*unproject(east, north), True)


def from_world(longitude: Column, latitude: Column) -> tuple[Column, Column]:
    """East and north on the grid of a place on world maps."""
    return project(*_shifted(longitude, latitude, False))


def pixel_to_world(px: Column, py: Column, x0: Column, y1: Column, resolution: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a pixel of an image whose upper left corner is (x0, y1)."""
    return to_world(x0 + px * resolution, y1 - py * resolution)
