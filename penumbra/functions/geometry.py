"""Planar and spherical geometry as Column expressions, so that whole kernels stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_000.0
#: Half the circumference in web mercator, metres.
MERCATOR = 20037508.342789244


def distance2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance; exact for integer columns."""
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def unit(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """Direction of the chord; null for a chord of length 0."""
    length = F.sqrt(distance2(x0, y0, x1, y1))
    return F.try_divide(x1 - x0, length), F.try_divide(y1 - y0, length)


def project(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> dict[str, Column]:
    """Foot of a point on a segment: t in [0, 1], foot, distance and distance along. A segment of length 0 has t = 0."""
    len2 = distance2(x0, y0, x1, y1)
    t = F.coalesce(F.try_divide((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0), len2.cast("double")), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    fx, fy = x0 + t * (x1 - x0), y0 + t * (y1 - y0)
    return {"t": t, "foot_x": fx, "foot_y": fy, "distance": F.sqrt(distance2(px, py, fx, fy)), "along": t * F.sqrt(len2.cast("double"))}


def within_capsule(x0: Column, y0: Column, x1: Column, y1: Column, ax: Column, ay: Column, bx: Column, by: Column, r: float) -> Column:
    """The length of a segment (x0 .. y1) that lies within r of another (a, b).

    What lies within r of a segment is convex: a box and two discs, so the part is one stretch, from the first of their stretches to the last.
    """
    x0, y0, x1, y1, ax, ay, bx, by = (c.cast("double") for c in (x0, y0, x1, y1, ax, ay, bx, by))
    dx, dy, length = x1 - x0, y1 - y0, F.sqrt(distance2(x0, y0, x1, y1))
    ux, uy = unit(ax, ay, bx, by)

    def slab(at: Column, step: Column, low: Column, high: Column) -> tuple[Column, Column]:
        p, q = F.try_divide(low - at, step), F.try_divide(high - at, step)
        still = F.when((at >= low) & (at <= high), 0.0).otherwise(2.0)  # beyond the end if the slab is never met
        return F.when(step == 0, still).otherwise(F.least(p, q)), F.when(step == 0, 1.0).otherwise(F.greatest(p, q))

    def disc(cx: Column, cy: Column) -> tuple[Column, Column, Column]:
        a, b, c = dx * dx + dy * dy, (x0 - cx) * dx + (y0 - cy) * dy, distance2(x0, y0, cx, cy) - r * r
        root = F.sqrt(F.greatest(F.lit(0.0), b * b - a * c))
        return b * b >= a * c, F.try_divide(-b - root, a), F.try_divide(-b + root, a)

    along, across = slab((x0 - ax) * ux + (y0 - ay) * uy, dx * ux + dy * uy, F.lit(0.0), F.sqrt(distance2(ax, ay, bx, by))), slab((y0 - ay) * ux - (x0 - ax) * uy, dy * ux - dx * uy, F.lit(-r), F.lit(r))
    box = F.greatest(along[0], across[0]), F.least(along[1], across[1])
    parts = [(box[0] <= box[1], *box), disc(ax, ay), disc(bx, by)]
    first, last = F.least(*[F.when(ok, p) for ok, p, _ in parts]), F.greatest(*[F.when(ok, q) for ok, _, q in parts])
    share = F.when(first.isNotNull(), F.least(last, F.lit(1.0)) - F.greatest(first, F.lit(0.0)))
    return length * F.greatest(share, F.lit(0.0))


def angle(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Degrees between two vectors, the cosine clamped to [-1, 1]; null if one has length 0."""
    cos = F.try_divide((ux * vx + uy * vy).cast("double"), F.sqrt((ux * ux + uy * uy).cast("double")) * F.sqrt((vx * vx + vy * vy).cast("double")))
    return F.when(cos.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx.cast("double"), dy.cast("double"))), F.lit(360.0))


def turn(a: Column, b: Column) -> Column:
    """Difference of two bearings, folded to [0, 180]."""
    d = F.abs(a - b)
    return F.when(d > 180, 360 - d).otherwise(d)


def principal_axis(x: str, y: str) -> Column:
    """Aggregate: angle in radians of the principal axis, from the covariance matrix."""
    return 0.5 * F.atan2(2 * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere; degrees in."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon * MERCATOR / 180, F.log(F.tan((90 + lat) * math.pi / 360)) * MERCATOR / math.pi


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return x * 180 / MERCATOR, F.atan(F.exp(y * math.pi / MERCATOR)) * 360 / math.pi - 90


def pixel(x: Column, y: Column, left: float, top: float, size: float, mode: str = "floor") -> tuple[Column, Column]:
    """(row, col) of a world point. floor truncates the offset; round goes to the nearest pixel corner, half even. The two differ by half a pixel."""
    step = F.bround if mode == "round" else F.floor
    return step((top - y) / size).cast("long"), step((x - left) / size).cast("long")


def world(row: Column, col: Column, left: float, top: float, size: float) -> tuple[Column, Column]:
    """Centre of a pixel."""
    return left + (col + 0.5) * size, top - (row + 0.5) * size


def tile_index(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the web tile that holds a mercator point; rows count from the north."""
    side = 2 * MERCATOR / (1 << zoom)
    return F.floor((x + MERCATOR) / side).cast("long"), F.floor((MERCATOR - y) / side).cast("long")


def shoelace(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Aggregate over the directed edges of a ring: its area."""
    return F.abs(F.sum(x0 * y1 - x1 * y0)) / 2.0


def crosses(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a ray from the point to the right crosses the edge; odd counts over a ring mean inside."""
    return ((y0 > py) != (y1 > py)) & (px < (x1 - x0) * (py - y0) / F.nullif(y1 - y0, F.lit(0)) + x0)


def ray_hit(ox: Column, oy: Column, dx: Column, dy: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance along a unit ray to a segment, null if it misses."""
    sx, sy = x1 - x0, y1 - y0
    det = dx * sy - dy * sx
    t = F.try_divide((x0 - ox) * sy - (y0 - oy) * sx, det)
    u = F.try_divide((x0 - ox) * dy - (y0 - oy) * dx, det)
    return F.when((t >= 0) & (u >= 0) & (u <= 1), t)


def sun(hour: Column, day_of_year: Column, lat: float, lon: float, tz: float, half_step: float = 0.5) -> tuple[Column, Column]:
    """Altitude and azimuth in degrees (clockwise from north) by the short solar-position series; the time is moved back by half_step hours."""
    h = hour - half_step
    g = 2 * math.pi / 365 * (day_of_year - 1 + (h - 12) / 24)
    # fixed values: harmonic terms of the declination and of the equation of time
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    eot = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    phi = math.radians(lat)
    ha = F.radians((h * 60 + eot + 4 * lon - 60 * tz) / 4 - 180)
    clamp = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    sin_alt = math.sin(phi) * F.sin(decl) + math.cos(phi) * F.cos(decl) * F.cos(ha)
    alt = F.asin(clamp(sin_alt))
    az = F.acos(clamp((F.sin(decl) - math.sin(phi) * sin_alt) / (math.cos(phi) * F.cos(alt) + 1e-9)))
    return F.degrees(alt), F.degrees(F.when(ha > 0, 2 * math.pi - az).otherwise(az))


#: The city's transverse Mercator grid: latitude and longitude of its origin, false easting and northing, scale.
CITY_GRID = (1.366666666666667, 103.8333333333333, 28001.642, 38744.572, 1.0)


def to_grid(lon: Column, lat: Column, grid: tuple[float, float, float, float, float] = CITY_GRID) -> tuple[Column, Column]:
    """Easting and northing of a transverse Mercator grid on the WGS 84 ellipsoid, by the usual series in the longitude difference."""
    lat0, lon0, fe, fn, k0 = grid
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    c0, c2, c4, c6 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 / 8 * (e2 + e2**2 / 4 + 15 * e2**3 / 128), 15 / 256 * (e2**2 + 3 * e2**3 / 4), 35 * e2**3 / 3072
    p0 = math.radians(lat0)
    m0 = a * (c0 * p0 - c2 * math.sin(2 * p0) + c4 * math.sin(4 * p0) - c6 * math.sin(6 * p0))
    phi = F.radians(lat)
    m = a * (c0 * phi - c2 * F.sin(2 * phi) + c4 * F.sin(4 * phi) - c6 * F.sin(6 * phi))
    nu = a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    t, c = F.tan(phi) * F.tan(phi), ep2 * F.cos(phi) * F.cos(phi)
    q = F.radians(lon - lon0) * F.cos(phi)
    east = q + (1 - t + c) * q * q * q / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * q * q * q * q * q / 120
    north = m - m0 + nu * F.tan(phi) * (q * q / 2 + (5 - t + 9 * c + 4 * c * c) * q * q * q * q / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * q * q * q * q * q * q / 720)
    return fe + k0 * nu * east, fn + k0 * north


def solar_position(df: DataFrame, julian_day: str, lat: float, lon: float, terms: dict[str, list[list[tuple[float, float, float]]]], nutation: list[tuple[tuple[float, ...], float, float, float, float]], elevation: float = 0.0, pressure: float = 1013.25, celsius: float = 15.0) -> DataFrame:
    """df with alt and az in degrees, from a periodic-term theory of the earth's motion (delta T is taken as 0).

    terms: for `L`, `B` and `R` (heliocentric longitude, latitude, radius) the lists of (amplitude, phase, rate) of each power of
    millennia; nutation: (multiples of the five arguments, a, b, c, d) for the terms a + b * T in longitude and c + d * T in obliquity.
    The published tables have several hundred entries and are parameters; with their leading terms alone the result is good
    to some hundredths of a degree. Each step is a projection of its own, so that no expression is worked out twice.
    """
    c, rad = F.col, F.radians

    def series(name: str) -> Column:
        total = F.lit(0.0)
        for power, rows in enumerate(terms[name]):
            part = sum((a * F.cos(b + k * c("__jce") / 10) for a, b, k in rows), F.lit(0.0))
            for _ in range(power):
                part = part * c("__jce") / 10
            total = total + part
        return total / 1e8

    t = c("__jce")
    args = [
        297.85036 + 445267.111480 * t - 0.0019142 * t * t, 357.52772 + 35999.050340 * t - 0.0001603 * t * t, 134.96298 + 477198.867398 * t + 0.0086972 * t * t,
        93.27191 + 483202.017538 * t - 0.0036825 * t * t, 125.04452 - 1934.136261 * t + 0.0020708 * t * t,
    ]
    arg = lambda y: rad(sum((k * c(f"__x{i}") for i, k in enumerate(y) if k), F.lit(0.0)))
    phi = math.radians(lat)
    u = math.atan(0.99664719 * math.tan(phi))
    px, py = math.cos(u) + elevation / 6378140 * math.cos(phi), 0.99664719 * math.sin(u) + elevation / 6378140 * math.sin(phi)
    steps: list[dict[str, Column]] = [
        {"__jce": (c(julian_day) - 2451545) / 36525},
        {"__l": F.degrees(series("L")), "__b": -series("B"), "__r": series("R")} | {f"__x{i}": x for i, x in enumerate(args)},
        {"__psi": sum(((a + b * t) * F.sin(arg(y)) for y, a, b, _, _ in nutation), F.lit(0.0)) / 36e6, "__de": sum(((p + q * t) * F.cos(arg(y)) for y, _, _, p, q in nutation), F.lit(0.0)) / 36e6},
        {"__eps": rad((84381.448 - 46.8093 * t) / 3600 + c("__de")), "__lam": rad(F.pmod(c("__l") + 180, F.lit(360.0)) + c("__psi") - 20.4898 / (3600 * c("__r")))},
        {
            "__alpha": F.degrees(F.atan2(F.sin("__lam") * F.cos("__eps") - F.tan("__b") * F.sin("__eps"), F.cos("__lam"))),
            "__delta": F.asin(F.sin("__b") * F.cos("__eps") + F.cos("__b") * F.sin("__eps") * F.sin("__lam")),
            "__sid": 280.46061837 + 360.98564736629 * (c(julian_day) - 2451545) + 0.000387933 * t * t + c("__psi") * F.cos("__eps"), "__xi": rad(8.794 / (3600 * c("__r"))),
        },
        {"__h": rad(F.pmod(c("__sid") + lon - c("__alpha"), F.lit(360.0)))},
        {"__da": F.atan2(-px * F.sin("__xi") * F.sin("__h"), F.cos("__delta") - px * F.sin("__xi") * F.cos("__h"))},
        {"__d2": F.atan2((F.sin("__delta") - py * F.sin("__xi")) * F.cos("__da"), F.cos("__delta") - px * F.sin("__xi") * F.cos("__h")), "__h2": c("__h") - c("__da")},
        {"__e0": F.degrees(F.asin(math.sin(phi) * F.sin("__d2") + math.cos(phi) * F.cos("__d2") * F.cos("__h2")))},
        {
            "alt": c("__e0") + F.when(c("__e0") >= -0.83, pressure / 1010 * 283 / (273 + celsius) * 1.02 / (60 * F.tan(rad(c("__e0") + 10.3 / (c("__e0") + 5.11))))).otherwise(0.0),
            "az": F.pmod(F.degrees(F.atan2(F.sin("__h2"), F.cos("__h2") * math.sin(phi) - F.tan("__d2") * math.cos(phi))) + 180, F.lit(360.0)),
        },
    ]
    out = df
    for s in steps:
        out = out.withColumns(s)
    return out.drop(*[n for s in steps for n in s if n.startswith("__")])
