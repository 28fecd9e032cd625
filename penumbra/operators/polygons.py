"""Polygon constructions that columns can't express, as array functions over rings (array<struct<x, y>>); no ring meets another."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Points = np.ndarray
RING = "array<struct<x:double,y:double>>"


def ring_area(p: Points) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p.T
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2)


def hull(p: Points) -> Points:
    """Convex hull, counter-clockwise."""
    pts = sorted(set(map(tuple, p.tolist())))
    if len(pts) < 3:
        return np.array(pts, float).reshape(-1, 2)

    def half(points: list) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def smallest_rectangle(p: Points) -> tuple[float, float, float]:
    """Long side, short side and axis (degrees in [0, 180)) of the smallest rotated rectangle round the points: a side lies on a hull edge."""
    h = hull(p)
    if len(h) < 2:
        return 0.0, 0.0, 0.0
    edges = np.roll(h, -1, 0) - h
    best = None
    for angle in np.arctan2(edges[:, 1], edges[:, 0]):
        c, s = np.cos(angle), np.sin(angle)
        a, b = np.ptp(h[:, 0] * c + h[:, 1] * s), np.ptp(h[:, 1] * c - h[:, 0] * s)
        if best is None or a * b < best[0] - 1e-12:
            best = (a * b, a, b, np.degrees(angle if a >= b else angle + np.pi / 2) % 180)
    return float(max(best[1:3])), float(min(best[1:3])), float(best[3])


def clip(subject: Points, window: Points) -> Points:
    """The part of a ring inside a convex ring."""
    w = hull(window)
    out = [tuple(q) for q in subject]
    for k in range(len(w)):
        (ax, ay), (bx, by) = w[k], w[(k + 1) % len(w)]
        side = lambda q: (bx - ax) * (q[1] - ay) - (by - ay) * (q[0] - ax)  # noqa: B023, E731
        ring, out = out, []
        for i, q in enumerate(ring):
            r = ring[i - 1]
            s, t = side(q), side(r)
            if (s >= 0) != (t >= 0):
                f = t / (t - s)
                out.append((r[0] + f * (q[0] - r[0]), r[1] + f * (q[1] - r[1])))
            if s >= 0:
                out.append(q)
    return np.array(out, float).reshape(-1, 2)


def inset(p: Points, d: float) -> Points:
    """A ring moved inwards by d, corners mitred; empty where nothing is left."""
    if ring_area(p) == 0:
        return p[:0]
    x, y = p.T
    if np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y) < 0:
        p = p[::-1]
    e = np.roll(p, -1, 0) - p
    n = np.stack([-e[:, 1], e[:, 0]], 1) / np.maximum(np.hypot(*e.T), 1e-12)[:, None]
    a, b = np.roll(n, 1, 0), n
    moved = p + d * (a + b) / np.maximum(1 + (a * b).sum(1), 0.25)[:, None]
    turned = ((np.roll(moved, -1, 0) - moved) * e).sum(1) <= 0
    return moved[:0] if turned.any() or ring_area(moved) >= ring_area(p) else moved


def _map(df: DataFrame, key: str, rings: list[str], fn: Callable, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            out = [fn(*[np.array([(q["x"], q["y"]) for q in r or []], float).reshape(-1, 2) for r in row]) for row in zip(*cols[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([float(o[i]) for o in out], pa.float64()) for i in range(len(names)))], names=[key, *names])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, *rings).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))


def rectangles(df: DataFrame, key: str, ring: str) -> DataFrame:
    """key, long, short, axis, aspect of each ring's smallest rotated rectangle."""
    return _map(df, key, [ring], smallest_rectangle, ["long", "short", "axis"]).withColumn("aspect", F.try_divide("long", "short"))


def overlays(df: DataFrame, key: str, subject: str, window: str) -> DataFrame:
    """key, area of the intersection with a convex window, and of the difference."""
    def areas(a: Points, b: Points) -> tuple[float, float]:
        both = ring_area(clip(a, b)) if len(a) > 2 and len(b) > 2 else 0.0
        return both, ring_area(a) - both

    return _map(df, key, [subject, window], areas, ["inside", "outside"])


def insets(df: DataFrame, key: str, ring: str, d: float) -> DataFrame:
    return _map(df, key, [ring], lambda p: (ring_area(p), ring_area(inset(p, d))), ["area", "inner"])


def covered_share(samples: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """(line, share): the share of a line's sample points (line, id, px, py) within reach of a segment; stands for buffer overlays."""
    from penumbra.operators.spatial import point_segment_join

    places, lines = samples.select("px", "py").distinct(), segments.select("x0", "y0", "x1", "y1").distinct()
    near = point_segment_join(places, lines, reach, -1.0).select("px", "py").distinct()
    hit = samples.join(near, ["px", "py"]).select("line", "id").distinct().withColumn("hit", F.lit(1))
    return samples.select("line", "id").join(hit, ["line", "id"], "left").groupBy("line").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))


def duplicate_lines(lines: DataFrame, others: DataFrame, band: float = 4, share: float = 0.8, cos: float = 0.8660254, samples: int = 10) -> DataFrame:
    """Lines (line, x0 .. y1) of which more than share lies within band of one parallel other segment (seg, x0 .. y1)."""
    from penumbra.operators.spatial import point_segment_join

    k = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k")
    f = (F.col("k") + 0.5) / samples
    at = lines.select("*", k).select("line", "k", (F.col("x1") - F.col("x0")).alias("ux"), (F.col("y1") - F.col("y0")).alias("uy"), (F.col("x0") + f * (F.col("x1") - F.col("x0"))).alias("px"), (F.col("y0") + f * (F.col("y1") - F.col("y0"))).alias("py"))
    near = point_segment_join(at, others, band, -1.0)
    vx, vy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    along = F.abs(F.try_divide(F.col("ux") * vx + F.col("uy") * vy, F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2) * F.sqrt(vx * vx + vy * vy)))
    return near.filter(along >= cos).groupBy("line", "seg").agg(F.count_distinct("k").alias("n")).filter(F.col("n") > share * samples).select("line").distinct()
