"""Distance joins over integer grid cells: an equi-join on the cell, then the exact predicate.

The side given as `near` is copied to the cells round its own, so every pair within the radius meets in one cell, once.
The reach must not exceed the cell, which is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.operators.graph import cut_lineage
from penumbra.functions.geometry import crosses, distance2, project, ray_hit


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def radius_join(left: DataFrame, near: DataFrame, radius: float | Column, cell: float) -> DataFrame:
    """Pairs of left (x, y, ...) and near (nx, ny, ...) within the radius, and d2. Coordinates that are null match nothing.

    radius may be a column of left whose values are at most cell.
    """
    if not isinstance(radius, Column) and radius > cell:
        raise ValueError("the radius must not exceed the cell")
    offsets = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = (
        near.withColumn("__dx", F.explode(offsets)).withColumn("__dy", F.explode(offsets))
        .withColumn("__cx", _cell(F.col("nx"), cell) + F.col("__dx")).withColumn("__cy", _cell(F.col("ny"), cell) + F.col("__dy")).drop("__dx", "__dy")
    )
    own = left.withColumn("__cx", _cell(F.col("x"), cell)).withColumn("__cy", _cell(F.col("y"), cell))
    r = radius if isinstance(radius, Column) else F.lit(radius)
    return (
        own.join(spread, ["__cx", "__cy"]).withColumn("d2", distance2(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")))
        .filter((F.col("d2") <= r * r) & (r <= cell)).drop("__cx", "__cy")
    )


def nearest(left: DataFrame, near: DataFrame, key: str, near_key: str, cap: float) -> DataFrame:
    """Of each left row the nearest of near within cap; ties go to the least near_key. Rows without any are left out.

    Rows at one place are compared once, for near by its least key.
    """
    least = near.groupBy("nx", "ny").agg(F.min(F.struct(near_key)).alias("k")).select("nx", "ny", f"k.{near_key}")
    place = radius_join(left.select("x", "y").distinct(), least, cap, cap).groupBy("x", "y").agg(F.min(F.struct("d2", near_key)).alias("best"))
    best = left.select(key, "x", "y").join(place, ["x", "y"]).groupBy(key).agg(F.min("best").alias("best"))
    return best.select(key, F.col(f"best.{near_key}").alias(near_key), F.col("best.d2").alias("d2"))


def nearest_of_all(left: DataFrame, near: DataFrame, key: str, near_key: str, first: float) -> DataFrame:
    """Of each left row the nearest of near, however far; ties go to the least near_key. Rows without coordinates are left out.

    The reach begins at first and grows fourfold for the rows that have found none, so near is never compared with all rows.
    """
    rest = cut_lineage(left.filter("abs(x) < 1e15 and abs(y) < 1e15"))
    near = cut_lineage(near.filter("abs(nx) < 1e15 and abs(ny) < 1e15"))
    if near.isEmpty():
        return nearest(rest, near, key, near_key, first)
    parts, reach = [], first
    while not rest.isEmpty():
        parts.append(cut_lineage(nearest(rest, near, key, near_key, reach)))
        rest, reach = cut_lineage(rest.join(parts[-1], key, "left_anti")), reach * 4
    out = parts[0] if parts else nearest(rest, near, key, near_key, first)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nearest_or(left: DataFrame, matched: DataFrame, near: DataFrame, key: str, near_key: str, cap: float) -> DataFrame:
    """matched (key, near_key), and for the left rows that it lacks the nearest within cap."""
    return matched.select(key, near_key).unionByName(nearest(left.join(matched, key, "left_anti"), near, key, near_key, cap).select(key, near_key))


def self_pairs(points: DataFrame, key: str, radius: float) -> DataFrame:
    """Pairs (a, b), a < b, of points (key, x, y) within the radius of each other."""
    other = points.select(F.col(key).alias("b"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return radius_join(points.select(F.col(key).alias("a"), "x", "y"), other, radius, max(radius, 1)).filter("a < b").select("a", "b", "d2")


def point_segment_join(points: DataFrame, segments: DataFrame, reach: float, more_than: float = 0.0) -> DataFrame:
    """points (id, px, py) with segments (seg, x0, y0, x1, y1): more_than < distance <= reach, with the foot.

    Segments are dealt to every cell their box, widened by the reach, touches; a pair meets in the point's own cell, once.
    """
    size = F.lit(float(max(reach * 4, 1)))
    box = lambda a, b, f, d: _cell(f(F.col(a), F.col(b)) + d, size)
    dealt = segments.withColumn("__cx", F.explode(F.sequence(box("x0", "x1", F.least, -reach), box("x0", "x1", F.greatest, reach)))).withColumn(
        "__cy", F.explode(F.sequence(box("y0", "y1", F.least, -reach), box("y0", "y1", F.greatest, reach))))
    own = points.withColumn("__cx", _cell(F.col("px"), size)).withColumn("__cy", _cell(F.col("py"), size))
    foot = project(*[F.col(c) for c in ("px", "py", "x0", "y0", "x1", "y1")])
    return own.join(dealt, ["__cx", "__cy"]).withColumns(foot).filter((F.col("distance") <= reach) & (F.col("distance") > more_than)).drop("__cx", "__cy")


def points_in_rings(points: DataFrame, edges: DataFrame, key: str, cell: float = 500.0) -> DataFrame:
    """(key, ring) for points (key, x, y) inside rings given by their edges (ring, x0, y0, x1, y1); even-odd rule.

    A ring's box is dealt to the cells that it covers, so a point meets only rings whose box touches its own cell.
    """
    boxes = edges.groupBy("ring").agg(F.min(F.least("x0", "x1")).alias("bx0"), F.max(F.greatest("x0", "x1")).alias("bx1"), F.min(F.least("y0", "y1")).alias("by0"), F.max(F.greatest("y0", "y1")).alias("by1"))
    span = lambda a, b: F.explode(F.sequence(_cell(F.col(a), cell), _cell(F.col(b), cell)))
    dealt = boxes.withColumn("__cx", span("bx0", "bx1")).withColumn("__cy", span("by0", "by1"))
    own = points.withColumn("__cx", _cell(F.col("x"), cell)).withColumn("__cy", _cell(F.col("y"), cell))
    inside_box = F.col("x").between(F.col("bx0"), F.col("bx1")) & F.col("y").between(F.col("by0"), F.col("by1"))
    held = own.join(dealt, ["__cx", "__cy"]).filter(inside_box).select(key, "x", "y", "ring")
    hit = held.join(edges, "ring").filter(crosses(*[F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")]))
    return hit.groupBy(key, "ring").count().filter("count % 2 = 1").select(key, "ring")


def first_hit(rays: DataFrame, segments: DataFrame, low: float, high: float) -> DataFrame:
    """Of each ray (ray, ox, oy, dx, dy: a unit vector) the nearest segment (seg, x0 .. y1) between low and high; ties to the least seg.

    Rays are dealt to the cells of their box as segments are; the minimum drops pairs that meet twice.
    """
    size = F.lit(float(high))
    span = lambda a, b: F.sequence(_cell(F.least(a, b), size), _cell(F.greatest(a, b), size))
    r = rays.withColumn("__cx", F.explode(span(F.col("ox"), F.col("ox") + F.col("dx") * high))).withColumn("__cy", F.explode(span(F.col("oy"), F.col("oy") + F.col("dy") * high)))
    s = segments.withColumn("__cx", F.explode(span(F.col("x0"), F.col("x1")))).withColumn("__cy", F.explode(span(F.col("y0"), F.col("y1"))))
    t = ray_hit(*[F.col(c) for c in ("ox", "oy", "dx", "dy", "x0", "y0", "x1", "y1")])
    hit = r.join(s, ["__cx", "__cy"]).withColumn("t", t).filter(F.col("t").between(low, high))
    return hit.groupBy("ray").agg(F.min(F.struct("t", "seg")).alias("h")).select("ray", F.col("h.seg").alias("seg"), F.col("h.t").alias("t"))


def range_join(left: DataFrame, right: DataFrame, at: str, start: str, end: str, bucket: int) -> DataFrame:
    """left.at between right.start and right.end (integers, inclusive), by equal buckets of the axis."""
    dealt = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return left.withColumn("__b", F.floor(F.col(at) / bucket)).join(dealt, "__b").filter(F.col(at).between(F.col(start), F.col(end))).drop("__b")


def box_join(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes (lx0, ly0, lx1, ly1) and (rx0, ry0, rx1, ry1) that touch: met in each common cell, kept in the first."""
    def dealt(df: DataFrame, p: str) -> DataFrame:
        span = lambda a, b: F.sequence(_cell(F.col(a), cell), _cell(F.col(b), cell))
        return df.withColumn("__cx", F.explode(span(f"{p}x0", f"{p}x1"))).withColumn("__cy", F.explode(span(f"{p}y0", f"{p}y1")))

    first = (F.col("__cx") == _cell(F.greatest("lx0", "rx0"), cell)) & (F.col("__cy") == _cell(F.greatest("ly0", "ry0"), cell))
    touch = (F.col("lx0") <= F.col("rx1")) & (F.col("rx0") <= F.col("lx1")) & (F.col("ly0") <= F.col("ry1")) & (F.col("ry0") <= F.col("ly1"))
    return dealt(left, "l").join(dealt(right, "r"), ["__cx", "__cy"]).filter(touch & first).drop("__cx", "__cy")
