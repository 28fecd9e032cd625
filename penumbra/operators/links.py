"""Links that repair a network: which candidates are straight, which double back or cross a building, and which are accepted.

Rules that look at one candidate are joins over grid cells. Those that depend on what was accepted before run in rounds, with the
result of one pass over the candidates in order where a docstring says so.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.functions.geometry import distance2, within_capsule
from penumbra.operators.graph import bridge_ends, cut_lineage
from penumbra.operators.spatial import box_join, points_in_rings, radius_join

SIDES = ("x0", "y0", "x1", "y1")


def _boxes(df: DataFrame, p: str, widen: float = 0.0) -> DataFrame:
    low = lambda c: F.least(f"{c}0", f"{c}1") - widen
    high = lambda c: F.greatest(f"{c}0", f"{c}1") + widen
    return df.withColumns({f"{p}x0": low("x"), f"{p}y0": low("y"), f"{p}x1": high("x"), f"{p}y1": high("y")})


def _met(links: DataFrame, others: DataFrame, reach: float, cell: float) -> DataFrame:
    """Pairs of links and others (x0 .. y1, here named o_x0 .. o_y1) whose boxes come within reach."""
    named = _boxes(others, "r").withColumnsRenamed({c: f"o_{c}" for c in SIDES})
    return box_join(_boxes(links, "l", reach), named, cell)


def end_candidates(ends: DataFrame, reach: float, least: float = 0.5, straight: float = 120.0) -> DataFrame:
    """Pairs of ends (node, x, y, seg, ix, iy: the point before it on its segment) at least < distance <= reach.

    (a, b, seg_a, seg_b, x0 .. y1, priority, distance); priority is 0 if both lines go on into the link at straight degrees or more,
    else 1. A segment of no length at an end counts as not straight.
    """
    a = ends.select(F.col("node").alias("a"), "x", "y", F.col("seg").alias("seg_a"), F.col("ix").alias("ax"), F.col("iy").alias("ay"))
    b = ends.select(F.col("node").alias("b"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("seg").alias("seg_b"), F.col("ix").alias("bx"), F.col("iy").alias("by"))
    pairs = radius_join(a, b, reach, max(reach, 1)).filter((F.col("a") < F.col("b")) & (F.col("d2") > least * least))
    c = {k: F.col(k).cast("double") for k in ("x", "y", "nx", "ny", "ax", "ay", "bx", "by")}
    cos = F.cos(F.radians(F.lit(180.0 - straight)))

    def on(ix: Column, iy: Column, x: Column, y: Column, tx: Column, ty: Column) -> Column:
        size = F.sqrt(distance2(ix, iy, x, y)) * F.sqrt(distance2(x, y, tx, ty))
        return (size > 0) & (((x - ix) * (tx - x) + (y - iy) * (ty - y)) >= size * cos - 1e-9)

    both = on(c["ax"], c["ay"], c["x"], c["y"], c["nx"], c["ny"]) & on(c["bx"], c["by"], c["nx"], c["ny"], c["x"], c["y"])
    return pairs.select(
        "a", "b", "seg_a", "seg_b", c["x"].alias("x0"), c["y"].alias("y0"), c["nx"].alias("x1"), c["ny"].alias("y1"),
        F.when(both, 0).otherwise(1).alias("priority"), F.sqrt(F.col("d2").cast("double")).alias("distance"))


def doubling_back(links: DataFrame, segments: DataFrame, reach: float = 0.6, share: float = 0.5, cell: float = 50.0) -> DataFrame:
    """(link) of the links (link, x0 .. y1, own: segments at its ends) with more than share of their length in segments (seg, x0 .. y1) that pass within reach.

    The parts of all segments but the own add up. A link of no length doubles back on any segment that it touches.
    """
    near = _met(links.select("link", "own", *SIDES), segments.select("seg", *SIDES), reach, cell).filter(~F.coalesce(F.array_contains("own", F.col("seg")), F.lit(False)))
    inside = within_capsule(*[F.col(f"o_{c}") for c in SIDES], *[F.col(c) for c in SIDES], reach)
    length = F.sqrt(distance2(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).cast("double"))
    return near.select("link", inside.alias("inside"), length.alias("length")).groupBy("link").agg(F.sum("inside").alias("inside"), F.first("length").alias("length")).filter(F.col("inside") > share * F.col("length")).select("link")


def inside_rings(links: DataFrame, edges: DataFrame, cell: float = 50.0) -> DataFrame:
    """(link, ring, inside): the length of each link (link, x0 .. y1) inside the rings given by their edges (ring, x0 .. y1), where it is not 0."""
    met = _met(links.select("link", *SIDES), edges.select("ring", *SIDES), 0.0, cell)
    c = {k: F.col(k).cast("double") for k in (*SIDES, *(f"o_{s}" for s in SIDES))}
    ux, uy, vx, vy = c["x1"] - c["x0"], c["y1"] - c["y0"], c["o_x1"] - c["o_x0"], c["o_y1"] - c["o_y0"]
    wx, wy = c["o_x0"] - c["x0"], c["o_y0"] - c["y0"]
    cross = ux * vy - uy * vx
    t, s = F.try_divide(wx * vy - wy * vx, cross), F.try_divide(wx * uy - wy * ux, cross)
    hits = met.withColumns({"t": t, "s": s}).filter("t >= 0 and t <= 1 and s >= 0 and s < 1").groupBy("link", "ring").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    starts = points_in_rings(links.select("link", F.col("x0").alias("x"), F.col("y0").alias("y")), edges, "link").withColumn("within", F.lit(True))
    none = F.array().cast("array<double>")
    both = hits.join(starts, ["link", "ring"], "full").select("link", "ring", F.concat(F.when(F.col("within"), F.array(F.lit(0.0))).otherwise(none), F.coalesce("ts", none), F.array(F.lit(1.0))).alias("at"))
    share = F.aggregate(F.sequence(F.lit(0), F.size("at") - 1), F.lit(0.0), lambda x, i: x + F.when(i % 2 == 1, F.get("at", i) - F.get("at", i - 1)).otherwise(0.0))
    length = F.sqrt(distance2(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).cast("double"))
    return both.withColumn("share", share).join(links.select("link", *SIDES), "link").select("link", "ring", (F.col("share") * length).alias("inside")).filter("inside > 0")


def crossing(links: DataFrame, edges: DataFrame, passable: DataFrame | None = None, most: float = 0.5, cell: float = 50.0) -> DataFrame:
    """(link) of the links with more than most of their length inside one ring that is not in passable (ring)."""
    inside = inside_rings(links, edges, cell).filter(F.col("inside") > most)
    if passable is not None:
        inside = inside.join(passable.select("ring").distinct(), "ring", "left_anti")
    return inside.select("link").distinct()


def first_clear(candidates: DataFrame, apart: float, rank: tuple[str, ...], taken: DataFrame | None = None) -> DataFrame:
    """Of each id the first candidate (id, link, x1, y1: where it lands) by rank and link that lands at least apart from every one accepted before.

    Equal to one pass over the ids in ascending order. taken (x1, y1): landings that stand before the first. The ids are taken in ranges that
    double, and those of a range without what landings before it block. In each round the candidates of a range are dealt to tiles, by where
    the first of their id lands, and each tile makes the pass over its ids as far as no undecided id can change it; the tiles of the next
    round lie elsewhere, and are fewer, as the candidates are. Across tiles landings are compared, not candidates. Ids whose candidates are
    all blocked, and null ids, are left out.
    """
    size, close = max(apart, 1), F.col("d2") < apart * apart
    all_of = candidates.filter("id is not null and x1 is not null and y1 is not null")
    spots = cut_lineage(all_of.select("x1", "y1").distinct())
    other = spots.select(F.struct("x1", "y1").alias("beside"), F.col("x1").alias("nx"), F.col("y1").alias("ny"))
    spot = lambda d: d.select(F.struct("x1", "y1").alias("spot"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    beside = cut_lineage(radius_join(spot(spots), other, apart, size).filter(close).select("spot", "beside"))
    blocked = None
    if taken is not None:
        blocked = cut_lineage(radius_join(spot(spots), taken.select(F.col("x1").alias("nx"), F.col("y1").alias("ny")), apart, size).filter(close).select("spot").distinct())
    every = all_of.withColumn("spot", F.struct("x1", "y1"))
    blocks = lambda chosen: beside.join(chosen.select("spot").distinct(), "spot").select(F.col("beside").alias("spot")).distinct()
    accepted, low = None, None
    for high in [*_doubling(all_of), None]:
        live = every if low is None else every.filter(F.col("id") > low)
        live = live if high is None else live.filter(F.col("id") <= high)
        low = high
        live = live if blocked is None else live.join(blocked, "spot", "left_anti")
        live = cut_lineage(live.withColumn("__order", F.row_number().over(Window.partitionBy("id").orderBy(*rank, "link"))))
        turn, taken_now = 0, None
        while n := live.count():
            chosen = cut_lineage(live.join(_passed(_dealt(live, beside, n, turn), apart), ["id", "link"], "left_semi"))
            taken_now = chosen if taken_now is None else taken_now.unionByName(chosen)
            live, turn = cut_lineage(live.join(chosen.select("id"), "id", "left_anti").join(blocks(chosen), "spot", "left_anti")), turn + 1
        if taken_now is not None:
            accepted = taken_now if accepted is None else accepted.unionByName(taken_now)
            blocked = cut_lineage(blocks(taken_now) if blocked is None else blocked.unionByName(blocks(taken_now)).distinct())
    return candidates.limit(0) if accepted is None else accepted.select(*candidates.columns)


#: Candidates for each tile of a round of first_clear, where they lie evenly.
TILE_ROWS = 100_000


def _dealt(live: DataFrame, beside: DataFrame, n: int, turn: int) -> DataFrame:
    """The n candidates with __tile, one for all of an id, and __other: the least id of another tile with a candidate beside the spot."""
    sides = math.ceil(math.sqrt(math.ceil(n / TILE_ROWS)))
    if sides == 1:
        return live.withColumn("__tile", F.lit("")).withColumn("__other", F.lit(None).cast(dict(live.dtypes)["id"]))
    low_x, high_x, low_y, high_y = live.agg(F.min("x1"), F.max("x1"), F.min("y1"), F.max("y1")).first()

    def strip(c: str, low: float, high: float, shift: float) -> Column:
        side = (float(high) - float(low)) / sides
        return F.floor((F.col(c).cast("double") - float(low)) / side + turn * shift % 1).cast("string") if 0 < side < math.inf else F.lit("")

    home = live.groupBy("id").agg(F.min(F.struct("__order", "x1", "y1")).alias("m")).select("id", "m.x1", "m.y1")
    home = home.select("id", F.concat_ws(" ", strip("x1", low_x, high_x, 0.618), strip("y1", low_y, high_y, 0.755)).alias("__tile"))
    tiled = cut_lineage(live.join(home, "id"))
    least = tiled.groupBy(F.col("spot").alias("beside"), F.col("__tile").alias("__from")).agg(F.min("id").alias("__other"))
    reach = beside.join(least, "beside").groupBy("spot", "__from").agg(F.min("__other").alias("__other"))
    asked = tiled.select("spot", "__tile").distinct().join(reach, "spot").filter("__from <> __tile")
    return tiled.join(asked.groupBy("spot", "__tile").agg(F.min("__other").alias("__other")), ["spot", "__tile"], "left")


def _passed(dealt: DataFrame, apart: float) -> DataFrame:
    """(id, link) accepted by a pass over the ids of each tile.

    An id whose first candidate that isn't blocked may yet be blocked, by a lesser id of another tile or one of its own that is undecided, stays
    undecided itself, and so do later ids beside any of its candidates. The least id of all is always decided.
    """
    size, kinds = max(apart, 1), dict(dealt.dtypes)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("__order", "ascending")])
        ids, links, others, xs, ys = (t.column(c).to_pylist() for c in ("id", "link", "__other", "x1", "y1"))
        number: dict = {}
        spots = [number.setdefault(p, len(number)) for p in zip(xs, ys)]
        at, cells = list(number), {}
        cell = lambda p: (math.floor(p[0] / size), math.floor(p[1] / size)) if math.isfinite(p[0]) and math.isfinite(p[1]) else None
        for i, p in enumerate(at):
            cells.setdefault(cell(p), []).append(i)

        def spread(i: int, marks: bytearray) -> None:
            x, y = at[i]
            if c := cell(at[i]):
                for cx in (c[0] - 1, c[0], c[0] + 1):
                    for cy in (c[1] - 1, c[1], c[1] + 1):
                        for j in cells.get((cx, cy), ()):
                            if (x - at[j][0]) * (x - at[j][0]) + (y - at[j][1]) * (y - at[j][1]) < apart * apart:
                                marks[j] = 1

        shut, open_, done, k = bytearray(len(at)), bytearray(len(at)), bytearray(len(at)), 0  # open_: an undecided id may land beside; done: spread there
        out: list = []
        while k < len(ids):
            begin, me = k, ids[k]
            while k < len(ids) and ids[k] == me:
                k += 1
            free = [j for j in range(begin, k) if not shut[spots[j]]]
            if not free:
                continue
            j = free[0]
            if not open_[spots[j]] and (others[j] is None or others[j] >= me):
                out.append(j)
                spread(spots[j], shut)
            else:
                for j in free:
                    if not done[spots[j]]:
                        done[spots[j]] = 1
                        spread(spots[j], open_)
        return pa.table({c: t.column(c).take(pa.array(out, pa.int64())) for c in ("id", "link")})

    return dealt.select("id", "link", F.col("x1").cast("double").alias("x1"), F.col("y1").cast("double").alias("y1"), "__order", "__tile", "__other").groupBy("__tile").applyInArrow(run, f"id {kinds['id']}, link {kinds['link']}")


#: Candidates up to which first_clear takes all ids as one range.
RANGE_ROWS = 400_000


def _doubling(candidates: DataFrame) -> list:
    """Ids that end ranges of about RANGE_ROWS candidates, twice and four times as many, and so on; none if there are fewer."""
    n = candidates.count()
    parts, at = [], RANGE_ROWS
    while at < n:
        parts.append(at / n)
        at = at * 2 + RANGE_ROWS
    return sorted(set(candidates.agg(F.percentile_approx("id", parts).alias("q")).first()["q"])) if parts else []


def closure(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Links ends (a) to nodes (b): across components first, then within them for the ends that none of those begins at.

    candidates: link, a, b, priority, distance, of which what is rejected has been left out. The links across components are the
    minimum forest (bridge_ends); every other end takes its nearest candidate, so that each end with a candidate has a link.
    """
    across = bridge_ends(candidates, edges)
    rest = candidates.join(across.select("a").distinct(), "a", "left_anti")
    best = rest.groupBy("a").agg(F.min(F.struct("distance", "link")).alias("best")).select("best.link")
    return across.withColumn("across", F.lit(True)).unionByName(rest.join(best, "link", "left_semi").withColumn("across", F.lit(False)))
