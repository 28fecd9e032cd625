"""Network repair against brute force: stretches near a line or in a ring, links in one pass, and whole queries."""

import math
import random

import pytest

from pyspark.sql import functions as F

from penumbra.functions import geometry as G
from penumbra.operators import links as L
from penumbra.plans.base import Tables
from penumbra.plans.registry import queries

SIDES = ("x0", "y0", "x1", "y1")


def apart(px, py, x0, y0, x1, y1):
    n = (x1 - x0) ** 2 + (y1 - y0) ** 2
    t = max(0.0, min(1.0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / n)) if n else 0.0
    return math.hypot(px - x0 - t * (x1 - x0), py - y0 - t * (y1 - y0))


def stretch(line, near, n=2000):
    """The length of a line where near(x, y) holds, by samples."""
    x0, y0, x1, y1 = line
    hits = sum(near(x0 + (k + 0.5) / n * (x1 - x0), y0 + (k + 0.5) / n * (y1 - y0)) for k in range(n))
    return math.hypot(x1 - x0, y1 - y0) * hits / n


def in_ring(x, y, ring):
    edges = list(zip(ring, ring[1:] + ring[:1], strict=True))
    return sum((b[1] > y) != (a[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges) % 2 == 1


def some_lines(g, n, size, reach):
    out = []
    for k in range(n):
        x, y = g.uniform(0, size), g.uniform(0, size)
        out.append((k, x, y, x + g.uniform(-reach, reach), y + g.uniform(-reach, reach)))
    return out


def test_stretch_within_reach_of_a_segment(spark):
    g = random.Random(3)
    pairs = [tuple(float(g.randrange(8)) for _ in range(8)) for _ in range(150)] + [(0.0, 0.0, 5.0, 0.0, 1.0, 0.0, 3.0, 0.0), (0.0, 0.0, 5.0, 0.0, 2.0, 0.5, 2.0, 0.5), (0.0, 3.0, 5.0, 3.0, 1.0, 0.0, 3.0, 0.0), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 1.0)]
    names = [*SIDES, "ax", "ay", "bx", "by"]
    df = spark.createDataFrame(pairs, names)
    for r in df.withColumn("got", G.within_capsule(*[F.col(c) for c in names], 1.25)).collect():
        p = tuple(r)
        assert abs(r.got - stretch(p[:4], lambda x, y: apart(x, y, *p[4:8]) <= 1.25)) < 0.02, p  # noqa: B023


def test_links_that_double_back(spark):
    g = random.Random(4)
    lines, segs = some_lines(g, 80, 60, 6), some_lines(g, 120, 60, 15)
    links = spark.createDataFrame([(k, *p, [k]) for k, *p in lines], "link long, x0 double, y0 double, x1 double, y1 double, own array<long>")
    got = {r.link for r in L.doubling_back(links, spark.createDataFrame(segs, ["seg", *SIDES]), 0.8, 0.4, 10).collect()}
    want, unsure = set(), set()
    for k, *p in lines:
        length = math.hypot(p[2] - p[0], p[3] - p[1])
        inside = sum(stretch(s, lambda x, y: apart(x, y, *p) <= 0.8) for i, *s in segs if i != k)  # noqa: B023
        if abs(inside - 0.4 * length) < 0.05:
            unsure.add(k)
        elif inside > 0.4 * length:
            want.add(k)
    assert want and len(want) < 80 and got - unsure == want


def test_length_of_links_in_rings(spark):
    g = random.Random(5)
    rings = {1: [(5, 5), (40, 8), (30, 30), (22, 12), (10, 35)], 2: [(50, 50), (70, 50), (70, 70), (50, 70)]}
    edges = spark.createDataFrame([(r, *map(float, (*p[k], *p[(k + 1) % len(p)]))) for r, p in rings.items() for k in range(len(p))], ["ring", *SIDES])
    lines = some_lines(g, 120, 70, 30) + [(900, 55.0, 55.0, 60.0, 60.0), (901, 80.0, 10.0, 90.0, 10.0)]
    got = {(r.link, r.ring): r.inside for r in L.inside_rings(spark.createDataFrame(lines, ["link", *SIDES]), edges, 12).collect()}
    for k, *p in lines:
        for r, ring in rings.items():
            assert abs(got.get((k, r), 0.0) - stretch(p, lambda x, y: in_ring(x, y, ring))) < 0.1  # noqa: B023
    links = spark.createDataFrame(lines, ["link", *SIDES])
    shut = {r.link for r in L.crossing(links, edges, None, 0.5, 12).collect()}
    open_ = {r.link for r in L.crossing(links, edges, spark.createDataFrame([(1,)], "ring long"), 0.5, 12).collect()}
    assert shut == {k for (k, _), n in got.items() if n > 0.5} and open_ == {k for (k, r), n in got.items() if r == 2 and n > 0.5}


def one_pass(cands, near, taken=()):
    """(id, link) accepted by one pass over the ids; cands: (id, link, x1, y1, rank)."""
    landed, out = list(taken), set()
    for i in sorted({c[0] for c in cands}):
        for _, link, x, y, _ in sorted((c for c in cands if c[0] == i), key=lambda c: (c[4], c[1])):
            if all((x - a) ** 2 + (y - b) ** 2 >= near * near for a, b in landed):
                landed.append((x, y))
                out.add((i, link))
                break
    return out


def test_first_clear_equals_one_pass(spark):
    g = random.Random(6)
    cands = [(i, 10 * i + k, g.uniform(0, 40), g.uniform(0, 40), g.randrange(3)) for i in range(60) for k in range(g.randrange(1, 5))]
    taken = [(5.0, 5.0), (30.0, 20.0)]
    df = spark.createDataFrame(cands, "id long, link long, x1 double, y1 double, rank long")
    for old in ([], taken):
        got = L.first_clear(df, 4, ("rank",), spark.createDataFrame(old, "x1 double, y1 double") if old else None)
        assert {(r.id, r.link) for r in got.collect()} == one_pass(cands, 4, old)
    assert L.first_clear(df.limit(0), 4, ("rank",)).count() == 0


def placed(spark, sf_dir):
    out = {}
    for r in Tables(spark, sf_dir).lattice().collect():
        (x0, y0), (x1, y1) = [(n % 40 * 40 + n * 7 % 10, n // 40 * 40 + n * 3 % 10) for n in (r.u, r.v)]
        if r.edge_id * 7919 % 101 >= 50:
            out[r.edge_id] = (r.u, 10**12 + r.edge_id, float(x0), float(y0), float((3 * x1 + x0) // 4), float((3 * y1 + y0) // 4))
        else:
            out[r.edge_id] = (r.u, r.v, float(x0), float(y0), float(x1), float(y1))
    return out


def test_bridged_ends_equal_one_pass(spark, sf_dir):
    edges = placed(spark, sf_dir)
    owner: dict = {}
    for e, (u, v, x0, y0, x1, y1) in edges.items():
        owner.setdefault(u, []).append((e, x0, y0, x1, y1))
        owner.setdefault(v, []).append((e, x1, y1, x0, y0))
    ends = {n: o[0] for n, o in owner.items() if len(o) == 1}
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v, *_ in edges.values():
        root[find(u)] = find(v)

    def turn(ix, iy, x, y, tx, ty):
        return math.degrees(math.acos(max(-1.0, min(1.0, ((x - ix) * (tx - x) + (y - iy) * (ty - y)) / math.hypot(x - ix, y - iy) / math.hypot(tx - x, ty - y)))))

    cands = []
    for a, (ea, ax, ay, aix, aiy) in ends.items():
        for b, (eb, bx, by, bix, biy) in ends.items():
            if a < b and 5 < math.hypot(ax - bx, ay - by) <= 50:
                bent = max(turn(aix, aiy, ax, ay, bx, by), turn(bix, biy, bx, by, ax, ay))
                line = (ax, ay, bx, by)
                inside = sum(stretch(e[2:], lambda x, y: apart(x, y, *line) <= 6, 400) for k, e in edges.items() if k not in (ea, eb) and min(apart(*e[2:4], *line), apart(*e[4:6], *line)) < 60)  # noqa: B023
                assert abs(inside - 0.5 * math.hypot(ax - bx, ay - by)) > 0.3
                if inside <= 0.5 * math.hypot(ax - bx, ay - by):
                    cands.append((int(bent > 60), math.hypot(ax - bx, ay - by), a, b))
    want = set()
    for priority, _, a, b in sorted(cands, key=lambda c: (c[0], c[1], ends[c[2]][0], ends[c[3]][0])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, priority))
    assert want and {(r.a, r.b, r.priority) for r in queries()["n19_end_bridging"](spark, sf_dir).collect()} == want


def test_every_end_with_a_candidate_is_closed(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (6, 7)], "u long, v long")
    cands = [(1, 1, 4, 0, 2.0), (2, 1, 3, 0, 1.0), (3, 3, 1, 0, 1.0), (4, 5, 6, 0, 3.0), (5, 7, 6, 0, 0.5), (6, 3, 2, 0, 1.5)]
    out = {(r.link, r.across) for r in L.closure(spark.createDataFrame(cands, "link long, a long, b long, priority int, distance double"), edges).collect()}
    assert out == {(1, True), (4, True), (3, False), (5, False)}


def test_feet_that_are_clear(spark, sf_dir):
    """The queries of J17 and J18: ranks and rejections by brute force over the candidates."""
    from penumbra.plans import joins as J

    t = Tables(spark, sf_dir)
    segs = {r.seg: tuple(map(float, (r.x0, r.y0, r.x1, r.y1))) for r in J.segments(t).collect()}
    rings = {r: p for r, p in J.RINGS}
    through = lambda p: {r for r, ring in rings.items() if stretch(p, lambda x, y: in_ring(x, y, ring)) > 0.5}  # noqa: E731, B023
    best: dict = {}
    for r in J._feet_links(t, 60, 60).collect():
        if not through((r.x0, r.y0, r.x1, r.y1)) - {2}:
            best.setdefault(r.id, []).append((r.id % 3 == r.seg % 3, r.d, r.seg))
    assert best and {(r.id, r.seg) for r in queries()["j17_clear_of_rings"](spark, sf_dir).collect()} == {(k, min(v)[2]) for k, v in best.items()}
    cands = []
    for r in J._feet_links(t, 60, 100).collect():
        line = (r.x0, r.y0, r.x1, r.y1)
        back = sum(stretch(s, lambda x, y: apart(x, y, *line) <= 2) for k, s in segs.items() if k != r.seg) > 0.5 * math.hypot(line[2] - line[0], line[3] - line[1])  # noqa: B023
        if not back and not through(line) and not any(in_ring(r.x1, r.y1, ring) for ring in rings.values()):
            cands.append((r.id, r.link, r.x1, r.y1, (r.slant, r.d)))
    want = {(i, link - i * 1_000_000_000) for i, link in one_pass(cands, 8)}
    assert want and {(r.id, r.seg) for r in queries()["j18_clear_feet"](spark, sf_dir).collect()} == want


def test_first_clear_compares_landings_not_candidates(spark, monkeypatch):
    """90 ids on three spots, in ranges of three candidates and more: the join sees spots, and the result is that of one pass."""
    spots = [(0.0, 0.0), (3.0, 0.0), (20.0, 0.0)]
    data = [(k, k * 10 + j, *spots[j], (k + j) % 3) for k in range(90) for j in range(3)]
    df = spark.createDataFrame(data, "id long, link long, x1 double, y1 double, rank int")
    seen, was = [], L.radius_join
    monkeypatch.setattr(L, "radius_join", lambda a, b, *more: seen.append(max(a.count(), b.count())) or was(a, b, *more))
    monkeypatch.setattr(L, "RANGE_ROWS", 3)
    want, stand = [], []
    for k in range(90):
        for _, link, x, y, _ in sorted((r for r in data if r[0] == k), key=lambda r: (r[4], r[1])):
            if all((x - a) ** 2 + (y - b) ** 2 >= 16 for a, b in stand):
                want.append((k, link))
                stand.append((x, y))
                break
    assert sorted((r.id, r.link) for r in L.first_clear(df, 4, ("rank",)).collect()) == want and max(seen) == 3


@pytest.mark.parametrize("rows", [20, 100_000])
def test_first_clear_passes_over_a_chain_in_few_rounds(spark, monkeypatch, rows):
    """200 ids, each beside the next, took as many rounds as the chain is long; in one tile and in tiles of about 20 candidates the result is that of one pass."""
    g = random.Random(3)
    cands = [(k, k * 10, k * 3.0, 0.0, 0) for k in range(200)] + [(k, k * 10 + j, g.uniform(0, 600), g.uniform(0, 60), j) for k in range(200) for j in (1, 2)]
    df = spark.createDataFrame([*cands, (None, 7, 1.0, 1.0, 0), (900, 9000, None, 1.0, 0), (901, 9010, float("nan"), 1.0, 0)], "id long, link long, x1 double, y1 double, rank int")
    cuts, was = [], L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda d: cuts.append(1) or was(d))
    monkeypatch.setattr(L, "TILE_ROWS", rows, raising=False)
    got = [(r.id, r.link) for r in L.first_clear(df, 4, ("rank",)).collect()]
    assert len(got) == len(set(got)) and set(got) == one_pass(cands, 4) | {(901, 9010)}
    assert len(cuts) < (60 if rows == 20 else 10)
