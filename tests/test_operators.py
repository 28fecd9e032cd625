"""Small literal cases: the quirks of each operator, and independence of row order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from penumbra.functions import geometry as G
from penumbra.functions import scalars as X
from penumbra.functions import thermal as T
from penumbra.operators import demand as D
from penumbra.operators import evaluate as E
from penumbra.operators import graph as N
from penumbra.operators import islands as I
from penumbra.operators import raster as R
from penumbra.operators import routing as P
from penumbra.operators import spatial as S
from penumbra.sources import readers, writers


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_interval_union_merges_touching(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 10, 12), (1, 11, 15)], "k int, a int, b int")
    assert rows(I.covered_length(df, ["k"], "a", "b")) == [(1, 13)]


def test_rolling_max_is_clamped(spark):
    df = spark.createDataFrame([(1, h, float(h == 23)) for h in range(24)], "k int, hour int, v double")
    out = dict(df.withColumn("m", I.rolling_max(df, ["k"], "hour", "v")).select("hour", "m").collect())
    assert out[22] == out[23] == 1.0 and out[0] == 0.0


def test_step_schedule_rounds_minutes_up(spark):
    df = spark.createDataFrame([(1, 540, 0.1), (1, 1050, 0.9), (1, 1440, 0.2)], "k int, until int, v double")
    out = [r[2] for r in rows(I.step_hours(df, ["k"], "until", "v"), "hour")]
    assert out == [0.1] * 9 + [0.9] * 9 + [0.2] * 6


def test_parallel_edges_keep_the_earlier_and_flow_goes_to_all(spark):
    e = spark.createDataFrame([(1, 1, 2, 5), (2, 2, 1, 5), (3, 3, 3, 1)], "edge_id long, u long, v long, length long")
    assert [r.edge_id for r in N.reduce_parallel(e).collect()] == [1]
    flow = spark.createDataFrame([(1, 2, 7.0)], "a long, b long, flow double")
    assert sorted((r.edge_id, r.flow) for r in D.to_all_parallel(e, flow).collect()) == [(1, 7.0), (2, 7.0), (3, 0.0)]


def test_own_node_counts_in_the_sum_but_carries_nothing(spark):
    df = spark.createDataFrame([(1, 10.0, 0.0, 100.0), (1, 10.0, 350.0, 100.0)], "s int, w double, d double, r double")
    after = D.huff(df, "s", "w", "d", "r", least=20, stage="after").collect()
    before = D.huff(df, "s", "w", "d", "r", least=20, stage="before").collect()
    assert after[0].vol < 30 and before[0].vol == pytest.approx(100)


def test_tau_takes_the_first_that_fits(spark):
    paths = spark.createDataFrame([(1, 9, 0, 130), (1, 9, 1, 121), (1, 9, 2, 110)], "src long, node long, param long, len long")
    short = spark.createDataFrame([(1, 9, 100)], "src long, node long, len long")
    assert rows(P.within_detour(paths, short, 120, 1)) == [(1, 9, 1, 121, 100)]
    assert rows(P.within_detour(paths, short, 101, 0)) == [(1, 9, None, 100, 100)]


def test_endpoint_chain_becomes_one_node(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.4, 0.0), (3, 0.8, 0.0), (4, 5.0, 0.0)], "id long, x double, y double")
    out = {r.id: (r.node, round(r.node_x, 6)) for r in N.cluster_endpoints(df, 0.5).collect()}
    assert out == {1: (1, 0.4), 2: (1, 0.4), 3: (1, 0.4), 4: (4, 5.0)}


def test_interchange_shares_and_real_exits(spark):
    df = spark.createDataFrame([("A1/B2/C3", 90.0)], "code string, v double")
    assert sorted(rows(D.split_interchange(df, "code", "v"))) == [("A1", 30.0), ("B2", 30.0), ("C3", 30.0)]
    exits = spark.createDataFrame([("A", 0.0, 0.0, 90.0), ("A", 0.01, 0.0, 90.0), ("A", 5.0, 0.0, 90.0), ("B", 5.0, 0.0, 10.0)], "code string, x double, y double, volume double")
    out = {r.kx: (r.inj, r.codes) for r in D.real_exits(exits).collect()}
    assert out == {0: (45.0, "A"), 100: (55.0, "A+B")}


def test_equal_f1_takes_the_first_threshold(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 0)], "score double, truth int")
    sweep = E.threshold_sweep(df, "score", F.col("truth") == 1, [0.2, 0.5, 0.8])
    assert rows(E.best_threshold(sweep)) == [(0.2, 1.0)]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(F.bround("x").cast("int")).collect()] == [0, 2, 2]
    assert [r[0] for r in df.select(X.snap(F.col("x") * 0.05)).collect()] == [0, 2, 2]


def category(b, v, s, a, strip, foot, night=False):
    """Written out by hand for the test."""
    if night:
        return 0
    if foot:
        return 12
    if a:
        c = 11 if v and s else 10 if s else 9 if v else 8
    else:
        c = {(0, 0, 0): 0, (1, 0, 0): 1, (0, 1, 0): 2, (1, 1, 0): 3, (0, 0, 1): 4, (1, 0, 1): 5, (0, 1, 1): 6, (1, 1, 1): 7}[b, v, s]
    return {1: 8, 3: 9, 5: 10, 7: 11}.get(c, c) if strip else {8: 1, 9: 3, 10: 5, 11: 7}.get(c, c)


def test_category_rules_over_all_flags(spark):
    df = spark.range(64).withColumnRenamed("id", "f")
    flags = {k: F.col("f").bitwiseAND(1 << i) != 0 for i, k in enumerate(("building", "vegetation", "linkway", "arcade", "strip", "footprint"))}
    flags |= {"tree_building": flags["building"] & flags["vegetation"], "linkway_building": flags["building"] & flags["linkway"]}
    day, night = (df.select("f", R.category(flags, F.lit(a)).alias("c")).collect() for a in (30, 0))
    assert all(r.c == category(*[r.f >> i & 1 for i in range(6)]) for r in day)
    assert all(r.c == 0 for r in night)


def random_graph(seed):
    g = random.Random(seed)
    edges = [(k, g.randrange(25), g.randrange(25), g.randrange(1, 9)) for k in range(60)]
    return [(k, u, v, 0, c, c, c % 3) for k, u, v, c in edges if u != v]


def dijkstra(edges, start, cutoff):
    best = {start: 0}
    while True:
        new = dict(best)
        for _, u, v, _, c, _, _ in edges:
            for a, b in ((u, v), (v, u)):
                if a in new and new[a] + c <= cutoff and new[a] + c < new.get(b, 1 << 60):
                    new[b] = new[a] + c
        if new == best:
            return best
        best = new


@pytest.mark.parametrize("seed", [1, 2])
def test_relational_and_array_routing_agree_with_brute_force(spark, seed):
    edges = random_graph(seed)
    e = spark.createDataFrame(edges, "edge_id long, u long, v long, param long, cost long, length long, shade long")
    s = spark.createDataFrame([(k, 0, k, 15) for k in range(4)] + [(9, 0, None, 15)], "src long, param long, start long, cutoff long")
    a, b = (sorted(map(str, rows(f(s, e.repartition(n))))) for f, n in ((P.relax, 3), (P.route, 1)))
    assert a == b
    got = {(r.src, r.node): r.cost for r in P.relax(s, e).collect()}
    assert got == {(k, n): c for k in range(4) for n, c in dijkstra(edges, k, 15).items()}


def test_flow_up_the_trees_equals_paths(spark):
    e = spark.createDataFrame(random_graph(3), "edge_id long, u long, v long, param long, cost long, length long, shade long")
    s = spark.createDataFrame([(0, 0, 0, 30), (1, 0, 1, 30)], "src long, param long, start long, cutoff long")
    trees = P.route(s, e).cache()
    vol = trees.select("src", "param", "node", (F.col("node") + 1.0).alias("volume"))
    flow = {(r.src, r.edge): r.flow for r in P.push_up(trees, vol).collect() if r.flow}
    assert flow == {(r.src, r.edge): r.flow for r in P.push_up_trees(trees, vol).collect() if r.flow}
    walk = P.paths(trees, trees.select("src", "param", "node"))
    want = walk.groupBy("src", "edge").agg(F.sum(F.col("target") + 1.0).alias("f"))
    assert flow == {(r.src, r.edge): r.f for r in want.collect()}


def test_components_of_chains_and_loops(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    out = {r.node: r.root for r in N.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert N.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bridging_is_the_minimum_forest(spark):
    links = spark.createDataFrame([(1, 1, 2, 0, 5.0), (2, 2, 3, 0, 1.0), (3, 1, 3, 0, 2.0), (4, 1, 2, 1, 0.1)], "link long, a long, b long, priority int, distance double")
    edges = spark.createDataFrame([(9, 8)], "u long, v long")
    assert sorted(r.link for r in N.bridge_ends(links, edges).collect()) == [2, 3]


def test_spurs_go_until_none_is_left(spark):
    e = spark.createDataFrame([(1, 1, 2, 1), (2, 2, 3, 1), (3, 3, 4, 9), (4, 4, 5, 9), (5, 5, 3, 9)], "edge_id long, u long, v long, length long")
    assert sorted(r.edge_id for r in N.prune_spurs(e, 3).collect()) == [3, 4, 5]


def test_streets_join_through_nodes_of_degree_two(spark):
    e = spark.createDataFrame([(1, 1, 2, 1), (2, 2, 3, 1), (3, 3, 4, 1), (4, 3, 5, 1)], "edge_id long, u long, v long, length long")
    out = {r.edge_id: r.street for r in N.contract_streets(e, spark.createDataFrame([], "node long")).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4}


def test_radius_larger_than_the_cell_is_refused(spark):
    df = spark.createDataFrame([(1, 0, 0)], "id long, x long, y long")
    with pytest.raises(ValueError):
        S.radius_join(df, df.select(F.col("x").alias("nx"), F.col("y").alias("ny")), 5, 4)


def test_projection_of_a_point_segment(spark):
    p = G.project(F.lit(3), F.lit(4), F.lit(1), F.lit(1), F.lit(1), F.lit(1))
    assert spark.range(1).select(p["t"], p["distance"]).first() == (0.0, 13 ** 0.5)


def test_relational_and_tiled_shadow_agree(spark):
    g = random.Random(5)
    z = spark.createDataFrame([(r, c, float(g.randrange(12))) for r in range(20) for c in range(17)], "row long, col long, z double")
    a, b = (sorted(rows(x)) for x in (R.shadow(z, -1, 1, 1.0, 4), R.tile_shadow(z, 8, -1, 1, 1.0, 4)))
    assert a == b and any(x[2] for x in a)


def test_not_in_lets_null_pass(spark):
    from penumbra.plans.rows import walkable

    df = spark.createDataFrame([("footway", None, None, None, None), ("footway", "no", None, None, None), (None, None, None, None, None)], "highway string, foot string, access string, service string, expressway string")
    assert walkable(df).count() == 1


def test_utci_masks_missing_input(spark):
    df = spark.createDataFrame([(20.0, 50.0, 30.0, 1.0), (-999.0, 50.0, 30.0, 1.0)], "c double, rh double, r double, w double")
    out = [x[0] for x in df.select(T.utci(*[F.col(k) for k in ("c", "rh", "r", "w")], [(0, 0, 0, 0, 0.5)])).collect()]
    assert out == [20.5, -999.0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5)], "k long, v double")
    path = str(tmp_path / "t")
    writers.resume(df.filter("k = 1"), path, ["k"], lambda d: d)
    writers.resume(df, path, ["k"], lambda d: d)
    assert sorted(rows(spark.read.parquet(path))) == [(1, 0.5), (2, 1.5)]
    with pytest.raises(Exception, match="exist"):
        writers.write_table(df, path)
    writers.write_table(df, path, replace=True)
    writers.write_csv(df, str(tmp_path / "c"))
    read = readers.csv_text(spark, str(tmp_path / "c"), ["K"], ["V"])
    assert sorted(rows(read)) == [("1", 0.5), ("2", 1.5)]
    assert sorted(rows(readers.csv_union(spark, [str(tmp_path / "c")], "k string, v double"))) == [("1", 0.5), ("2", 1.5)]


def test_sources_refuse_what_is_missing(spark):
    with pytest.raises(ValueError):
        readers.open_source(spark, "forecast", path="x")
    with pytest.raises(ValueError):
        readers.open_source(spark, "other")
    with pytest.raises(Exception, match="too few"):
        readers.met_rows(spark.createDataFrame([("1 2 3",)], "value string")).collect()


def test_one_to_one_join_fails_on_repeats(spark):
    from penumbra.plans.joins import one_to_one

    left, right = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert one_to_one(left, right, "id").count() == 2
    with pytest.raises(Exception, match="repeats"):
        one_to_one(left, right.union(right), "id").collect()
    with pytest.raises(Exception, match="match"):
        one_to_one(left, right.filter("id = 1"), "id").collect()


def test_sink_stream_appends_once(spark, sf_dir, tmp_path):
    from penumbra.streaming import events as V

    for _ in range(2):
        V.upsert_sink(V.read_events(spark, sf_dir), str(tmp_path / "out"), ["event_id"], str(tmp_path / "cp")).awaitTermination()
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == n


def test_stateful_timer_equals_islands(spark, sf_dir):
    from penumbra.plans.registry import queries

    q = queries()
    a = sorted(r.held for r in q["x06_threshold_timer"](spark, sf_dir).collect())
    b = sorted(r.held for r in q["w17_threshold_timer"](spark, sf_dir).collect())
    assert a == b


def test_pyramid_and_patches(spark):
    for option, n in ((1, 145), (2, 153), (3, 305), (4, 609)):
        assert R.sky_patches(spark, option).count() == n


def test_polygon_constructions():
    import numpy as np

    from penumbra.operators import polygons as Q

    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    assert Q.ring_area(Q.clip(square, square + 2)) == pytest.approx(4)
    assert Q.ring_area(Q.inset(square[::-1], 1)) == pytest.approx(4) and len(Q.inset(square, 2.5)) == 0
    turn = np.array([[0.6, -0.8], [0.8, 0.6]])
    long, short, axis = Q.smallest_rectangle(np.array([(0, 0), (10, 0), (10, 3), (0, 3)], float) @ turn.T)
    assert (long, short) == pytest.approx((10, 3)) and axis == pytest.approx(np.degrees(np.arctan2(0.8, 0.6)))


def test_skeleton_sky_and_walls():
    import numpy as np

    from penumbra.operators import tiles as K

    bar = np.zeros((20, 40), bool)
    bar[7:12, 4:36] = True
    thin = K.skeleton(bar)
    assert 20 < thin.sum() < 40 and (thin <= bar).all()
    assert K.centre_scores(bar, bar) == (1.0, 1.0) and K.centre_scores(bar, ~bar & False)[0] == 0.0
    flat = K.sky_view(np.zeros((5, 5)), 1, 4)
    assert np.allclose(flat["all"], 1)
    pit = np.full((9, 9), 50.0)
    pit[4, 4] = 0
    assert K.sky_view(pit, 1, 4)["all"][4, 4] < 0.2
    dem = np.zeros((20, 20))
    dem[:, 10:] = 9  # a wall that faces west
    walls = np.zeros_like(dem)
    walls[2:18, 9] = 9
    assert abs(np.nanmedian(K.wall_aspects(walls, dem)) - 270) < 20


def test_duplicate_lines_and_region_growing(spark):
    from penumbra.operators import polygons as Q
    from penumbra.operators import tiles as K

    lines = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 0.0), (2, 0.0, 100.0, 0.0, 150.0)], "line long, x0 double, y0 double, x1 double, y1 double")
    other = spark.createDataFrame([(9, -5.0, 2.0, 60.0, 3.0), (8, -20.0, 125.0, 20.0, 125.0)], "seg long, x0 double, y0 double, x1 double, y1 double")
    assert [r.line for r in Q.duplicate_lines(lines, other).collect()] == [1]
    px = spark.createDataFrame([(0, c, 10.0 if c < 4 else 90.0, 0.0, 0.0, 7 if c == 0 else None) for c in range(8)], "row long, col long, l double, a double, b double, label long")
    assert sorted(r.col for r in K.grow_regions(px, 14, 10).collect()) == [0, 1, 2, 3]
    assert sorted(r.col for r in K.grow_regions(px, 14, 2).collect()) == [0, 1, 2]


def test_city_grid_origin_and_sun(spark):
    from penumbra.plans.shapes import NUTATION, SUN_TERMS

    x, y = G.to_grid(F.lit(103.8333333333333), F.lit(1.366666666666667))
    assert spark.range(1).select(x, y).first() == pytest.approx((28001.642, 38744.572), abs=1e-6)
    df = spark.createDataFrame([(2460370.5 + 5.5 / 24,)], "jd double")  # 2024-03-01 05:30 UTC, 13:30 local
    got = G.solar_position(df, "jd", 1.35, 103.8, SUN_TERMS, NUTATION).first()
    short = spark.range(1).select(*G.sun(F.lit(14.0), F.lit(61.0), 1.35, 103.8, 8)).first()
    assert got.alt == pytest.approx(short[0], abs=0.4) and got.az == pytest.approx(short[1], abs=3)


def test_adaptive_coolest_keeps_to_the_cap(spark):
    e = spark.createDataFrame([(1, 0, 1, 10, 0), (2, 1, 2, 10, 0), (3, 0, 3, 11, 90), (4, 3, 2, 11, 90), (5, 0, 4, 40, 100), (6, 4, 2, 40, 100)], "edge_id long, u long, v long, length long, shade_pct long")
    pairs = spark.createDataFrame([(1, 0, 2), (2, 0, 99)], "pair long, start long, target long")
    out = P.coolest_within(pairs, e, tau=1.2, slack=0.0).collect()
    assert [(r.pair, r.len, r.short_len) for r in out] == [(1, 22.0, 20.0)] and 0 <= out[0].lam < 1
    assert P.coolest_within(pairs, e, tau=9.0).first().len == 80.0


def _orders(spark, path, n):
    """A folder whose orders have the keys 1 to n, some missing."""
    rows = [(k, k * 7 % 50) for k in range(1, n + 1) if k % 11]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{path}/orders.parquet")
    return [k for k, _ in rows]


def test_sky_view_and_region_growing_cover_the_whole_raster(spark, tmp_path):
    import numpy as np

    from penumbra.operators import tiles
    from penumbra.plans.registry import queries

    keys = _orders(spark, tmp_path, 4600)  # rows 0 to 46
    dem = np.full((47 + 16, 100 + 16), -np.inf)
    for k in keys:
        dem[8 + k // 100, 8 + k % 100] = k * 17 % 23 - 2
    want = tiles.sky_view(dem, 1, 8)["all"]
    got = {(r.row, r.col): r.svf for r in queries()["r19_sky_view"](spark, str(tmp_path)).collect()}
    assert set(got) == {(k // 100, k % 100) for k in keys}
    assert all(abs(v - want[8 + r, 8 + c]) < 1e-4 for (r, c), v in got.items())

    colour = {(k // 100, k % 100): np.array([k * 29 % 101 / 3, k * 31 % 13, k * 17 % 23 - 2]) for k in keys}
    grown = {(k // 100, k % 100): k for k in keys if k % 97 == 0}
    seeds, fresh = {k: colour[p] for p, k in grown.items()}, dict(grown)
    for _ in range(10):
        new: dict = {}
        for (r, c), k in fresh.items():
            for p in ((r, c + 1), (r + 1, c), (r, c - 1), (r - 1, c)):
                if p in colour and p not in grown and ((colour[p] - seeds[k]) ** 2).sum() < 196:
                    new[p] = min(k, new.get(p, k))
        grown, fresh = grown | new, new
    assert {(r.row, r.col): r.label for r in queries()["r13_region_growing"](spark, str(tmp_path)).collect()} == grown
    assert max(r for r, _ in grown) > 40


def test_adaptive_coolest_takes_every_supplier(spark, tmp_path):
    from penumbra.plans.registry import queries

    spark.range(1, 401).toDF("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(30, 60).toDF("s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.pair: r for r in queries()["n13_adaptive_coolest"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(30, 60)) and all(r.len <= 1.2 * r.short_len + 1.01 for r in got.values())


def test_timer_sorts_a_key_across_batches_of_rows(spark, tmp_path):
    """One key whose shuffled rows span many Arrow batches."""
    import random

    from penumbra.streaming import events as E

    g = random.Random(1)
    rows = [(1, k, float(g.randrange(100))) for k in range(25_000)]
    shuffled = g.sample(rows, len(rows))
    spark.createDataFrame(shuffled, "user_id long, s long, value double").selectExpr("user_id", "timestamp_seconds(s) as ts", "value").coalesce(1).write.parquet(str(tmp_path / "e" / "events.parquet"))
    got = {r.at_s: r.held for r in E.run_to_end(E.over_threshold(E.read_events(spark, str(tmp_path / "e")), "user_id", "ts", "value", 50)).collect()}
    since = None
    for _, s, v in rows:
        since = None if v <= 50 else s if since is None else since
        assert got[s] == (0 if since is None else s - since)


def test_image_names(spark):
    from penumbra.sources import readers

    names = ["12_103.85_-1.29_202403_baseheading10.5_viewheading-80.25_3.jpg", "12_103.85_1.29_2024-03_10_3.jpg", "x.JPG", "notes.txt", None]
    parsed, skipped = readers.view_names(spark.createDataFrame([(n,) for n in names], "name string"))
    assert [tuple(r)[1:] for r in parsed.collect()] == [(12, 103.85, -1.29, "202403", 10.5, -80.25, 3)]
    assert skipped.first()[0] == 2


def test_one_graph_serves_every_param(spark, monkeypatch):
    """A cost that grows with the param gives the trees of a graph for each param; so does the relational form."""
    edges = random_graph(4)
    params = [0, 1, 7]
    each = spark.createDataFrame([(k, u, v, p, c + p * n, n, d) for k, u, v, _, c, n, d in edges for p in params], "edge_id long, u long, v long, param long, cost long, length long, shade long")
    one = spark.createDataFrame([(k, u, v, c, n, n, d) for k, u, v, _, c, n, d in edges], "edge_id long, u long, v long, cost long, slope long, length long, shade long")
    s = spark.createDataFrame([(k, p, k, 15 * (1 + p)) for k in range(3) for p in params] + [(8, 0, 777, 9), (9, 0, None, 15)], "src long, param long, start long, cutoff long")
    want = sorted(map(str, rows(P.route(s, each))))
    assert sorted(map(str, rows(P.route(s, one)))) == want and sorted(map(str, rows(P.relax(s, one)))) == want
    assert sum(r.src == 8 for r in P.route(s, one).collect()) == 1
    monkeypatch.setattr(P, "TREE_ROWS", 1)
    assert sorted(map(str, rows(P.route(s, one)))) == want
    assert P.route(s, one.limit(0)).count() == P.route(s, each.limit(0)).count() == len(params) * 3 + 1


def test_reach_gives_the_costs_of_relax(spark, monkeypatch):
    """Graphs of one slope and of their own, starts that are null, unknown or shared, and costs beyond 32 bits."""
    edges = random_graph(5)
    params = [0, 1, 7]
    for by in (1, 10**11):
        each = spark.createDataFrame([(k, u, v, p, (c + p * n) * by, n, d) for k, u, v, _, c, n, d in edges for p in params], "edge_id long, u long, v long, param long, cost long, length long, shade long")
        one = spark.createDataFrame([(k, u, v, c * by, n * by, n, d) for k, u, v, _, c, n, d in edges], "edge_id long, u long, v long, cost long, slope long, length long, shade long")
        s = spark.createDataFrame([(k, p, k % 3, 15 * (1 + p) * by) for k in range(5) for p in params] + [(8, 0, 777, 9), (9, 0, None, 15)], "src long, param long, start long, cutoff long")
        want = rows(P.relax(s, one).select("src", "param", "node", "cost"), "src", "param", "node")
        assert [rows(P.reach(s, e), "src", "param", "node") for e in (one, each)] == [want, want]
        sums: dict = {}
        for src, param, _, cost in want:
            n, c, r = sums.get((src, param), (0, 0, 0))
            sums[src, param] = n + 1, c + cost, r + cost % 10
        totals = sorted((*k, *v) for k, v in sums.items())
        assert rows(P.reach_totals(s, one, 10), "src", "param") == totals
        assert rows(P.reach(s, one.limit(0)), "src", "param") == [(k, p, k % 3, 0) for k in range(5) for p in params] + [(8, 0, 777, 0)]
        with monkeypatch.context() as m:
            m.setattr(P, "BROADCAST_EDGES", 0)
            assert rows(P.reach(s, one), "src", "param", "node") == want and rows(P.reach_totals(s, one, 10), "src", "param") == totals


def test_first_detours_equal_the_choice_over_all_trees(spark, monkeypatch):
    edges = random_graph(7)
    e = spark.createDataFrame([(k, u, v, (c % 4) * 1000 + c, c * 1000, c, d) for k, u, v, _, c, _, d in edges], "edge_id long, u long, v long, cost long, slope long, length long, shade long")
    plain = e.withColumn("cost", F.col("length")).withColumn("slope", F.lit(0))
    params = [0, 1, 5]
    s = spark.createDataFrame([(k, k, 9 + k) for k in range(6)] + [(8, 777, 9)], "src long, start long, cutoff long")
    own = spark.createDataFrame([(k, p, k, (9 + k) * (1 + p) * 250 + 999) for k in range(6) for p in params] + [(8, p, 777, 9) for p in params], "src long, param long, start long, cutoff long")
    want = rows(P.within_detour(P.relax(own, e), P.relax(s.withColumn("param", F.lit(0)), plain), 110, 0), "src", "node")
    asked = s.join(own.groupBy("src").agg(F.collect_list(F.struct("param", "cutoff")).alias("searches")), "src")
    assert {r[2] for r in want} > {0, None}
    assert rows(P.first_detours(asked, e, 110, 0, 1000), "src", "node") == want
    monkeypatch.setattr(P, "BROADCAST_EDGES", 0)
    assert rows(P.first_detours(asked, e, 110, 0, 1000), "src", "node") == want


def test_the_sweeps_make_no_rows_of_trees(spark, sf_dir, monkeypatch):
    """Totals and choices are made beside the searches, costs alone where only they are asked."""
    from penumbra.plans.registry import queries

    monkeypatch.setattr(P, "route", None)
    for name in ("n08_coolest", "n11_lambda_sweep", "n11_lambda_grid", "n12_tau_choice", "d11_sensitivity"):
        assert queries()[name](spark, sf_dir).columns
    monkeypatch.setattr(P, "reach", None)
    for name in ("n11_lambda_grid", "n12_tau_choice", "d11_sensitivity"):
        assert queries()[name](spark, sf_dir).columns


def test_a_graph_of_sixty_times_the_lattice_is_searched_from_arrays():
    """2,398,800 edges; 26 bytes an arc at these ranges, where six longs are 48."""
    import numpy as np
    import pyarrow as pa

    assert P.BROADCAST_EDGES >= 60 * 39_980
    m = 100_000
    k = np.arange(m)
    g = P.compressed(pa.table({"u": k, "v": k + 1, "edge_id": k * 20, "cost": k % 811 * 100 * 100_000, "slope": k % 811 * 100_000, "length": k % 811, "shade": k % 811 * 100}))
    assert sum(x.nbytes for x in g[2:]) <= 26 * 2 * m and [int(x) for x in g[3][:4]] == [0, 20, 0, 40]


def test_adaptive_coolest_holds_sixty_times_the_lattice(spark, monkeypatch):
    """The relational form is not taken at that size, and an arc takes 20 bytes there (two doubles and its target)."""
    import numpy as np
    import pyarrow as pa

    k = np.arange(100_000)
    assert sum(x.nbytes for x in P.compressed(pa.table({"u": k, "v": k + 1, "length": k * 1.0, "shade_pct": k * 1.0}))[2:]) == 20 * 2 * len(k)

    class Many:
        sparkSession = spark
        count = staticmethod(lambda: 60 * 39_980)
        select = staticmethod(lambda *c: spark.createDataFrame([(0, 1, 5.0, 0.0)], "u long, v long, length double, shade_pct double"))

    monkeypatch.setattr(P, "_coolest_by_relax", None)
    assert P.coolest_within(spark.createDataFrame([(1, 0, 1)], "pair long, start long, target long"), Many()).first().len == 5.0


def test_adaptive_coolest_broadcasts_few_bytes_an_edge(spark, monkeypatch):
    """An edge of a lattice with lengths and shares at random takes under 6 bytes of broadcast, where two arcs of 20 bytes were laid on every disk."""
    import pickle

    sc, sizes = spark.sparkContext, []
    monkeypatch.setattr(sc, "broadcast", lambda value, f=sc.broadcast: sizes.append(len(pickle.dumps(value))) or f(value))
    g = random.Random(3)
    ends = [(k, k + step) for k in range(4000) for step in (1, 40) if step == 40 or k % 40 < 39]
    e = spark.createDataFrame([(k, u, v, g.randrange(200, 1011), g.randrange(101)) for k, (u, v) in enumerate(ends)], "edge_id long, u long, v long, length long, shade_pct long")
    assert P.coolest_within(spark.createDataFrame([(1, 5, 128)], "pair long, start long, target long"), e).count() == 1
    assert len(sizes) == 1 and sizes[0] < 6 * len(ends)


def test_a_packed_graph_is_the_compressed_one():
    import numpy as np
    import pyarrow as pa

    g = np.random.default_rng(5)
    for ids, n, lengths in ((9, 40, g.integers(0, 9, 40) * 1.0), (10**15, 30, g.random(30) * 1e5), (3, 50, np.full(50, 1e300)), (5, 0, np.zeros(0))):
        u, v = (g.integers(-ids, ids, n) for _ in range(2))
        t = pa.table({"u": u, "v": v, "length": lengths, "shade_pct": g.integers(0, 101, n) * 1.0})
        want, got = P.compressed(t), P.unpacked(P.packed(t))
        assert all((a == b).all() and a.shape == b.shape for a, b in zip(want[:2], got[:2], strict=True))
        arcs = lambda x: [sorted(zip(*(c[x[1][k] : x[1][k + 1]].tolist() for c in x[2:]), strict=True)) for k in range(len(x[0]))]
        assert arcs(want) == arcs(got)


@pytest.mark.parametrize("most", [8, 0])
def test_adaptive_coolest_equals_searches_that_leave_nothing_out(spark, monkeypatch, most):
    """To the last bit, ties and null lambdas too, with bounds on the rest and without; shares above 100, whose costs are below 0, are searched in full."""
    from heapq import heappop, heappush

    def search(arcs, start, target, lam):
        heap, done = [(0.0, start, 0.0, 0.0)], set()
        while heap:
            cost, node, length, shade = heappop(heap)
            if node == target:
                return length, shade
            if node not in done:
                done.add(node)
                for o, n, s in arcs.get(node, ()):
                    heappush(heap, (cost + (n if lam is None else n * (1 - s / 100 + lam)), o, length + n, shade + n * s / 100))

    def chosen(arcs, start, target, tau):
        short = search(arcs, start, target, None)
        if short is None:
            return None
        low, high, best = 0.0, 1.0, search(arcs, start, target, 0.0)
        if best[0] <= tau * short[0]:
            return 0.0, *best, short[0]
        while (best := search(arcs, start, target, high))[0] > tau * short[0] and high < 1e6:
            low, high = high, high * 4
        for _ in range(22):
            mid = (low + high) / 2
            got = search(arcs, start, target, mid)
            low, high, best = (low, mid, got) if got[0] <= tau * short[0] else (mid, high, best)
        return (high, *best, short[0]) if best[0] <= tau * short[0] else (None, *short, short[0])

    monkeypatch.setattr(P, "REST_NODES", most)
    for seed, share, tau in ((1, 100, 1.1), (2, 100, 1.02), (3, 100, 0.9), (4, 130, 1.1)):
        g = random.Random(seed)
        edges = [(k, g.randrange(30), g.randrange(30), g.choice([g.randrange(0, 4), g.randrange(1, 90)]), g.choice([0, 50, 100, g.randrange(share + 1)])) for k in range(90)]
        arcs: dict = {}
        for _, u, v, n, s in edges:
            arcs.setdefault(u, []).append((v, float(n), float(s)))
            arcs.setdefault(v, []).append((u, float(n), float(s)))
        pairs = [(k, g.randrange(30), g.randrange(31)) for k in range(60)]
        want = {k: got for k, a, b in pairs if a in arcs and b in arcs and (got := chosen(arcs, a, b, tau))}
        out = P.coolest_within(spark.createDataFrame([*pairs, (98, None, 1), (99, 1, None)], "pair long, start long, target long"), spark.createDataFrame(edges, "edge_id long, u long, v long, length long, shade_pct long"), tau=tau, slack=0.0)
        assert {r.pair: (r.lam, r.len, r.shade, r.short_len) for r in out.collect()} == want
        assert any(w[0] is None or w[0] > 0 for w in want.values())


def test_adaptive_coolest_on_a_graph_too_large_to_broadcast(spark, monkeypatch):
    g = random.Random(6)
    edges = [(k, g.randrange(9), g.randrange(9), g.randrange(5, 40), g.randrange(0, 100)) for k in range(24)]
    e = spark.createDataFrame([x for x in edges if x[1] != x[2]], "edge_id long, u long, v long, length long, shade_pct long")
    pairs = spark.createDataFrame([(1, 0, 5), (2, 1, 8), (3, 0, 99), (4, None, 1)], "pair long, start long, target long")
    want, got = [], []
    for into, most in ((want, P.BROADCAST_EDGES), (got, 0)):
        monkeypatch.setattr(P, "BROADCAST_EDGES", most)
        into += sorted((r.pair, r.lam and round(r.lam, 3), round(r.len, 6), round(r.short_len, 6)) for r in P.coolest_within(pairs, e, tau=1.15, slack=0.0, rounds=3).collect())
    assert got == want and len(want) == 2


def test_tile_runs_skip_time_out_and_tell(spark):
    from penumbra.operators.tile_runs import tile_runs

    def work(row):
        import time

        if row["tile"] == 2:
            raise ValueError("bad tile")
        time.sleep(60 if row["tile"] == 3 else 0)

    tiles = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (None, "a")], "tile long, status string")
    got = tile_runs(tiles, tiles.filter("tile = 4"), work, timeout=2).collect()
    assert {r.tile: r.status for r in got} == {1: "done", 2: "ERR(exit1)", 3: "STUCK", 4: "skip", None: "done"}
    assert tile_runs(tiles.limit(0), tiles, work).count() == 0


def _lattice(spark, sf_dir):
    from penumbra.plans.base import Tables

    return Tables(spark, sf_dir).lattice().collect()


def test_bridging_of_the_lattice_equals_one_pass_over_sorted_links(spark, sf_dir):
    from penumbra.plans.registry import queries

    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    edges = _lattice(spark, sf_dir)
    for r in edges:
        if r.edge_id % 5 > 1:
            root[find(r.u)] = find(r.v)
    want = set()
    for r in sorted((r for r in edges if r.edge_id % 5 <= 1), key=lambda r: (r.shade_pct < 50, r.length, r.edge_id)):
        if find(r.u) != find(r.v):
            root[find(r.u)] = find(r.v)
            want.add((r.edge_id, r.u, r.v))
    assert want and {tuple(r) for r in queries()["n19_bridging"](spark, sf_dir).collect()} == want


def test_spurs_of_the_lattice_equal_brute_force(spark, sf_dir):
    from penumbra.plans.registry import queries

    left = {r.edge_id: r for r in _lattice(spark, sf_dir) if r.edge_id % 3}
    while True:
        n: dict = {}
        for r in left.values():
            for x in (r.u, r.v):
                n[x] = n.get(x, 0) + 1
        spurs = [k for k, r in left.items() if r.length < 600 and 1 in (n[r.u], n[r.v])]
        if not spurs:
            break
        for k in spurs:
            del left[k]
    assert {r.edge_id for r in queries()["n20_spur_prune"](spark, sf_dir).collect()} == set(left)


def test_duplicate_lines_equal_brute_force(spark, sf_dir):
    from penumbra.plans.base import Tables
    from penumbra.plans.joins import segments
    from penumbra.plans.registry import queries

    own = [(r.seg, *map(float, (r.x0, r.y0, r.x1, r.y1))) for r in segments(Tables(spark, sf_dir)).collect()]
    want = set()
    for k, a0, b0, a1, b1 in own:
        for j, *c in own:
            if j % 3:
                continue
            x0, y0, x1, y1 = (v + (2 if j % 2 == 0 else 30) for v in c)
            dx, dy, ex, ey = x1 - x0, y1 - y0, a1 - a0, b1 - b0
            if not dx * dx + dy * dy or not ex * ex + ey * ey or abs(dx * ex + dy * ey) < 0.8660254 * math.hypot(dx, dy) * math.hypot(ex, ey):
                continue
            near = 0
            for i in range(10):
                px, py = a0 + (i + 0.5) / 10 * ex, b0 + (i + 0.5) / 10 * ey
                f = max(0.0, min(1.0, ((px - x0) * dx + (py - y0) * dy) / (dx * dx + dy * dy)))
                near += math.hypot(px - x0 - f * dx, py - y0 - f * dy) <= 4
            if near > 8:
                want.add(k)
    assert want and {r.line for r in queries()["g14_duplicate_lines"](spark, sf_dir).collect()} == want


def _copies(spark):
    """Stations and buildings of which several stand at one place."""
    g = random.Random(11)
    spots = [(g.randrange(300), g.randrange(300)) for _ in range(12)]
    st = spark.createDataFrame([(k, *spots[k % 4], 150 if k % 4 else 250, 100 + k) for k in range(12)], "id long, x long, y long, cutoff long, demand long")
    b = spark.createDataFrame([(k, *spots[k % 12], "ab"[k % 5 % 2], 10 + k * 7 % 30) for k in range(60)], "b long, nx long, ny long, archetype string, gfa long")
    return st, b


@pytest.mark.parametrize("least, stage", [(None, "after"), (60, "after"), (60, "before")])
def test_pulls_by_place_give_the_sums_over_all_pairs(spark, least, stage):
    st, b = _copies(spark)
    full = D.huff(D.catchment(st.withColumnRenamed("id", "s"), b, 250), "s", "gfa", "d", "demand", least=least, stage=stage)
    pulls = D.place_pulls(st, b, "gfa", 250, least=least if stage == "before" else None)
    assert pulls.count() <= 4 * 12 < full.count()
    if least and stage == "after":
        pulls = pulls.filter(F.col("d") >= least)
    shares = D.place_shares(st, pulls).select("id", "n", F.round(F.col("demand") * F.col("share"), 9).alias("vol"))
    assert rows(shares, "id") == rows(full.groupBy("s").agg(F.count("*").alias("n"), F.round(F.sum("vol"), 9).alias("vol")), "s")
    ours = D.weighted_means(D.place_volumes(st, b, pulls, "gfa", "demand", "archetype"), "archetype", "vol", "d", "gfa")
    for got, want in zip(rows(ours, "archetype"), rows(D.weighted_means(full, "archetype", "vol", "d", "gfa"), "archetype"), strict=True):
        assert got[0] == want[0] and got[1:] == pytest.approx(want[1:])


PAIRLESS = ["a10_huff_denominator", "a12_weighted_means", "a13_metrics_rollup", "d06_filter_after", "d06_filter_before", "d09_assigned_share", "d12_demo_pairs"]


@pytest.mark.parametrize("name", PAIRLESS)
def test_huff_sums_make_no_row_of_a_pair(spark, sf_dir, monkeypatch, name):
    from penumbra.plans import demand
    from penumbra.plans.registry import queries

    monkeypatch.setattr(demand, "pairs", None)
    assert queries()[name](spark, sf_dir).columns


def _most_rows(monkeypatch, module, name):
    """The greatest number of rows on either side that the spatial join was given."""
    seen, was = [0], getattr(module, name)

    def counted(a, b, *more):
        seen[0] = max(seen[0], a.count(), b.count())
        return was(a, b, *more)

    monkeypatch.setattr(module, name, counted)
    return seen


def test_copies_at_one_place_are_compared_once(spark, tmp_path, monkeypatch):
    """50 customers and 50 suppliers at each of a few places: the joins see places, and the results are those of all rows."""
    from penumbra.operators import polygons as Q
    from penumbra.plans.registry import queries

    spark.range(200).select((F.col("id") % 4 + F.floor(F.col("id") / 4) * 12000).alias("c_custkey"), F.lit("X").alias("c_mktsegment")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(200).select((F.col("id") % 4 + F.floor(F.col("id") / 4) * 12000).alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    seen = [_most_rows(monkeypatch, S, n) for n in ("radius_join", "point_segment_join")]
    ids = [k % 4 + k // 4 * 12000 for k in range(200)]
    at = {k: (k * 7919 % 4000, k * 10427 % 3000) for k in ids}
    spot = {k: (k * 6151 % 4000, k * 3571 % 3000) for k in ids}
    got = {n: rows(queries()[n](spark, str(tmp_path))) for n in ("j11_largest_overlap", "n01_cluster", "n18_snap_to_edge", "j18_perpendicular_first", "j17_clear_of_rings", "j23_overlap_ratio")}
    far = lambda a, b: (at[a][0] - spot[b][0]) ** 2 + (at[a][1] - spot[b][1]) ** 2
    assert sorted(got["j11_largest_overlap"]) == sorted((a, min((far(a, b), b) for b in ids)[1]) for a in ids if min(far(a, b) for b in ids) <= 300 * 300)
    assert sorted(got["n01_cluster"]) == sorted((a, a % 12000, *map(float, at[a])) for a in ids)
    assert {r[0] for r in got["n18_snap_to_edge"]} >= {k for k in ids if k % 12000 == 0}
    assert max(s[0] for s in seen) <= 4
    ends = spark.createDataFrame([(1, None, 5), (2, None, 5), (7, 3, 3), (5, 3, 3), (6, 4, 3)], "id long, x long, y long")
    assert rows(N.cluster_endpoints(ends, 2).select("id", "node"), "id") == [(1, 1), (2, 2), (5, 5), (6, 5), (7, 5)]
    line = spark.createDataFrame([(1, 0, 0, 9, 0)], "seg long, x0 long, y0 long, x1 long, y1 long")
    samples = spark.createDataFrame([(1, 1, 2, 1), (1, 2, 2, 50), (2, 3, 2, 1), (2, 4, 2, 1)], "line long, id long, px long, py long")
    assert rows(Q.covered_share(samples, line, 3), "line") == [(1, 0.5), (2, 1.0)]


@pytest.mark.parametrize("name", ["j14_radius_pairs", "d05_huff", "a34_od_merge", "d10_od_export"])
def test_pairs_of_rows_come_from_pairs_of_places(spark, duck, tmp_path, monkeypatch, name):
    """25 customers and 3 suppliers at each of a few places: the join sees places, and every pair is there."""
    import duckdb
    from conftest import same
    from penumbra.plans.registry import oracle_sql, queries

    spark.range(100).select((F.col("id") % 4 + F.floor(F.col("id") / 4) * 12000).alias("c_custkey"), F.lit("X").alias("c_mktsegment")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(12).select((F.col("id") % 4 + F.floor(F.col("id") / 4) * 12000).alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    seen = _most_rows(monkeypatch, D, "radius_join")
    assert same(queries()[name](spark, str(tmp_path)), con.sql(oracle_sql()[name])) > 0
    assert seen[0] == 4


def test_pairs_of_rows_are_written_out_after_the_last_join(spark, tmp_path, monkeypatch):
    """J14: joins see arrays of the ids at a place, of bounded length, and both ids are taken out of them above all joins."""
    import duckdb
    from conftest import same
    from penumbra.plans.registry import oracle_sql, queries

    ids = lambda n, k: spark.range(n).select((F.col("id") % 4 + F.floor(F.col("id") / 4) * 12000).alias(k)).unionByName(spark.sql(f"select cast(null as long) as {k}"))
    ids(100, "c_custkey").withColumn("c_mktsegment", F.lit("X")).write.parquet(str(tmp_path / "customer.parquet"))
    ids(12, "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for most in (D.ARRAY_IDS, 30_000):
        monkeypatch.setattr(D, "ARRAY_IDS", most)
        out = queries()["j14_radius_pairs"](spark, str(tmp_path))
        above, _, below = out._jdf.queryExecution().optimizedPlan().toString().partition("Join")
        assert above.count("Generate explode(") == 2 and "collect_list" in below
        assert same(out, con.sql(oracle_sql()["j14_radius_pairs"])) > 0
    assert max(len(r.n) for r in D.ids_at(spark.range(90).withColumn("k", F.lit(1)), ["k"], "n").collect()) == 90


def test_od_export_shuffles_nothing_by_station_and_target(spark, tmp_path):
    """D10: only the product of places and targets is left to do, without an aggregate; null and repeated ids, targets whose nodes a station lacks."""
    import duckdb
    from conftest import same
    from penumbra.plans.registry import oracle_sql, queries

    keys = [*range(0, 60), 7, 7, 12007, 12001, 24500, None]
    spark.createDataFrame([(k, "X") for k in keys], "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k,) for k in [0, 1, 2, 3, 12000, 12001, 24001, 10, None]], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    out = queries()["d10_od_export"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1
    found = same(out, con.sql(oracle_sql()["d10_od_export"]))
    assert 0 < found < out.select("station").distinct().count() * 21
