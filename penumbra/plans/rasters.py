"""Rasters as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.operators import raster as R
from penumbra.plans.base import Tables, query, rnd

GRID = 100
BITS = ("building", "vegetation", "linkway", "arcade", "strip", "footprint")


def _mask(t: Tables, cond: str) -> DataFrame:
    return t.pixels().filter(cond).select("row", "col")


def _flag(k: int) -> str:
    return f"((flags >> {k}) & 1) = 1"


def category_sql() -> str:
    b, v, s, a, strip, foot = (_flag(k) for k in range(6))
    tb, lb = f"({b} and {v})", f"({b} and {s})"
    vi, si = f"({v} or {tb})", f"({s} or {lb})"
    rules = [(11, f"{a} and {vi} and {si}"), (10, f"{a} and {si} and not {vi}"), (9, f"{a} and {vi} and not {si}"), (8, f"{a} and not {vi} and not {si}"), (7, f"{b} and {v} and {s} and not {a}"), (6, f"{v} and {s} and not {b} and not {a}"), (5, f"{lb} and not {v} and not {a}"), (4, f"{s} and not {b} and not {v} and not {a}"), (3, f"{tb} and not {s} and not {a}"), (2, f"{v} and not {b} and not {s} and not {a}"), (1, f"{b} and not {v} and not {s} and not {a}")]
    base = "case " + " ".join(f"when {r} then {k}" for k, r in rules) + " else 0 end"
    return f"select id, case when hour < 7 or hour > 19 then 0 when {foot} then 12 when {strip} then case c when 1 then 8 when 3 then 9 when 5 then 10 when 7 then 11 else c end else case c when 8 then 1 when 9 then 3 when 10 then 5 when 11 then 7 else c end end as class from (select *, {base} as c from {{pixels}})"


@query("r18_category", category_sql())
def r18(t: Tables) -> DataFrame:
    flags = {k: F.col("flags").bitwiseAND(1 << i) != 0 for i, k in enumerate(BITS)}
    flags |= {"tree_building": flags["building"] & flags["vegetation"], "linkway_building": flags["building"] & flags["linkway"]}
    return t.pixels().select("id", R.category(flags, F.when(F.col("hour").between(7, 19), 10).otherwise(-5)).alias("class"))


@query("r01_rasterise", "select row, col, case when row + col > 100 then 2 else 1 end as v from {pixels} where row between 10 and 90 and col between 10 and 90 and (row + col > 100 or (row <= 60 and col <= 60))".replace("(row + col > 100 or", "((row > 30 and col > 30) or").replace("case when row + col > 100", "case when row > 30 and col > 30"))
def r01(t: Tables) -> DataFrame:
    box = lambda ring, x0, y0, x1, y1, v: [(ring, x0, y0, x1, y0, v), (ring, x1, y0, x1, y1, v), (ring, x1, y1, x0, y1, v), (ring, x0, y1, x0, y0, v)]
    edges = t.rows("ring int, x0 double, y0 double, x1 double, y1 double, v int", *box(1, 9.5, 9.5, 60.5, 60.5, 1), *box(2, 30.5, 30.5, 90.5, 90.5, 2)).withColumn("ord", F.col("ring"))
    px = t.pixels().select("row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    return R.rasterise(px, edges, "ord", "v")


@query("r03_tiling", "select r // 1 as tile_row, c as tile_col, count(*) as n from (select row, col, unnest(case when row % 40 < 5 and row >= 40 then [row // 40, row // 40 - 1] else [row // 40] end) as r, unnest([1]) as one, col from {pixels}) cross join (select 0 as z) , lateral (select unnest(case when col % 40 < 5 and col >= 40 then [col // 40, col // 40 - 1] else [col // 40] end) as c) group by 1, 2".replace("row, col, unnest(case", "col, unnest(case").replace(", unnest([1]) as one, col from", " from").replace(" cross join (select 0 as z)", " q"))
def r03(t: Tables) -> DataFrame:
    return R.tiles(t.pixels().select("row", "col"), 40, 5).groupBy("tile_row", "tile_col").agg(F.count("*").alias("n"))


@query("r04_grid_check", "select 'b' as name")
def r04(t: Tables) -> DataFrame:
    return R.grid_mismatches(t.rows("name string, width int, height int, pixel double, crs int", ("a", 44, 27, 1.0, 3414), ("b", 44, 27, 2.0, 3414), ("c", 44, 27, 1.0, 3414)))


@query("r05_core_mosaic", "select row, col, class from {pixels}")
def r05(t: Tables) -> DataFrame:
    return R.core_mosaic(R.tiles(t.pixels().select("row", "col", "class"), 40, 5), 40, "class")


BLEND = "(select row, col, round(sum(p * w) / case when sum(w) = 0 then 1 else sum(w) end, 6) as p from (select row, col, lit_pct / 100.0::double as p, (1 + hour) / 10.0::double as w from {pixels} union all select row, col, class / 13.0::double, class / 10.0::double from {pixels}) group by row, col)"


@query("r06_blend", f"select row, col, p, p > 0.5 as mask from {BLEND}")
def r06(t: Tables) -> DataFrame:
    p = t.pixels()
    a = p.select("row", "col", (F.col("lit_pct") / 100.0).alias("p"), ((1 + F.col("hour")) / 10.0).alias("w"))
    b = p.select("row", "col", (F.col("class") / 13.0).alias("p"), (F.col("class") / 10.0).alias("w"))
    return R.blended_mosaic(a.unionByName(b), "p", "w").select("row", "col", F.round("p", 6).alias("p"), (F.round("p", 6) > 0.5).alias("mask"))


@query("r07_mask", "select row, col from {pixels} where class >= 8 and lit_pct > 30 and not dem < 0")
def r07(t: Tables) -> DataFrame:
    return R.mask_and_not(R.mask_and(_mask(t, "class >= 8"), _mask(t, "lit_pct > 30")), _mask(t, "dem < 0"))


PRIORITY = {8: 5, 9: 5, 10: 5, 11: 5, 4: 4, 5: 4, 6: 4, 7: 4, 12: 3, 2: 2, 3: 2, 1: 1}


@query("r08_priority_pool", "select row // 3 as block_row, col // 3 as block_col, arg_max(class, (case when class between 8 and 11 then 5 when class between 4 and 7 then 4 when class = 12 then 3 when class in (2, 3) then 2 when class = 1 then 1 else 0 end, -class)) as class from {pixels} group by 1, 2")
def r08(t: Tables) -> DataFrame:
    return R.priority_pool(t.pixels(), 3, PRIORITY)


DISK = "(select a, b from (select unnest(range(-{r}, {r} + 1)) as a) cross join (select unnest(range(-{r}, {r} + 1)) as b) where a * a + b * b <= {r} * {r})"


def _closed(mask: str, r: int) -> str:
    disk = DISK.replace("{r}", str(r))
    return f"(select row + a as row, col + b as col from (select distinct row + a as row, col + b as col from {mask} cross join {disk}) cross join {disk} group by 1, 2 having count(*) = (select count(*) from {disk}))"


SPARSE = "(select row, col from {pixels} where class >= 9 and lit_pct > 20)"


@query("r09_closing", f"select row, col from {_closed(SPARSE, 2)}")
def r09(t: Tables) -> DataFrame:
    return R.close_mask(_mask(t, "class >= 9 and lit_pct > 20"), 2)


@query("r10_corridor_bridge", f"select row, col from {SPARSE} union select c.row, c.col from {_closed(SPARSE, 2)} c join {{pixels}} p on p.row = c.row and p.col = c.col where p.dem > 5")
def r10(t: Tables) -> DataFrame:
    return R.bridge_mask(_mask(t, "class >= 9 and lit_pct > 20"), _mask(t, "dem > 5"), 2)


MASK = "(select row, col, row * 100 + col as id from {pixels} where lit_pct > 55)"
LABEL = f"""with recursive m as (select * from {MASK}), e as (select a.id as a, b.id as b from m a join m b on abs(a.row - b.row) + abs(a.col - b.col) = 1),
l(id, label) using key (id) as (select id, id from m union select e.b, min(l.label) from l join e on e.a = l.id join recurring.l as o on o.id = e.b where l.label < o.label group by e.b)"""


@query("r11_labels", f"{LABEL} select id // 100 as row, id % 100 as col, label from l")
def r11(t: Tables) -> DataFrame:
    return R.label_mask(_mask(t, "lit_pct > 55"), GRID)


@query("r11_betti", f"{LABEL} select cast(abs(count(distinct label) - 100) as bigint) as betti from l where label in (select label from l group by label having count(*) >= 3)")
def r11b(t: Tables) -> DataFrame:
    big = R.drop_small(R.label_mask(_mask(t, "lit_pct > 55"), GRID), 3)
    return big.agg(F.abs(F.count_distinct("label") - 100).alias("betti"))


@query("r12_overlap_filter", f"{LABEL} select id // 100 as row, id % 100 as col from l where label in (select label from l left join (select row * 100 + col as id, 1 as one from {{pixels}} where class < 4) o using (id) group by label having avg(coalesce(one, 0)) <= 0.5)")
def r12(t: Tables) -> DataFrame:
    return R.overlap_filter(R.label_mask(_mask(t, "lit_pct > 55"), GRID), _mask(t, "class < 4"), 0.5).select("row", "col")


@query("r02_vectorise", f"{LABEL} select label, count(*) as area from l group by label having count(*) >= 4")
def r02(t: Tables) -> DataFrame:
    return R.label_mask(_mask(t, "lit_pct > 55"), GRID).groupBy("label").agg(F.count("*").alias("area")).filter("area >= 4")


@query("r27_close_and_drop", f"select count(*) as n from {_closed(SPARSE, 1)}")
def r27(t: Tables) -> DataFrame:
    closed = R.close_mask(_mask(t, "class >= 9 and lit_pct > 20"), 1)
    return R.drop_small(R.label_mask(closed, GRID), 1).agg(F.count("*").alias("n"))


STEPS = 6


@query("r15_shadow", f"with z as (select row, col, dem as z from {{pixels}}), s as (select row + k as row, col + 2 * k as col, max(z - k * 1.5::double) as top from z cross join (select unnest(range(1, {STEPS + 1})) as k) group by 1, 2) select z.row, z.col, coalesce(top > z.z, false) as shaded from z left join s using (row, col)")
def r15(t: Tables) -> DataFrame:
    return R.shadow(t.pixels().select("row", "col", F.col("dem").alias("z")), 2, 1, 1.5, STEPS)


@query("r15_tile_shadow", f"with z as (select row, col, dem as z from {{pixels}}), s as (select row + k as row, col + 2 * k as col, max(z - k * 1.5::double) as top from z cross join (select unnest(range(1, {STEPS + 1})) as k) group by 1, 2) select z.row, z.col, coalesce(top > z.z, false) as shaded from z left join s using (row, col)")
def r15b(t: Tables) -> DataFrame:
    return R.tile_shadow(t.pixels().select("row", "col", F.col("dem").cast("double").alias("z")), 32, 2, 1, 1.5, STEPS)


@query("r16_canopy_shadow", f"with z as (select row, col, dem as z, lit_pct / 10.0::double as top from {{pixels}}), s as (select row + k as row, col + 2 * k as col, max(top - k * 1.5::double) as top from z cross join (select unnest(range(1, {STEPS + 1})) as k) group by 1, 2) select z.row, z.col, coalesce(s.top > z.z + 0.01::double, false) as shaded from z left join s using (row, col)")
def r16(t: Tables) -> DataFrame:
    from penumbra.operators.raster import canopy_shadow

    return canopy_shadow(t.pixels().select("row", "col", F.col("dem").alias("z"), (F.col("lit_pct") / 10.0).alias("top")), 2, 1, 1.5, STEPS)


@query("r17_opaque_layer", "select id, round(least(lit_pct / 100.0::double, hour / 24.0::double - (1 - class / 13.0::double) * (1 - 0.03::double)), 6) as lit from {pixels}")
def r17(t: Tables) -> DataFrame:
    return t.pixels().select("id", F.round(F.least(F.col("lit_pct") / 100.0, R.through_layer(F.col("hour") / 24.0, F.col("class") / 13.0, 0.03)), 6).alias("lit"))


@query("r20_sky_patches", "select band, count(*) as n from (select unnest([1,2,3,4,5,6,7,8]) as band, unnest([30,30,24,24,18,12,6,1]) as k), lateral (select unnest(range(0, k)) as p) group by band")
def r20(t: Tables) -> DataFrame:
    return R.sky_patches(t.spark, 1).groupBy("band").agg(F.count("*").alias("n"))


@query("r21_walls", "select row, col, case when n is null or s is null or e is null or w is null then 0 when greatest(n, e, s, w) - dem >= 3 then greatest(n, e, s, w) - dem else 0 end as wall from (select row, col, dem, lag(dem) over (partition by col order by row) as n, lead(dem) over (partition by col order by row) as s, lag(dem) over (partition by row order by col) as w, lead(dem) over (partition by row order by col) as e from {pixels})")
def r21(t: Tables) -> DataFrame:
    return R.wall_heights(t.pixels().select("row", "col", F.col("dem").alias("z")), 3).select("row", "col", F.col("wall").cast("long").alias("wall"))


@query("r24_property_grid", "select id, case when class = 0 then 0.2::double when class < 5 then 0.18 else 0.25 end as albedo from {pixels}")
def r24(t: Tables) -> DataFrame:
    look = t.rows("class long, albedo double", *[(k, 0.2 if k == 0 else 0.18 if k < 5 else 0.25) for k in range(13)])
    return t.pixels().join(F.broadcast(look), "class").select("id", "albedo")


@query("r25_lit_violations", "select count(*) as n, count(*) filter (where lit_pct >= 50) as bad, round(count(*) filter (where lit_pct >= 50) / cast(count(*) as double), 6) as rate from {pixels} where class in (1, 3)")
def r25(t: Tables) -> DataFrame:
    full = t.pixels().select("row", "col", (F.col("lit_pct") < 50).alias("shaded"))
    own = t.pixels().select("row", "col", F.col("class").isin(1, 3).alias("shaded"))
    return R.lit_violations(full, own).withColumn("rate", F.round("rate", 6))


@query("r26_max_mosaic", "select row, col, max(v) as v from (select row, col, class as v from {pixels} union all select row + 1, col + 1, hour from {pixels}) where row between 0 and 49 and col between 0 and 99 group by row, col")
def r26(t: Tables) -> DataFrame:
    p = t.pixels()
    a = p.select("row", "col", F.col("class").alias("v")).union(p.select(F.col("row") + 1, F.col("col") + 1, F.col("hour")))
    return R.max_mosaic(a, "v", 50, 100)


@query("n24_no_facility_shade", "select row as edge, cast(round_even(avg(case when class >= 4 then 0 else lit_pct end), 0) as bigint) as esn from {pixels} group by row")
def n24(t: Tables) -> DataFrame:
    return t.pixels().groupBy(F.col("row").alias("edge")).agg(F.bround(F.avg(F.when(F.col("class") >= 4, 0).otherwise(F.col("lit_pct")))).cast("long").alias("esn"))


@query("k05_class_tags", "select class, printf('%.4f', count(*) / cast(sum(count(*)) over () as double)) as share from {pixels} group by class")
def k05(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    g = t.pixels().groupBy("class").agg(F.count("*").alias("n"))
    return g.select("class", F.format_string("%.4f", rnd(F.col("n") / F.sum("n").over(Window.partitionBy()), 12)).alias("share"))
