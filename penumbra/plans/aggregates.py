"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penumbra.operators import evaluate as E
from penumbra.operators import raster as R
from penumbra.plans.base import Tables, query, rnd
from penumbra.plans.rows import EDGE_SRC, edge_sources, source_kind


@query("a07_distinct", "select l_suppkey, count(distinct l_partkey) as n_parts from lineitem group by l_suppkey")
def a07(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n_parts"))


@query("a08_sorted_codes", "select l_suppkey, string_agg(distinct l_returnflag || l_linestatus, '+' order by l_returnflag || l_linestatus) as codes from lineitem group by l_suppkey")
def a08(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), "+").alias("codes"))


@query("a09_node_demand", "select id * 23 % (select count(*) from part) as node, cast(sum(gfa) as bigint) as w from {buildings} group by 1")
def a09(t: Tables) -> DataFrame:
    n = F.broadcast(t.part.agg(F.count("*").alias("n")))
    return t.buildings().crossJoin(n).groupBy((F.col("id") * 23 % F.col("n")).alias("node")).agg(F.sum("gfa").alias("w"))


@query("a14_weighted_shade", "select round(sum(length * shade_pct) / cast(sum(length) as double), 4) as all_edges, round(sum(length * shade_pct) filter (where edge_id % 5 <> 0) / cast(sum(length) filter (where edge_id % 5 <> 0) as double), 4) as main from {lattice}")
def a14(t: Tables) -> DataFrame:
    main = F.col("edge_id") % 5 != 0
    ls, length = F.col("length") * F.col("shade_pct"), F.col("length")
    return t.lattice().agg(rnd(F.sum(ls) / F.sum(length)).alias("all_edges"), rnd(F.sum(F.when(main, ls)) / F.sum(F.when(main, length))).alias("main"))


@query("a15_zonal_hist", "select hour, class, count(*) as n from {pixels} group by hour, class")
def a15(t: Tables) -> DataFrame:
    return R.zonal_histogram(t.pixels(), "hour", "class")


def _share(classes: tuple[int, ...]) -> str:
    return f"round(coalesce(count(*) filter (where class in ({', '.join(map(str, classes))})) / cast(nullif(count(*) filter (where class between 0 and 11), 0) as double), 0), 6)"


@query("a16_class_shares", f"select hour, {_share(R.SHADED)} as shade, " + ", ".join(f"{_share(c)} as {k}" for k, c in R.FAMILIES.items()) + " from {pixels} group by hour")
def a16(t: Tables) -> DataFrame:
    s = R.class_shares(t.pixels(), "hour")
    return s.select("hour", *[F.round(c, 6).alias(c) for c in s.columns if c != "hour"])


@query("a17_composition", "select hour, " + ", ".join(f"round(coalesce(100 * (count(*) filter (where class in ({', '.join(map(str, c))})) / cast(nullif(count(*) filter (where class between 1 and 11), 0) as double)), 0), 4) as {k}" for k, c in R.GROUPS.items()) + " from {pixels} group by hour")
def a17(t: Tables) -> DataFrame:
    s = R.composition(t.pixels(), "hour")
    return s.select("hour", *[rnd(c).alias(c) for c in s.columns if c != "hour"])


@query("a18_edge_mean_shade", "select edge_id, round(avg(lit_pct), 4) as lit from {lattice} left join {pixels} on id // 7 = edge_id and lit_pct < 90 group by edge_id")
def a18(t: Tables) -> DataFrame:
    px = t.pixels().filter("lit_pct < 90").select(F.floor(F.col("id") / 7).alias("edge_id"), "lit_pct")
    return t.lattice().select("edge_id").join(px, "edge_id", "left").groupBy("edge_id").agg(rnd(F.avg("lit_pct")).alias("lit"))


@query("a19_metre_counts", "select row as edge, count(*) filter (where class between 1 and 11) as shade_px, count(*) filter (where class between 4 and 11) as fac_px from {pixels} where class <> 12 group by row")
def a19(t: Tables) -> DataFrame:
    c = F.col("class")
    return t.pixels().filter("class <> 12").groupBy(F.col("row").alias("edge")).agg(F.count_if(c.between(1, 11)).alias("shade_px"), F.count_if(c.between(4, 11)).alias("fac_px"))


@query("a20_class_length", "select fac, round(sum(l), 4) as len, round(sum(l) / sum(sum(l)) over (), 6) as share from (select case when class between 8 and 11 then 3 when class between 4 and 7 then 4 when class between 2 and 3 then 2 when class = 1 then 1 else 0 end as fac, 250.0::double / count(*) over (partition by row) as l from {pixels}) where fac > 0 group by fac")
def a20(t: Tables) -> DataFrame:
    p = t.pixels().select(R.facility_class(F.col("class")).alias("fac"), (F.lit(250.0) / F.count("*").over(Window.partitionBy("row"))).alias("l")).filter("fac > 0")
    g = p.groupBy("fac").agg(F.sum("l").alias("s"))
    return g.select("fac", rnd("s").alias("len"), F.round(F.col("s") / F.sum("s").over(Window.partitionBy()), 6).alias("share"))


@query("a22_component_mix", f"select u // 40 as comp, cast(sum(length) as bigint) as length, bool_or(raw in ('osm', 'osmlink')) as has_osm, bool_or(raw in ('arcade', 'linkway')) as has_fac, case when bool_or(raw in ('osm', 'osmlink')) and bool_or(raw in ('arcade', 'linkway')) then 'mixed' when bool_or(raw in ('osm', 'osmlink')) then 'osm' else 'facility' end as kind from {EDGE_SRC} where dir = 0 group by 1")
def a22(t: Tables) -> DataFrame:
    e = edge_sources(t).filter("edge_id % 2 = 0")
    osm, fac = F.bool_or(F.col("raw").isin("osm", "osmlink")), F.bool_or(F.col("raw").isin("arcade", "linkway"))
    return e.groupBy(F.floor(F.col("u") / 40).cast("long").alias("comp")).agg(F.sum("length").alias("length"), osm.alias("has_osm"), fac.alias("has_fac"), F.when(osm & fac, "mixed").when(osm, "osm").otherwise("facility").alias("kind"))


@query("a23_source_mix", f"select case when raw in ('arcade', 'linkway', 'facconn') then 'shade' when raw in ('fac2osm', 'gapfill') then 'bridge' else 'footpath' end as src, count(*) as n, round(sum(length) / 10000.0::double, 4) as km from {EDGE_SRC} group by 1")
def a23(t: Tables) -> DataFrame:
    return edge_sources(t).groupBy(source_kind(F.col("raw")).alias("src")).agg(F.count("*").alias("n"), rnd(F.sum("length") / 10000.0).alias("km"))


@query("a28_median", "select o_custkey, round(quantile_cont(o_totalprice, 0.5), 4) as median from orders group by o_custkey")
def a28(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(rnd(F.percentile("o_totalprice", F.lit(0.5))).alias("median"))


@query("a29_percentiles", "select l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) as p{round(100 * p):02d}" for p in (0.25, 0.5, 0.75, 0.9, 0.99)) + " from lineitem group by l_returnflag")
def a29(t: Tables) -> DataFrame:
    p = E.percentiles(t.lineitem, "l_extendedprice", [0.25, 0.5, 0.75, 0.9, 0.99], "l_returnflag")
    return p.select("l_returnflag", *[rnd(c).alias(c) for c in p.columns[1:]])


@query("a30_histogram", "with h as (select case when lit_pct < 20 then 0 when lit_pct < 50 then 1 when lit_pct < 80 then 2 when lit_pct <= 100 then 3 end as bin from {pixels}) select b.bin, count(h.bin) as n, round(100.0::double * sum(count(h.bin)) over (order by b.bin) / sum(count(h.bin)) over (), 4) as cum_pct from (select unnest([0, 1, 2, 3]) as bin) b left join h using (bin) group by b.bin")
def a30(t: Tables) -> DataFrame:
    return E.histogram(t.pixels(), "lit_pct", [0, 20, 50, 80, 100]).withColumn("cum_pct", rnd("cum_pct"))


@query("a31_band_counts", "select p as least, count(*) filter (where length >= p and length < 500) as short, count(*) filter (where length >= greatest(p, 500)) as long from {lattice} cross join (select unnest([200, 400, 600]) as p) group by p")
def a31(t: Tables) -> DataFrame:
    e = t.lattice().select("length", F.explode(F.array(*[F.lit(x) for x in (200, 400, 600)])).alias("least"))
    n, p = F.col("length"), F.col("least")
    return e.groupBy("least").agg(F.count_if((n >= p) & (n < 500)).alias("short"), F.count_if(n >= F.greatest(p, F.lit(500))).alias("long"))


@query("a32_corr", "select round(corr(l_quantity, l_extendedprice), 6) as r from lineitem")
def a32(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("a33_keep_max", "select u % 97 as k, max(length) as length from {lattice} group by 1")
def a33(t: Tables) -> DataFrame:
    return t.lattice().groupBy((F.col("u") % 97).alias("k")).agg(F.max("length").alias("length"))


@query("a37_value_counts", "select o_orderpriority, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as share from orders group by o_orderpriority")
def a37(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("a39_coverage", "select hour, round(count(*) filter (where dem > 0) / cast(count(*) as double), 6) as covered from {pixels} group by hour")
def a39(t: Tables) -> DataFrame:
    return t.pixels().groupBy("hour").agg(F.round(F.count_if(F.col("dem") > 0) / F.count("*"), 6).alias("covered"))


@query("a40_ratio_to_two_pm", "with h as (select hour, sum(lit_pct) as s from {pixels} group by hour) select hour, round(s / cast((select s from h where hour = 14) as double), 6) as ratio from h")
def a40(t: Tables) -> DataFrame:
    h = t.pixels().groupBy("hour").agg(F.sum("lit_pct").alias("s"))
    at = h.filter("hour = 14").select(F.col("s").alias("base"))  # one row
    return h.crossJoin(F.broadcast(at)).select("hour", F.round(F.col("s") / F.col("base"), 6).alias("ratio"))


@query("a41_mean_near_flow", "select s.id as station, round(coalesce(avg(b.gfa), 0), 4) as flow from {stations} s left join {buildings} b on (s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y) <= 2500 group by s.id")
def a41(t: Tables) -> DataFrame:
    from penumbra.operators.spatial import radius_join

    near = radius_join(t.stations(), t.buildings().select(F.col("x").alias("nx"), F.col("y").alias("ny"), "gfa"), 50, 50).groupBy("id").agg(F.avg("gfa").alias("flow"))
    return t.stations().select("id").join(near, "id", "left").select(F.col("id").alias("station"), rnd(F.coalesce("flow", F.lit(0.0))).alias("flow"))


@query("a43_hour_families", "select hour, count(*) filter (where class in (1, 3, 5, 7)) as building, count(*) filter (where class in (8, 9, 10, 11)) as arcade from {pixels} where hour in (11, 15) group by hour")
def a43(t: Tables) -> DataFrame:
    return t.pixels().filter(F.col("hour").isin(11, 15)).groupBy("hour").agg(F.count_if(F.col("class").isin(*R.FAMILIES["building"])).alias("building"), F.count_if(F.col("class").isin(*R.FAMILIES["arcade"])).alias("arcade"))


@query("a44_overlap_summary", "select count(*) as n, cast(sum(gfa) as bigint) as area, round(avg(gfa), 4) as mean, round(quantile_cont(gfa, 0.5), 4) as median from {buildings} where x < 1500")
def a44(t: Tables) -> DataFrame:
    return t.buildings().filter("x < 1500").agg(F.count("*").alias("n"), F.sum("gfa").alias("area"), rnd(F.avg("gfa")).alias("mean"), rnd(F.percentile("gfa", F.lit(0.5))).alias("median"))


@query("a11_flow_accumulation", "select least(u, v) as a, greatest(u, v) as b, cast(sum(length * shade_pct) as bigint) as flow from {lattice} group by 1, 2")
def a11(t: Tables) -> DataFrame:
    return t.lattice().groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.sum(F.col("length") * F.col("shade_pct")).alias("flow"))
