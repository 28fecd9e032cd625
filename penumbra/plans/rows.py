"""Sources, projections, filters and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.operators import raster as R
from penumbra.plans.base import Tables, query, rnd
from penumbra.sources import readers, writers


def not_in(c: Column, *values: str) -> Column:
    """NOT IN that null passes."""
    return c.isNull() | ~c.isin(*values)


def walkable(df: DataFrame) -> DataFrame:
    """Strict pedestrian filter over tags highway, foot, access, service, expressway."""
    # fixed values: the tags that count
    ways = ("footway", "pedestrian", "path", "steps", "corridor", "living_street", "residential", "service", "unclassified", "track")
    return df.filter(
        F.col("highway").isin(*ways) & not_in(F.col("foot"), "no", "private") & not_in(F.col("access"), "no", "private")
        & not_in(F.col("service"), "driveway", "parking_aisle", "drive-through", "emergency_access") & not_in(F.col("expressway"), "yes"))


def networked(df: DataFrame) -> DataFrame:
    """The looser filter: no motorways, trunks or their links, and foot is not no."""
    return df.filter(not_in(F.col("highway"), "motorway", "trunk", "motorway_link", "trunk_link") & (F.coalesce(F.col("foot").cast("string"), F.lit("")) != "no"))


TAGS = "(select c_custkey as id, case c_custkey % 7 when 0 then null when 1 then 'footway' when 2 then 'steps' when 3 then 'motorway' when 4 then 'residential' when 5 then 'trunk_link' else 'service' end as highway, case c_custkey % 4 when 0 then 'no' when 1 then 'yes' else null end as foot, case c_custkey % 5 when 0 then 'private' else null end as access, case c_custkey % 3 when 0 then 'driveway' else null end as service, case c_custkey % 11 when 0 then 'yes' else null end as expressway from customer)"


def _tags(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda n, m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), (k % n).cast("int"))
    return t.customer.select(
        k.alias("id"), pick(7, {1: "footway", 2: "steps", 3: "motorway", 4: "residential", 5: "trunk_link", 6: "service"}).alias("highway"),
        pick(4, {0: "no", 1: "yes"}).alias("foot"), pick(5, {0: "private"}).alias("access"), pick(3, {0: "driveway"}).alias("service"), pick(11, {0: "yes"}).alias("expressway"))


@query("p01_not_in_null", f"select id from {TAGS} where highway in ('footway', 'steps', 'residential', 'service') and (foot is null or foot not in ('no', 'private')) and access is null and service is null and expressway is null")
def p01(t: Tables) -> DataFrame:
    return walkable(_tags(t)).select("id")


@query("p02_network_filter", f"select id from {TAGS} where (highway is null or highway not in ('motorway', 'trunk', 'motorway_link', 'trunk_link')) and coalesce(foot, '') <> 'no'")
def p02(t: Tables) -> DataFrame:
    return networked(_tags(t)).select("id")


@query("p03_explode_parts", "select doc_id, part, len from (select doc_id, i as part, cast(length(p) as int) as len from (select doc_id, unnest(string_split(text, chr(10))) as p, unnest(range(0, len(string_split(text, chr(10))))) as i from documents)) where len > 5")
def p03(t: Tables) -> DataFrame:
    parts = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("part", "p"))
    return parts.select("doc_id", F.col("part").cast("long").alias("part"), F.length("p").alias("len")).filter("len > 5")


@query("p04_validity", "select id, lit_pct from {pixels} where lit_pct > 0 and lit_pct <= 60 and class in (select c_nationkey from customer)")
def p04(t: Tables) -> DataFrame:
    keys = t.customer.select(F.col("c_nationkey").cast("long").alias("class"))
    return t.pixels().filter("lit_pct > 0 and lit_pct <= 60").join(keys, "class", "left_semi").select("id", "lit_pct")


@query("p05_area_filter", "select id, coalesce(archetype, '__missing__') as archetype, gfa from (select id, case when id % 9 = 0 then null else archetype end as archetype, case when id % 13 = 0 then null else gfa - 150 end as gfa from {buildings}) where gfa > 0")
def p05(t: Tables) -> DataFrame:
    b = t.buildings().select("id", F.when(F.col("id") % 9 != 0, F.col("archetype")).alias("archetype"), F.when(F.col("id") % 13 != 0, F.col("gfa") - 150).alias("gfa"))
    return b.filter("gfa > 0").withColumn("archetype", F.coalesce("archetype", F.lit("__missing__")))


def source_kind(c: Column) -> Column:
    return F.when(c.isin("osm", "osmlink"), "footpath").when(c.isin("arcade", "linkway", "facconn"), "shade").when(c.isin("fac2osm", "gapfill"), "bridge").otherwise("footpath")


SRC = ["osm", "osmlink", "arcade", "linkway", "facconn", "fac2osm", "gapfill", "other"]
EDGE_SRC = "(select *, (['osm', 'osmlink', 'arcade', 'linkway', 'facconn', 'fac2osm', 'gapfill', 'other'])[1 + edge_id % 8] as raw from {lattice})"


def edge_sources(t: Tables) -> DataFrame:
    return t.lattice().withColumn("raw", F.element_at(F.array(*[F.lit(s) for s in SRC]), (1 + F.col("edge_id") % 8).cast("int")))


@query("p06_source_map", f"select edge_id, case when raw in ('arcade', 'linkway', 'facconn') then 'shade' when raw in ('fac2osm', 'gapfill') then 'bridge' else 'footpath' end as src from {EDGE_SRC}")
def p06(t: Tables) -> DataFrame:
    return edge_sources(t).select("edge_id", source_kind(F.col("raw")).alias("src"))


@query("p07_facility_class", "select id, case when class between 8 and 11 then 3 when class between 4 and 7 then 4 when class between 2 and 3 then 2 when class = 1 then 1 else 0 end as fac from {pixels}")
def p07(t: Tables) -> DataFrame:
    return t.pixels().select("id", R.facility_class(F.col("class")).alias("fac"))


@query("p08_water_rule", "select id, case when class = 7 and dem <= 0 then 0 else class end as class from {pixels}")
def p08(t: Tables) -> DataFrame:
    return t.pixels().select("id", R.without_water(F.col("class"), F.col("dem")).cast("long").alias("class"))


def dominant(df: DataFrame, key: str) -> DataFrame:
    """The facility of highest priority among a key's samples: sun, building, tree, linkway, arcade in rising order."""
    fac = R.facility_class(F.col("class"))
    rank = F.element_at(F.array(*[F.lit(x) for x in (0, 1, 2, 4, 3)]), fac + 1)
    return df.groupBy(key).agg(F.element_at(F.array(*[F.lit(x) for x in (0, 1, 2, 4, 3)]), F.max(rank) + 1).alias("fac"))


@query("p09_dominant_priority", "select row, case max(case when class between 8 and 11 then 4 when class between 4 and 7 then 3 when class between 2 and 3 then 2 when class = 1 then 1 else 0 end) when 4 then 3 when 3 then 4 when 2 then 2 when 1 then 1 else 0 end as fac from {pixels} group by row")
def p09(t: Tables) -> DataFrame:
    return dominant(t.pixels(), "row")


@query("p10_tier", "select id, case when gfa > 700 then 1 when archetype = 'BUILDING' then 2 else 3 end as tier from {buildings}")
def p10(t: Tables) -> DataFrame:
    return t.buildings().select("id", F.when(F.col("gfa") > 700, 1).when(F.col("archetype") == "BUILDING", 2).otherwise(3).alias("tier"))


@query("p12_view_keep", "select id, view from (select c_custkey as id, c_nationkey, 1 + c_custkey % 4 as view from customer) where view in (2, 4) or c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def p12(t: Tables) -> DataFrame:
    inside = t.nation.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("inside"))
    views = t.customer.select(F.col("c_custkey").alias("id"), "c_nationkey", (1 + F.col("c_custkey") % 4).alias("view")).join(inside, "c_nationkey", "left")
    return views.filter(F.col("view").isin(2, 4) | F.col("inside")).select("id", "view")


@query("p13_sparse_tiles", "select row // 10 as tile, round(avg(case when class = 1 then 1.0::double else 0 end), 6) as building from {pixels} group by row // 10 having not (avg(case when class = 1 then 1.0::double else 0 end) < 0.07 and avg(case when class = 2 then 1.0::double else 0 end) < 0.08)")
def p13(t: Tables) -> DataFrame:
    share = lambda k: F.avg(F.when(F.col("class") == k, 1.0).otherwise(0.0))
    tiles = t.pixels().groupBy(F.floor(F.col("row") / 10).cast("long").alias("tile")).agg(share(1).alias("b"), share(2).alias("v"))
    return tiles.filter("not (b < 0.07 and v < 0.08)").select("tile", F.round("b", 6).alias("building"))


@query("p14_land_mask", "select count(*) as n from {pixels} where dem > 0")
def p14(t: Tables) -> DataFrame:
    return t.pixels().filter((F.col("dem") > 0) & ~F.isnan(F.col("dem").cast("double"))).agg(F.count("*").alias("n"))


@query("p15_cleaning", "select id, case when z < -100 then 0.0::double else z end as z from (select o_orderkey as id, case when o_orderkey % 7 = 0 then -1e31::double else cast(o_orderkey * 17 % 23 - 2 as double) end as z from orders)")
def p15(t: Tables) -> DataFrame:
    z = F.when(F.col("id") % 7 == 0, -1e31).when(F.col("id") % 7 == -1, float("nan")).otherwise(F.col("dem").cast("double"))
    return t.pixels().select("id", R.clean(z, -100).alias("z"))


@query("p16_thin_box", "select id, case when class >= 8 then least(cast(dem as double), greatest(lit_pct / 20.0::double - 0.5, 0.5)) else 0.0::double end as base from {pixels}")
def p16(t: Tables) -> DataFrame:
    base = F.least(F.col("dem").cast("double"), F.greatest(F.col("lit_pct") / 20.0 - 0.5, F.lit(0.5)))
    return t.pixels().select("id", F.when(F.col("class") >= 8, base).otherwise(0.0).alias("base"))


@query("p17_remaining_surface", "select id, case when lit_pct > 0 and class >= 8 then dem else dem + lit_pct end as z from {pixels}")
def p17(t: Tables) -> DataFrame:
    return t.pixels().select("id", F.when((F.col("lit_pct") > 0) & (F.col("class") >= 8), F.col("dem")).otherwise(F.col("dem") + F.col("lit_pct")).alias("z"))


@query("p18_strip_height", "select id, round(least(3.6::double, case when dem > 0 then cast(dem as double) else 3.6 end), 4) as arc_h from {pixels} where lit_pct >= 2")
def p18(t: Tables) -> DataFrame:
    h = F.least(F.lit(3.6), F.when(F.col("dem") > 0, F.col("dem").cast("double")).otherwise(3.6))
    return t.pixels().filter("lit_pct >= 2").select("id", rnd(h).alias("arc_h"))


@query("p19_landcover_repair", "select id, case when class < 1 or class > 7 then 6 when class in (3, 4) then 5 else class end as cover from {pixels}")
def p19(t: Tables) -> DataFrame:
    c = F.col("class")
    return t.pixels().select("id", F.when((c < 1) | (c > 7), 6).when(c.isin(3, 4), 5).otherwise(c).cast("long").alias("cover"))


@query("p20_slot_name", "select distinct lower(split_part(day_type, '/', 1)) || '_' || lpad(cast(hour as varchar), 2, '0') as slot from {rides}")
def p20(t: Tables) -> DataFrame:
    return t.rides().select(F.concat_ws("_", F.lower(F.element_at(F.split("day_type", "/"), 1)), F.lpad(F.col("hour").cast("string"), 2, "0")).alias("slot")).distinct()


@query("p21_type_groups", "select case when archetype in ('AUTOMOBILE', 'MACHINERY') then 'industry' when archetype in ('FURNITURE', 'HOUSEHOLD') then 'home' else lower(archetype) end as kind, count(*) as n from {buildings} group by 1")
def p21(t: Tables) -> DataFrame:
    a = F.col("archetype")
    kind = F.when(a.isin("AUTOMOBILE", "MACHINERY"), "industry").when(a.isin("FURNITURE", "HOUSEHOLD"), "home").otherwise(F.lower(a))
    return t.buildings().groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("p22_facility_scenario", "select edge_id, cast(least(shade_pct, round_even(shade_pct * (edge_id * 7 % 90) / cast(greatest(1, 10 + edge_id % 91) as double), 0)) as bigint) as shade from {lattice}")
def p22(t: Tables) -> DataFrame:
    e = F.col("edge_id")
    scaled = F.bround(F.col("shade_pct") * (e * 7 % 90) / F.greatest(F.lit(1), 10 + e % 91).cast("double"), 0)
    return t.lattice().select("edge_id", F.least(F.col("shade_pct").cast("double"), scaled).cast("long").alias("shade"))


@query("p23_linkway_kind", "select id, case when id in (select o_custkey from orders where o_orderstatus = 'F') then 3 when id in (select o_custkey from orders where o_orderpriority = '1-URGENT') then 4 else 1 end as kind from {buildings}")
def p23(t: Tables) -> DataFrame:
    road = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.lit(True).alias("road")).distinct()
    house = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"), F.lit(True).alias("house")).distinct()
    return t.buildings().join(road, "id", "left").join(house, "id", "left").select("id", F.when(F.col("road"), 3).when(F.col("house"), 4).otherwise(1).alias("kind"))


@query("p24_label_assembly", "select doc_id, case when score < 0.2 then 0 else truth end as label from {detections}")
def p24(t: Tables) -> DataFrame:
    return t.detections().select("doc_id", F.when(F.col("score") < 0.2, 0).otherwise(F.col("truth")).alias("label"))


@query("s02_projected_scan", "select id, gfa from {buildings} where x between 500 and 2500 and y between 200 and 1800")
def s02(t: Tables) -> DataFrame:
    return t.buildings().filter(F.col("x").between(500, 2500) & F.col("y").between(200, 1800)).select("id", "gfa")


@query("s03_union_scan", "select 'o' as src, cast(o_orderkey as varchar) as code from orders union all select 'e', cast(event_id as varchar) from events")
def s03(t: Tables) -> DataFrame:
    a = t.orders.select(F.lit("o").alias("src"), F.col("o_orderkey").cast("string").alias("code"))
    return a.unionByName(t.events.select(F.lit("e").alias("src"), F.col("event_id").cast("string").alias("code")))


@query("s05_percent_band", "select id, cast(greatest(0.0::double, least(100.0::double, coalesce(v, 1.0::double) * 100)) as int) as pct from (select id, case when id % 11 = 0 then null else lit_pct / 64.0::double end as v from {pixels})".replace("cast(greatest", "cast(floor(greatest").replace(" * 100)) as int)", " * 100))) as int)"))
def s05(t: Tables) -> DataFrame:
    from penumbra.functions.scalars import percent_byte

    return t.pixels().select("id", percent_byte(F.when(F.col("id") % 11 != 0, F.col("lit_pct") / 64.0)).alias("pct"))


@query("s06_window_scan", "select row, col, class from {pixels} where row between 3 and 8 and col between 10 and 39")
def s06(t: Tables) -> DataFrame:
    return t.pixels().filter(F.col("row").between(3, 8) & F.col("col").between(10, 39)).select("row", "col", "class")


@query("s07_band_scan", "select row, col, hour + 1 as band, lit_pct from {pixels} where hour + 1 = 15")
def s07(t: Tables) -> DataFrame:
    return t.pixels().withColumn("band", F.col("hour") + 1).filter("band = 15").select("row", "col", "band", "lit_pct")


NAMES = """(select case when c_custkey % 10 = 3 then 'thumb_' || c_custkey || '.png' when c_custkey % 10 = 7 then c_custkey || '_preview.JPG' else c_custkey || '_103.' || (c_custkey % 90 + 10) || '_-1.' || (c_custkey % 80 + 10)
|| '_20240' || (c_custkey % 9 + 1) || '_baseheading' || (c_custkey % 360) || '.5_viewheading-' || (c_custkey % 180) || '.25_' || (c_custkey % 4 + 1) || '.jpg' end as name from customer)"""


def _names(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    good = F.concat(s(k), F.lit("_103."), s(k % 90 + 10), F.lit("_-1."), s(k % 80 + 10), F.lit("_20240"), s(k % 9 + 1), F.lit("_baseheading"), s(k % 360), F.lit(".5_viewheading-"), s(k % 180), F.lit(".25_"), s(k % 4 + 1), F.lit(".jpg"))
    return t.customer.select(F.when(k % 10 == 3, F.concat(F.lit("thumb_"), s(k), F.lit(".png"))).when(k % 10 == 7, F.concat(s(k), F.lit("_preview.JPG"))).otherwise(good).alias("name"))


@query("s08_file_names", rf"""select cast(m[1] as bigint) as pid, cast(m[2] as double) as lon, cast(m[3] as double) as lat, m[4] as date, cast(replace(m[5], 'baseheading', '') as double) as baseheading,
cast(replace(m[6], 'viewheading', '') as double) as viewheading, cast(m[7] as int) as view_idx from (select string_split(replace(name, '.jpg', ''), '_') as m from {NAMES} where name like '%.jpg')""")
def s08(t: Tables) -> DataFrame:
    return readers.view_names(_names(t))[0].drop("name")


@query("s08_skipped_names", f"select count(*) as skipped from {NAMES} where name like '%.JPG'")
def s08b(t: Tables) -> DataFrame:
    return readers.view_names(_names(t))[1]


@query("s09_label_json", "select event_id as doc, cast(0 as int) as shape, 'k' as label, 3 + cast(event_id % 3 as int) as n from events where event_id % 5 <> 0 and event_id % 4 <> 1")
def s09(t: Tables) -> DataFrame:
    k = F.col("event_id")
    pts = F.transform(F.sequence(F.lit(1), F.when(k % 5 == 0, 2).otherwise((3 + k % 3).cast("int"))), lambda i: F.array(i.cast("double"), i.cast("double")))
    shape = F.struct(F.lit("k").alias("label"), pts.alias("points"), F.when(k % 4 == 1, "line").otherwise("polygon").alias("shape_type"))
    lines = t.events.select(k.alias("doc"), F.to_json(F.struct(F.array(shape).alias("shapes"))).alias("value"))
    return readers.label_polygons(lines).select("doc", "shape", "label", F.size("points").alias("n"))


@query("s10_object_text", "select id, 'Schedule' as kind, 2 + cast(id % 2 as int) as n_fields from (select s_suppkey as id from supplier) union all select id, 'People', 3 from (select s_suppkey as id from supplier)")
def s10(t: Tables) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("! head, x;\nSchedule, s"), k, F.when(F.col("s_suppkey") % 2 == 1, ",") .otherwise(""), F.lit("; ! note\nPeople,\n  p"), k, F.lit(", 0.1;\n"))
    objects = t.supplier.select(F.col("s_suppkey").alias("id"), F.explode(readers.objects_of(text)).alias("o"))
    return objects.select("id", F.get("o", F.lit(0)).alias("kind"), F.size("o").alias("n_fields"))


@query("s11_met_text", "select l_orderkey as id, 4 as n, cast(l_quantity as double) as third from lineitem")
def s11(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit("  1\t"), F.col("l_quantity").cast("string"), F.lit("  0.5 ")).alias("value"))
    head = t.rows("value string", ("%iy id it imin",))
    f = readers.met_rows(head.unionByName(lines))
    return f.select(F.get("fields", F.lit(0)).cast("long").alias("id"), F.size("fields").alias("n"), F.get("fields", F.lit(2)).alias("third"))


@query("s12_common_times", "select a.k as time, a.n as n_a, b.n as n_b from (select o_orderkey as k, 1 as n from orders where o_orderkey % 2 = 0 and o_orderkey between 10 and 5000) a join (select o_orderkey as k, 2 as n from orders where o_orderkey % 3 = 0) b using (k)")
def s12(t: Tables) -> DataFrame:
    a = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("time"), F.lit(1).alias("n_a"))
    b = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("time"), F.lit(2).alias("n_b"))
    return readers.common_times(a, b, F.lit(10), F.lit(5000))


@query("s13_model_files", "select id, case id % 4 when 3 then null else strftime(make_timestamp(2024, 3, 1 + id % 28, id % 24, 0, 0), '%Y-%m-%d %H:%M') end as \"at\", case id % 4 when 3 then null else cast(1 + id % 3 as int) end as domain from (select cast(s_suppkey as int) as id from supplier)")
def s13(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    head = F.concat(F.lit("wrfout_d"), two(1 + k % 3), F.lit("_2024-03-"), two(1 + k % 28), F.lit("_"), two(k % 24))
    name = F.when(k % 4 == 0, F.concat(head, F.lit("_00_00"))).when(k % 4 == 1, F.concat(head, F.lit(":00:00"))).when(k % 4 == 2, head).otherwise(F.concat(head, F.lit(".nc4")))
    at, domain = readers.model_time(name)
    return t.supplier.select(k.cast("int").alias("id"), F.date_format(at, "yyyy-MM-dd HH:mm").alias("at"), domain.alias("domain"))


@query("s14_tile_maps", "select cast(x as varchar) || '_' || cast(y as varchar) as key, x, y from (select s_suppkey * 4000 % 44000 as x, s_suppkey * 7000 % 27000 as y from supplier where s_suppkey % 6 = 0)")
def s14(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    tiles = t.supplier.select(k.alias("id"), F.concat_ws("_", (k * 4000 % 44000).cast("string"), (k * 7000 % 27000).cast("string")).alias("key"), F.lit("p").alias("path"))
    return readers.tile_maps({"a": tiles.filter("id % 6 = 0").drop("id").distinct(), "b": tiles.filter("id % 2 = 0").drop("id").distinct()}).join(tiles.filter("id % 6 = 0").select("key"), "key").select("key", "x", "y")


@query("s15_landcover_lookup", "select id, v as cover, case when v = 1 then 0.2::double when v = 2 then 0.18 when v = 5 then 0.16 when v = 6 then 0.25 when v = 7 then 0.05 end as albedo from (select id, case when class < 1 or class > 7 then 6 when class in (3, 4) then 5 else class end as v from {pixels})")
def s15(t: Tables) -> DataFrame:
    look = t.rows("cover long, albedo double", (1, 0.2), (2, 0.18), (5, 0.16), (6, 0.25), (7, 0.05))
    return p19(t).join(F.broadcast(look), "cover", "left").select("id", "cover", "albedo")


@query("s16_valid_time", "select event_id, strftime(date_trunc('hour', ts) + to_hours(cast(event_id % 6 as int)), '%Y-%m-%d %H:%M') as \"at\" from events")
def s16(t: Tables) -> DataFrame:
    df = t.events.select("event_id", F.date_trunc("hour", "ts").alias("time"), (F.col("event_id") % 6).cast("int").alias("step"))
    return df.select("event_id", F.date_format(readers.valid_time(df), "yyyy-MM-dd HH:mm").alias("at"))


@query("k07_json_summary", "select '{\"archetype\":\"' || archetype || '\",\"n\":' || count(*) || '}' as json from {buildings} group by archetype")
def k07(t: Tables) -> DataFrame:
    return writers.summary_json(t.buildings().groupBy("archetype").agg(F.count("*").alias("n")))


@query("k10_upsert", "select edge_id, length, 'new' as gen from {lattice} where edge_id % 3 = 0 union all select edge_id, length, 'old' from {lattice} where edge_id % 3 <> 0 and edge_id % 2 = 0")
def k10(t: Tables) -> DataFrame:
    e = t.lattice().select("edge_id", "length")
    return writers.upsert(e.filter("edge_id % 2 = 0").withColumn("gen", F.lit("old")), e.filter("edge_id % 3 = 0").withColumn("gen", F.lit("new")), ["edge_id"])


@query("k11_merge_partials", "select hour, cast(sum(lit_pct) as bigint) as lit from {pixels} group by hour")
def k11(t: Tables) -> DataFrame:
    part = lambda k: t.pixels().filter(F.col("id") % 3 == k).groupBy("hour").agg(F.sum("lit_pct").alias("lit"))
    return writers.merge_partials([part(0), part(1), part(2)], ["hour"], "lit")


@query("k06_tile_pyramid", "with b as (select row as y, col as x, count(*) as n from {pixels} group by all) select cast(18 - k as int) as zoom, cast(x >> k as bigint) as x, cast(y >> k as bigint) as y, cast(sum(n) as bigint) as n from b cross join (select cast(unnest(range(0, 8)) as int) as k) group by all")
def k06(t: Tables) -> DataFrame:
    base = t.pixels().groupBy(F.col("row").alias("y"), F.col("col").alias("x")).agg(F.count("*").alias("n"))
    return R.pyramid(base, 18, 11).select(F.col("zoom").cast("int").alias("zoom"), "x", "y", "n")
