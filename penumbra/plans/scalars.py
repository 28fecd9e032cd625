"""Scalar functions and geometry kernels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.functions import geometry as G
from penumbra.functions import scalars as X
from penumbra.functions import thermal as T
from penumbra.operators import islands as I
from penumbra.plans.base import Tables, query, rnd


@query("f01_split_explode", "select code, count(*) as n from (select trim(unnest(string_split(upper(p_name), ' '))) as code from part) group by code")
def f01(t: Tables) -> DataFrame:
    return t.part.select(F.explode(X.codes(X.clean_code(F.col("p_name")), " ")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("f02_filename_regex", r"select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_extract(url, '/([a-z]{2})/(\d+)', 2) as num from pages")
def f02(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"/([a-z]{2})/(\d+)", 2).alias("num"))


@query("f03_strip_prefix", r'''select s_suppkey, trim(regexp_replace(regexp_replace('Until: 0' || s_suppkey % 10 || ':00 ! x', '![^\n]*', ''), '(?i)until:', '')) as "at" from supplier''')
def f03(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Until: 0"), (F.col("s_suppkey") % 10).cast("string"), F.lit(":00 ! x"))
    return t.supplier.select("s_suppkey", F.trim(F.regexp_replace(F.regexp_replace(text, r"![^\n]*", ""), r"(?i)until:", "")).alias("at"))


@query("f04_number_key", "select id, replace(printf('%.2f', lit_pct / 100.0::double), '.', 'p') as key, lpad(cast(hour as varchar), 2, '0') as hh from {pixels}")
def f04(t: Tables) -> DataFrame:
    return t.pixels().select("id", X.number_key(F.col("lit_pct") / 100.0).alias("key"), F.lpad(F.col("hour").cast("string"), 2, "0").alias("hh"))


@query("f05_key_parse", "select s_suppkey, case when s_suppkey % 5 = 0 then 1000000000000000000 else s_suppkey * 4 end as x, case when s_suppkey % 7 = 0 then 1000000000000000000 else s_suppkey end as y from supplier")
def f05(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    key = F.concat(F.when(k % 5 == 0, "a").otherwise((k * 4).cast("string")), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("_"), k.cast("string"))))
    x, y = X.tile_key(key)
    return t.supplier.select("s_suppkey", x.alias("x"), y.alias("y"))


@query("f06_doy_timestamp", "select event_id, strftime(make_timestamp(cast(year(ts) as int), 1, 1, 0, 0, 0) + to_days(cast(dayofyear(ts) - 1 as int)) + to_hours(cast(hour(ts) as int)) + to_minutes(cast(minute(ts) as int)), '%Y-%m-%d %H:%M') as \"at\" from events where dayofyear(ts) between 3 and 20")
def f06(t: Tables) -> DataFrame:
    at = X.from_day_of_year(F.year("ts"), F.dayofyear("ts"), F.hour("ts"), F.minute("ts"))
    return t.events.filter(F.dayofyear("ts").between(3, 20)).select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm").alias("at"))


@query("f07_local_window", "select event_id, strftime(ts + interval 8 hour, '%Y-%m-%d') as local_day, cast(hour(ts + interval 8 hour) as int) as local_hour, cast(dayofyear(ts + interval 8 hour) as int) as doy from events")
def f07(t: Tables) -> DataFrame:
    local = F.from_utc_timestamp("ts", "Asia/Singapore")
    return t.events.select("event_id", F.date_format(local, "yyyy-MM-dd").alias("local_day"), F.hour(local).alias("local_hour"), F.dayofyear(local).alias("doy"))


@query("f09_log_bins", "with m as (select max(gfa) as top from {buildings}) select id, cast(least(5, floor(ln(gfa + 1) / ln(top + 1) * 6)) as int) as bin, cast(greatest(0, least(8, floor((log10(greatest(gfa * 1.0::double, 1e-9)) + 1) / 0.5))) as int) as half_decade from {buildings} cross join m")
def f09(t: Tables) -> DataFrame:
    top = F.broadcast(t.buildings().agg(F.max("gfa").alias("top")))
    return t.buildings().crossJoin(top).select("id", X.log_bin(F.col("gfa"), F.col("top")).alias("bin"), X.half_decade(F.col("gfa").cast("double")).alias("half_decade"))


_G = "(2 * pi() / 365 * (doy - 1 + (h - 12) / 24))"
_PHI = f"radians({1.35}::double)"
SUN_SQL = f"""(select event_id, degrees(alt) as alt, degrees(case when ha > 0 then 2 * pi() - az else az end) as az from (
select *, acos(greatest(-1.0::double, least(1.0::double, (sin(decl) - sin({_PHI}) * sa) / (cos({_PHI}) * cos(alt) + 1e-9)))) as az from (
select *, asin(greatest(-1.0::double, least(1.0::double, sa))) as alt from (
select *, sin({_PHI}) * sin(decl) + cos({_PHI}) * cos(decl) * cos(ha) as sa from (
select *, radians((h * 60 + eot + 4 * 103.8::double - 60 * 8) / 4 - 180) as ha from (
select event_id, h, 0.006918::double - 0.399912::double * cos(g) + 0.070257::double * sin(g) - 0.006758::double * cos(2 * g) + 0.000907::double * sin(2 * g) - 0.002697::double * cos(3 * g) + 0.00148::double * sin(3 * g) as decl,
229.18::double * (0.000075::double + 0.001868::double * cos(g) - 0.032077::double * sin(g) - 0.014615::double * cos(2 * g) - 0.040849::double * sin(2 * g)) as eot
from (select *, {_G} as g from (select event_id, event_id % 24 - 0.5::double as h, 1 + event_id % 365 as doy from events))))))))"""


@query("f10_sun", f"select event_id, round(alt, 3) as alt, round(az, 3) as az from {SUN_SQL}")
def f10(t: Tables) -> DataFrame:
    k = F.col("event_id")
    alt, az = G.sun(k % 24, 1 + k % 365, 1.35, 103.8, 8)
    return t.events.select("event_id", rnd(alt, 3).alias("alt"), rnd(az, 3).alias("az"))


@query("f12_haversine", "select id, round(2 * 6371000.0::double * asin(sqrt(least(1.0::double, pow(sin(radians(y / 100.0::double - 1.3::double) / 2), 2) + cos(radians(1.3::double)) * cos(radians(y / 100.0::double)) * pow(sin(radians(x / 50.0::double - 103.8::double) / 2), 2)))), 3) as m from {buildings}")
def f12(t: Tables) -> DataFrame:
    return t.buildings().select("id", rnd(G.haversine(F.lit(1.3), F.lit(103.8), F.col("y") / 100.0, F.col("x") / 50.0), 3).alias("m"))


@query("f13_mercator", "select id, round(lon * 20037508.342789244::double / 180, 3) as mx, round(ln(tan((90 + lat) * pi() / 360)) * 20037508.342789244::double / pi(), 3) as my from (select id, x / 50.0::double as lon, (y + 1) / 100.0::double as lat from {buildings})")
def f13(t: Tables) -> DataFrame:
    mx, my = G.to_mercator(F.col("x") / 50.0, (F.col("y") + 1) / 100.0)
    return t.buildings().select("id", rnd(mx, 3).alias("mx"), rnd(my, 3).alias("my"))


@query("f14_rh", "select id, round(greatest(0.0::double, least(100.0::double, 100.0::double * (6.112::double * exp(17.67::double * d / (d + 243.5::double))) / (6.112::double * exp(17.67::double * c / (c + 243.5::double))))), 4) as rh from (select id, (280 + lit_pct / 5.0::double) - 273.15::double as c, (278 + hour / 2.0::double) - 273.15::double as d from {pixels})")
def f14(t: Tables) -> DataFrame:
    return t.pixels().select("id", rnd(T.rh_from_dew_point(280 + F.col("lit_pct") / 5.0, 278 + F.col("hour") / 2.0)).alias("rh"))


@query("f15_mixing_rh", "select id, round(greatest(0.0::double, least(100.0::double, q * 101000.0::double / (287.05::double / 461.5::double + q) / (6.112::double * exp(17.67::double * c / (c + 243.5::double)) * 100) * 100)), 4) as rh from (select id, 20 + lit_pct / 10.0::double as c, hour / 1500.0::double as q from {pixels})")
def f15(t: Tables) -> DataFrame:
    return t.pixels().select("id", rnd(T.rh_from_mixing_ratio(20 + F.col("lit_pct") / 10.0 + 273.15, F.col("hour") / 1500.0, F.lit(101000.0))).alias("rh"))


@query("f16_wind", "select id, round(sqrt(cast(dem * dem + hour * hour as double)), 6) as ws from {pixels}")
def f16(t: Tables) -> DataFrame:
    return t.pixels().select("id", F.round(T.wind_speed(F.col("dem"), F.col("hour")).cast("double"), 6).alias("ws"))


#: The leading terms of the published comfort polynomial (powers of air temperature, wind, radiant difference, vapour pressure).
UTCI_TERMS = [(0, 0, 0, 0, 0.607562052), (1, 0, 0, 0, -0.0227712343), (0, 1, 0, 0, -2.2583652), (1, 1, 0, 0, 0.0880326035), (0, 0, 1, 0, 0.398374029), (0, 0, 0, 1, 5.12733497)]


@query("f17_utci", "select id, round(case when id % 17 = 0 then -999 else c + 0.607562052::double - 0.0227712343::double * c - 2.2583652::double * w + 0.0880326035::double * c * w + 0.398374029::double * (r - c) + 5.12733497::double * pa end, 4) as utci from (select *, exp(2.7150305::double * ln(tk) - 2836.5744::double / (tk * tk) - 6028.076559::double / tk + 19.54263612::double - 0.02737830188::double * tk + 1.6261698e-5::double * tk * tk + 7.0229056e-10::double * tk * tk * tk - 1.8680009e-13::double * tk * tk * tk * tk) * 0.01::double * rh / 100.0 / 10.0 as pa from (select id, 20 + lit_pct / 10.0::double as c, 20 + lit_pct / 10.0::double + 273.15::double as tk, 40.0::double + hour as rh, 0.5::double + hour / 10.0::double as w, 25.0::double + dem as r from {pixels}))")
def f17(t: Tables) -> DataFrame:
    c, rh, w = 20 + F.col("lit_pct") / 10.0, 40.0 + F.col("hour"), 0.5 + F.col("hour") / 10.0
    r = F.when(F.col("id") % 17 == 0, -999.0).otherwise(25.0 + F.col("dem"))
    return t.pixels().select("id", rnd(T.utci(c, rh, r, w, UTCI_TERMS)).alias("utci"))


DAYS = "(select event_id, 1 + event_id % 365 as day, 10.0::double + event_id % 60 as alt, 15.0::double + event_id % 20 as c, 30.0::double + event_id % 60 as rh, 100.0::double + event_id % 700 as g from events)"
_D = "sqrt(1.00011::double + 0.034221::double * cos(b) + 0.001280::double * sin(b) + 0.000719::double * cos(2 * b) + 0.000077::double * sin(2 * b))"


def _days(t: Tables) -> DataFrame:
    k = F.col("event_id")
    return t.events.select(k, (1 + k % 365).alias("day"), (10.0 + k % 60).alias("alt"), (15.0 + k % 20).alias("c"), (30.0 + k % 60).alias("rh"), (100.0 + k % 700).alias("g"))


@query("f18_clearness", f"""select event_id, round(1370.0::double * cz * (1.021::double - 0.084::double * sqrt(m * (0.000949::double * 1013 + 0.051::double))) * (1 - 0.077::double * pow(exp(0.1133::double - ln(gg + 1) + 0.0393::double * td) * m, 0.3)) * d * pow(0.935, m), 2) as i0,
round(g / (1370.0::double * cz * d), 5) as kt from (select *, (237.7::double * gam / (17.27::double - gam)) * 1.8::double + 32 as td from (
select *, cos(zen) as cz, 35.0::double * cos(zen) / sqrt(1224.0::double * cos(zen) * cos(zen) + 1) as m, 17.27::double * c / (237.7::double + c) + ln(rh / 100) as gam, {_D} as d,
case when day > 335 or day <= 60 then 3.37::double when day <= 152 then 2.85 when day <= 244 then 2.80 else 2.64 end as gg
from (select *, radians(90 - alt) as zen, 2 * pi() * day / 365 as b from {DAYS})))""")
def f18(t: Tables) -> DataFrame:
    x = T.clearness(F.radians(90 - F.col("alt")), F.col("day"), F.col("c"), F.col("rh") / 100, F.col("g"), 1.35)
    return _days(t).select("event_id", rnd(x["i0"], 2).alias("i0"), F.round(x["kt"], 5).alias("kt"))


@query("f18_diffuse", f"""select event_id, round(least(g, g * f), 3) as diffuse, round(greatest(0.0::double, (g - g * f) / s), 3) as direct from (select *, case when kt <= 0.3 then 1 - 0.232::double * kt + 0.0239::double * s - 0.000682::double * c + 0.0195::double * (rh / 100)
when kt < 0.78 then 1.329::double - 1.716::double * kt + 0.267::double * s - 0.00357::double * c + 0.106::double * (rh / 100) else 0.426::double * kt - 0.256::double * s + 0.00349::double * c + 0.0734::double * (rh / 100) end as f
from (select *, sin(radians(alt)) as s, (event_id % 100) / 100.0::double as kt from {DAYS}))""")
def f18b(t: Tables) -> DataFrame:
    direct, diffuse = T.diffuse(F.col("g"), F.col("alt"), F.col("event_id") % 100 / 100.0, F.col("c"), F.col("rh"))
    return _days(t).select("event_id", rnd(diffuse, 3).alias("diffuse"), rnd(direct, 3).alias("direct"))


@query("f19_daylight_sky", f"select event_id, round(12.0::double + 24.0::double * asin(greatest(-1.0::double, least(1.0::double, tan(radians(-23.45::double * cos(2.0 * pi() * (day + 10.0) / 365.0))) * tan(radians(48.0::double))))) / pi(), 4) as hours, round(1 - (1 + w) * exp(-sqrt(1.2::double + 3.0 * w)), 6) as sky from (select *, 46.5::double * ((6.107::double * pow(10.0::double, 7.5::double * c / (237.3::double + c)) * (rh / 100)) / (c + 273.15::double)) as w from {DAYS})")
def f19(t: Tables) -> DataFrame:
    return _days(t).select("event_id", rnd(T.day_length(F.col("day"), 48.0)["hours"]).alias("hours"), F.round(T.sky_emissivity(F.col("c"), F.col("rh")), 6).alias("sky"))


@query("f20_mean_radiant", f"select event_id, round(sqrt(sqrt(g / (0.97::double * 5.67051e-8::double))) - 273.2::double, 4) as tmrt from {DAYS}")
def f20(t: Tables) -> DataFrame:
    return _days(t).select("event_id", rnd(T.mean_radiant_temperature(F.col("g"))).alias("tmrt"))


@query("f21_angle", "select id, round(degrees(acos(greatest(-1.0::double, least(1.0::double, (x * 3 + y * 4) / (sqrt(cast(x * x + y * y as double)) * 5.0::double))))), 4) as deg from {buildings} where x + y > 0")
def f21(t: Tables) -> DataFrame:
    return t.buildings().filter("x + y > 0").select("id", rnd(G.angle(F.col("x"), F.col("y"), F.lit(3), F.lit(4))).alias("deg"))


@query("f22_bearing", "select id, round(b, 4) as bearing, round(case when abs(b - 350) > 180 then 360 - abs(b - 350) else abs(b - 350) end, 4) as turn from (select id, case when degrees(atan2(x - 2000.5::double, y - 1500.5::double)) < 0 then degrees(atan2(x - 2000.5::double, y - 1500.5::double)) + 360 else degrees(atan2(x - 2000.5::double, y - 1500.5::double)) end as b from {buildings})")
def f22(t: Tables) -> DataFrame:
    b = G.bearing(F.col("x") - 2000.5, F.col("y") - 1500.5)
    return t.buildings().select("id", rnd(b).alias("bearing"), rnd(G.turn(b, F.lit(350.0))).alias("turn"))


@query("f23_bround", "select id, cast(round_even(lit_pct / 2.0::double, 0) as bigint) as half_even, cast(trunc(lit_pct / 3.0::double) as bigint) as truncated, cast(round_even(dem / 0.05::double, 0) as bigint) as key from {pixels}")
def f23(t: Tables) -> DataFrame:
    return t.pixels().select("id", F.bround(F.col("lit_pct") / 2.0).cast("long").alias("half_even"), (F.col("lit_pct") / 3.0).cast("long").alias("truncated"), X.snap(F.col("dem").cast("double")).alias("key"))


@query("f24_array_ops", "select k, list_sum(list_transform(a, lambda x: x)) as total, len(a) as n, list_max(a) as top from (select o_custkey as k, list(o_orderkey % 97) as a from orders group by o_custkey)")
def f24(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(F.col("o_orderkey") % 97).alias("a"))
    pairs = F.zip_with("a", "a", lambda x, y: (x + y) / 2)
    return a.select("k", F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x).cast("decimal(38,0)").alias("total"), F.size("a").cast("long").alias("n"), F.array_max(X.rolling_max(F.col("a"))).alias("top"))


@query("f25_dot_norm", "select vec_id, round(list_dot_product(embedding::double[], embedding::double[]), 4) as dot, round(1 / (1 + exp(-embedding[1]::double)), 6) as p from embeddings")
def f25(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select("vec_id", rnd(X.dot(e, e)).alias("dot"), F.round(X.logistic(F.get(e, F.lit(0)).cast("double")), 6).alias("p"))


NAMES = ["sun", "building", "tree", "tree on building", "linkway", "linkway on building", "linkway and tree", "all", "arcade", "arcade and tree", "arcade and linkway", "arcade and both", "footprint"]


@query("f26_class_names", "select name, count(*) as n from (select ([" + ", ".join(f"'{n}'" for n in NAMES) + "])[1 + class] as name from {pixels}) group by name")
def f26(t: Tables) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in enumerate(NAMES) for x in kv])
    return t.pixels().groupBy(F.element_at(names, F.col("class").cast("int")).alias("name")).agg(F.count("*").alias("n"))


@query("f27_json", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def f27(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("f28_affine", "select id, cast(floor((3000 - y) / 7.0::double) as bigint) as row_f, cast(floor(x / 7.0::double) as bigint) as col_f, cast(round_even((3000 - y) / 7.0::double, 0) as bigint) as row_r, cast(round_even(x / 7.0::double, 0) as bigint) as col_r from {buildings}")
def f28(t: Tables) -> DataFrame:
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    (rf, cf), (rr, cr) = G.pixel(x, y, 0, 3000, 7.0), G.pixel(x, y, 0, 3000, 7.0, "round")
    return t.buildings().select("id", rf.alias("row_f"), cf.alias("col_f"), rr.alias("row_r"), cr.alias("col_r"))


@query("f29_standardise", "select id, round((gfa - avg(gfa) over ()) / (stddev_pop(gfa) over () + 1e-6), 5) as z from {buildings}")
def f29(t: Tables) -> DataFrame:
    s = F.broadcast(t.buildings().agg(F.avg("gfa").alias("m"), F.stddev_pop("gfa").alias("s")))
    return t.buildings().crossJoin(s).select("id", F.round((F.col("gfa") - F.col("m")) / (F.col("s") + 1e-6), 5).alias("z"))


@query("f30_tile_index", "select id, cast(floor((x * 1000.0::double + 20037508.342789244::double) / (2 * 20037508.342789244::double / 4096)) as bigint) as tx, cast(floor((20037508.342789244::double - y * 1000.0::double) / (2 * 20037508.342789244::double / 4096)) as bigint) as ty from {buildings}")
def f30(t: Tables) -> DataFrame:
    tx, ty = G.tile_index(F.col("x") * 1000.0, F.col("y") * 1000.0, 12)
    return t.buildings().select("id", tx.alias("tx"), ty.alias("ty"))


@query("g01_chord", "select edge_id, round(dx / sqrt(dx * dx + dy * dy), 6) as ux, round(dy / sqrt(dx * dx + dy * dy), 6) as uy from (select edge_id, cast(v % 40 - u % 40 as double) as dx, cast(v // 40 - u // 40 as double) as dy from {lattice})")
def g01(t: Tables) -> DataFrame:
    at = lambda c: (F.col(c) % 40, F.floor(F.col(c) / 40))
    ux, uy = G.unit(*at("u"), *at("v"))
    return t.lattice().select("edge_id", F.round(ux, 6).alias("ux"), F.round(uy, 6).alias("uy"))


@query("g02_projection", "select id, round(t, 6) as t, round(sqrt(pow(x - 3500 * t, 2) + pow(y - 2500 * t, 2)), 4) as distance, round(t * sqrt(3500.0::double * 3500 + 2500.0::double * 2500), 4) as along from (select id, x, y, greatest(0.0::double, least(1.0::double, (x * 3500 + y * 2500) / 18500000.0::double)) as t from {buildings})")
def g02(t: Tables) -> DataFrame:
    p = G.project(F.col("x"), F.col("y"), F.lit(0), F.lit(0), F.lit(3500), F.lit(2500))
    return t.buildings().select("id", F.round(p["t"], 6).alias("t"), rnd(p["distance"]).alias("distance"), rnd(p["along"]).alias("along"))


@query("g03_split_line", "select edge_id, part, \"at\" from (select edge_id, cuts, unnest(range(0, len(cuts))) as part, unnest(cuts) as \"at\" from (select edge_id, list_sort(list_distinct([round(length * 0.25::double, 2), round(length * 0.5::double, 2), round((length - length % 2) * 0.5::double, 2)])) as cuts from {lattice})) where \"at\" > 0.2")
def g03(t: Tables) -> DataFrame:
    n = F.col("length")
    at = F.array_sort(F.array_distinct(F.array(F.round(n * 0.25, 2), F.round(n * 0.5, 2), F.round((n - n % 2) * 0.5, 2))))
    return t.lattice().select("edge_id", F.posexplode(at).alias("part", "at")).filter("at > 0.2").withColumn("part", F.col("part").cast("long"))


@query("g04_sampling", "select edge_id, k, round((k + 0.5::double) / n, 6) as frac from (select edge_id, n, unnest(range(0, n)) as k from (select edge_id, cast(greatest(1, ceil(length / 100.0::double)) as bigint) as n from {lattice}))")
def g04(t: Tables) -> DataFrame:
    e = t.lattice().withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("length") / 100.0)))
    k = e.select("edge_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    return k.select("edge_id", "k", F.round((F.col("k") + 0.5) / F.col("n"), 6).alias("frac"))


@query("g06_axis", "select archetype, round(0.5::double * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)), 6) as axis from {buildings} group by archetype")
def g06(t: Tables) -> DataFrame:
    return t.buildings().groupBy("archetype").agg(F.round(G.principal_axis("x", "y"), 6).alias("axis"))


@query("g08_corners", "select id from (select id, degrees(acos(greatest(-1.0::double, least(1.0::double, (ax * bx + ay * by_) / (sqrt(cast(ax * ax + ay * ay as double)) * sqrt(cast(bx * bx + by_ * by_ as double))))))) as turn from (select id, x - coalesce(lag(x) over w, last_value(x) over f) as ax, y - coalesce(lag(y) over w, last_value(y) over f) as ay, coalesce(lead(x) over w, first_value(x) over f) - x as bx, coalesce(lead(y) over w, first_value(y) over f) - y as by_ from (select id // 6 as line, id, x, y from {buildings}) window w as (partition by line order by id), f as (partition by line order by id rows between unbounded preceding and unbounded following))) where turn > 30")
def g08(t: Tables) -> DataFrame:
    b = t.buildings().withColumn("line", F.floor(F.col("id") / 6))
    return I.turns(b, ["line"], "id", ring=True).filter("turn > 30").select("id")


@query("g09_outward_normal", "select seg, round(-(y1 - y0) / len, 6) as nx, round((x1 - x0) / len, 6) as ny from (select *, sqrt(cast((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) as double)) as len from (select id as seg, x as x0, y as y0, (x + 37 + id % 50) as x1, (y + id * 7 % 60) as y1 from {stations}))")
def g09(t: Tables) -> DataFrame:
    from penumbra.plans.joins import segments

    ux, uy = G.unit(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return segments(t).select("seg", F.round(-uy, 6).alias("nx"), F.round(ux, 6).alias("ny"))


@query("g13_facade_hit", "select id from {buildings} where abs(cos(radians(id * 47 % 360))) <= 0.707")
def g13(t: Tables) -> DataFrame:
    return t.buildings().filter(F.abs(F.cos(F.radians(F.col("id") * 47 % 360))) <= 0.707).select("id")


@query("g15_polygon_area", "select line, abs(sum(x * ny - nx * y)) / 2.0::double as area from (select line, x, y, coalesce(lead(x) over w, first_value(x) over f) as nx, coalesce(lead(y) over w, first_value(y) over f) as ny from (select id // 6 as line, id, x, y from {buildings}) window w as (partition by line order by id), f as (partition by line order by id rows between unbounded preceding and unbounded following)) group by line having abs(sum(x * ny - nx * y)) / 2.0 >= 25")
def g15(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("line").orderBy("id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"n{c}")
    ring = t.buildings().withColumn("line", F.floor(F.col("id") / 6).cast("long")).select("line", "x", "y", nxt("x"), nxt("y"))
    return ring.groupBy("line").agg(G.shoelace(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")).alias("area")).filter("area >= 25")


@query("g16_centroid", "select archetype, round(avg(x), 4) as cx, round(avg(y), 4) as cy from {buildings} group by archetype")
def g16(t: Tables) -> DataFrame:
    return t.buildings().groupBy("archetype").agg(rnd(F.avg("x")).alias("cx"), rnd(F.avg("y")).alias("cy"))


assert math.isclose(G.MERCATOR, math.pi * 6378137)
