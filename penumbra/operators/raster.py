"""Map algebra over rasters as tables of pixels (row, col, band, ...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.operators.graph import connected_components

SHADED = tuple(range(1, 12))
FAMILIES = {"building": (1, 3, 5, 7), "vegetation": (2, 3, 6, 7, 9, 11), "linkway": (4, 5, 6, 7, 10, 11), "arcade": (8, 9, 10, 11)}
#: Disjoint groups of shaded classes.
GROUPS = {"building": (1,), "tree": (2, 3), "linkway": (4, 5, 6, 7), "arcade": (8, 9, 10, 11)}


def facility_class(c: Column) -> Column:
    """0 sun, 1 building, 2 tree, 3 arcade, 4 linkway."""
    return F.when(c.between(8, 11), 3).when(c.between(4, 7), 4).when(c.between(2, 3), 2).when(c == 1, 1).otherwise(0)


def without_water(c: Column, surface: Column) -> Column:
    """Class 7 at or below sea level is no shade."""
    return F.when((c == 7) & (surface <= 0), 0).otherwise(c)


def clean(v: Column, floor: float = -1e30) -> Column:
    """Values that are null, not finite or below floor become 0."""
    bad = v.isNull() | F.isnan(v) | (v < floor) | (F.abs(v) == float("inf"))
    return F.when(bad, 0.0).otherwise(v)


def category(flags: dict[str, Column], altitude: Column) -> Column:
    """The 13 shadow classes of a pixel.

    flags: booleans building, vegetation, linkway, arcade (shadows), tree_building and linkway_building (overlaps), strip (walkway) and
    footprint. Of the base classes the one listed last whose rule holds counts; arcade classes off the strip become the building
    side's, and the building side's on the strip become arcade; a footprint is 12; with the sun down all is 0.
    """
    b, v, s, a = (flags[k] for k in ("building", "vegetation", "linkway", "arcade"))
    tb, lb = flags["tree_building"], flags["linkway_building"]
    vi, si = v | tb, s | lb
    rules = [
        (1, b & ~v & ~s & ~a), (2, v & ~b & ~s & ~a), (3, tb & ~s & ~a), (4, s & ~b & ~v & ~a), (5, lb & ~v & ~a), (6, v & s & ~b & ~a), (7, b & v & s & ~a),
        (8, a & ~vi & ~si), (9, a & vi & ~si), (10, a & si & ~vi), (11, a & vi & si),
    ]
    base = F.lit(0)
    for k, rule in rules:
        base = F.when(rule, k).otherwise(base)
    off = F.when(base == 8, 1).when(base == 9, 3).when(base == 10, 5).when(base == 11, 7).otherwise(base)
    on = F.when(base == 1, 8).when(base == 3, 9).when(base == 5, 10).when(base == 7, 11).otherwise(base)
    return F.when(altitude <= 0, 0).when(flags["footprint"], 12).when(flags["strip"], on).otherwise(off)


def zonal_histogram(pixels: DataFrame, *by: str) -> DataFrame:
    return pixels.groupBy(*by).agg(F.count("*").alias("n"))


def class_shares(pixels: DataFrame, *by: str) -> DataFrame:
    """Share of shade (classes 1 to 11 of 0 to 11) and of each family; 0 where nothing counts."""
    inside = F.count_if(F.col("class").between(0, 11))
    part = lambda classes: F.coalesce(F.try_divide(F.count_if(F.col("class").isin(*classes)), inside), F.lit(0.0))
    return pixels.groupBy(*by).agg(part(SHADED).alias("shade"), *[part(c).alias(k) for k, c in FAMILIES.items()])


def composition(pixels: DataFrame, *by: str) -> DataFrame:
    """Per cent of the shaded pixels in each disjoint group."""
    shaded = F.count_if(F.col("class").isin(*SHADED))
    return pixels.groupBy(*by).agg(*[F.coalesce(100 * F.try_divide(F.count_if(F.col("class").isin(*c)), shaded), F.lit(0.0)).alias(k) for k, c in GROUPS.items()])


def tiles(pixels: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """pixels with tile_row, tile_col, and the place in the tile; a halo copies pixels to the tiles before that overlap them."""
    def spans(c: str) -> Column:
        own = F.floor(F.col(c) / size).cast("long")
        before = F.filter(F.array(own, own - 1), lambda t: (t >= 0) & (F.col(c) - t * size < size + halo))
        return F.explode(before)

    t = pixels.withColumn("tile_row", spans("row")).withColumn("tile_col", spans("col"))
    return t.withColumn("in_row", F.col("row") - F.col("tile_row") * size).withColumn("in_col", F.col("col") - F.col("tile_col") * size)


def core_mosaic(tiled: DataFrame, size: int, *values: str) -> DataFrame:
    """Whole raster from tiles: their halos are dropped."""
    core = tiled.filter((F.col("in_row") < size) & (F.col("in_col") < size))
    return core.select((F.col("tile_row") * size + F.col("in_row")).alias("row"), (F.col("tile_col") * size + F.col("in_col")).alias("col"), *values)


def blended_mosaic(tiled: DataFrame, p: str, w: str, threshold: float = 0.5) -> DataFrame:
    """Weighted mean of overlapping tiles, and whether it exceeds the threshold; weights that add up to 0 count as 1."""
    total = F.sum(w)
    return tiled.groupBy("row", "col").agg((F.sum(F.col(p) * F.col(w)) / F.when(total == 0, 1).otherwise(total)).alias("p")).withColumn("mask", F.col("p") > threshold)


def max_mosaic(tiled: DataFrame, value: str, rows: int, cols: int) -> DataFrame:
    """Overlapping tiles by maximum, clamped to the bounds."""
    return tiled.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).groupBy("row", "col").agg(F.max(value).alias(value))


def mask_and(mask: DataFrame, other: DataFrame) -> DataFrame:
    return mask.join(other.select("row", "col"), ["row", "col"], "left_semi")


def mask_and_not(mask: DataFrame, other: DataFrame) -> DataFrame:
    return mask.join(other.select("row", "col"), ["row", "col"], "left_anti")


def priority_pool(pixels: DataFrame, size: int, priority: dict[int, int]) -> DataFrame:
    """The class of highest priority in each block; ties to the lower class."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col("class").cast("int")), F.lit(0))
    block = [F.floor(F.col(c) / size).cast("long").alias(f"block_{c}") for c in ("row", "col")]
    return pixels.groupBy(*block).agg(F.max_by("class", F.struct(rank, -F.col("class"))).alias("class"))


def _around(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    return mask.select("row", "col", F.explode(steps).alias("o")).select((F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"))


def disk(r: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]


def dilate(mask: DataFrame, r: int) -> DataFrame:
    return _around(mask, disk(r)).distinct()


def erode(mask: DataFrame, r: int) -> DataFrame:
    n = len(disk(r))
    return _around(mask, disk(r)).groupBy("row", "col").agg(F.count("*").alias("n")).filter(F.col("n") == n).select("row", "col")


def close_mask(mask: DataFrame, r: int) -> DataFrame:
    return erode(dilate(mask, r), r)


def bridge_mask(mask: DataFrame, corridor: DataFrame, r: int) -> DataFrame:
    """The mask, and what its closing adds inside the corridor."""
    return mask.select("row", "col").union(mask_and(close_mask(mask, r), corridor)).distinct()


def label_mask(mask: DataFrame, cols: int, diagonal: bool = False) -> DataFrame:
    """mask with label: the least row * cols + col of its connected component."""
    m = mask.select("row", "col", (F.col("row") * cols + F.col("col")).alias("id"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    o = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])
    to = m.select(F.col("id").alias("a"), F.explode(o).alias("o"), "row", "col").select("a", (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"))
    pairs = to.join(m.select("row", "col", F.col("id").alias("b")), ["row", "col"]).select("a", "b")
    roots = connected_components(pairs).withColumnRenamed("node", "id")
    return m.join(roots, "id", "left").select("row", "col", F.coalesce("root", "id").alias("label"))


def drop_small(labelled: DataFrame, least: int) -> DataFrame:
    kept = labelled.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return labelled.join(kept.select("label"), "label", "left_semi")


def overlap_filter(labelled: DataFrame, other: DataFrame, most: float) -> DataFrame:
    """Components of which at most that share lies on the other mask."""
    on = labelled.join(other.select("row", "col", F.lit(1).alias("on")), ["row", "col"], "left")
    kept = on.groupBy("label").agg(F.avg(F.coalesce("on", F.lit(0))).alias("f")).filter(F.col("f") <= most)
    return labelled.join(kept.select("label"), "label", "left_semi")


def wall_heights(dem: DataFrame, least: float) -> DataFrame:
    """Highest of the four neighbours less the pixel, 0 if below least or at the border. dem: a whole grid (row, col, z)."""
    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    sides = [F.lag("z").over(across), F.lead("z").over(across), F.lag("z").over(down), F.lead("z").over(down)]
    named = dem.withColumns(dict(zip("nesw", sides, strict=True)))
    inner = F.col("n").isNotNull() & F.col("e").isNotNull() & F.col("s").isNotNull() & F.col("w").isNotNull()
    wall = F.greatest("n", "e", "s", "w") - F.col("z")
    return named.select("row", "col", "z", F.when(inner & (wall >= least), wall).otherwise(0).alias("wall"))


def shadow(surface: DataFrame, dx: int, dy: int, dz: float, steps: int) -> DataFrame:
    """Directional shadow, relational: a pixel is shaded if the surface k steps towards the sun, less k * dz, exceeds its own. For small grids and tests."""
    k = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k")
    cast = surface.select("row", "col", "z", k).select((F.col("row") + F.col("k") * dy).alias("row"), (F.col("col") + F.col("k") * dx).alias("col"), (F.col("z") - F.col("k") * dz).alias("top"))
    tops = cast.groupBy("row", "col").agg(F.max("top").alias("top"))
    return surface.join(tops, ["row", "col"], "left").select("row", "col", F.coalesce(F.col("top") > F.col("z"), F.lit(False)).alias("shaded"))


def tile_shadow(surface: DataFrame, size: int, dx: int, dy: int, dz: float, steps: int) -> DataFrame:
    """The same by an array function on each tile with a halo of `steps` pixels; tiles are bounded, so a group fits a task."""
    reach = steps * max(abs(dx), abs(dy))

    def spread(c: str, d: int) -> Column:
        low, high = F.floor((F.col(c) + min(0, d * steps)) / size), F.floor((F.col(c) + max(0, d * steps)) / size)
        return F.explode(F.sequence(low, high))

    dealt = surface.withColumn("tile_row", spread("row", dy)).withColumn("tile_col", spread("col", dx))

    def run(table: pa.Table) -> pa.Table:
        tr, tc = table.column("tile_row")[0].as_py() * size, table.column("tile_col")[0].as_py() * size
        z = np.full((size + 2 * reach, size + 2 * reach), -np.inf)
        r, c = (table.column(k).to_numpy() for k in ("row", "col"))
        z[r - tr + reach, c - tc + reach] = table.column("z").to_numpy()
        core = z[reach : reach + size, reach : reach + size]
        top = np.full_like(core, -np.inf)
        for k in range(1, steps + 1):
            a, b = reach - k * dy, reach - k * dx
            top = np.maximum(top, z[a : a + size, b : b + size] - k * dz)
        i, j = np.nonzero(np.isfinite(core))
        return pa.table({"row": pa.array(i + tr, pa.int64()), "col": pa.array(j + tc, pa.int64()), "shaded": pa.array((top > core)[i, j])})

    return dealt.groupBy("tile_row", "tile_col").applyInArrow(run, "row long, col long, shaded boolean")


def lit_violations(full: DataFrame, building_only: DataFrame) -> DataFrame:
    """How many pixels that a building shades are lit in the full system, and their share."""
    both = building_only.filter("shaded").select("row", "col").join(full, ["row", "col"])
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col("shaded")).alias("bad")).withColumn("rate", F.coalesce(F.try_divide("bad", "n"), F.lit(0.0)))


def rasterise(points: DataFrame, edges: DataFrame, order: str, value: str) -> DataFrame:
    """Pixel centres (row, col, x, y) inside polygons (ring, x0 .. y1, order, value): the value of the last writer."""
    from penumbra.operators.spatial import points_in_rings

    named = points.withColumn("__id", F.struct("row", "col"))
    inside = points_in_rings(named, edges.select("ring", "x0", "y0", "x1", "y1"), "__id")
    attrs = edges.select("ring", order, value).distinct()
    return inside.join(attrs, "ring").groupBy("__id").agg(F.max_by(value, F.struct(order, "ring")).alias(value)).select("__id.row", "__id.col", value)


def pyramid(tiles_at: DataFrame, zoom: int, least: int) -> DataFrame:
    """(zoom, x, y, n) of web tiles from the given zoom up: every level halves the indices of the one below and adds up n."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(zoom - least))).alias("k")
    return tiles_at.select("x", "y", "n", levels).groupBy((F.lit(zoom) - F.col("k")).alias("zoom"), F.floor(F.col("x") / F.pow(F.lit(2), F.col("k"))).cast("long").alias("x"), F.floor(F.col("y") / F.pow(F.lit(2), F.col("k"))).cast("long").alias("y")).agg(F.sum("n").alias("n"))


def grid_mismatches(grids: DataFrame) -> DataFrame:
    """Grids (name, width, height, pixel, crs) that differ from the first by name; empty if all are compatible."""
    first = grids.orderBy("name").limit(1).select(F.struct("width", "height", "pixel", "crs").alias("want"))
    return grids.crossJoin(F.broadcast(first)).filter(F.struct("width", "height", "pixel", "crs") != F.col("want")).select("name")



def canopy_shadow(surface: DataFrame, dx: int, dy: int, dz: float, steps: int, slack: float = 0.01) -> DataFrame:
    """As shadow, cast by the canopy tops (row, col, z, top): shaded where a shifted top exceeds the surface by more than slack."""
    k = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k")
    cast = surface.select("row", "col", "top", k).select((F.col("row") + F.col("k") * dy).alias("row"), (F.col("col") + F.col("k") * dx).alias("col"), (F.col("top") - F.col("k") * dz).alias("over"))
    tops = cast.groupBy("row", "col").agg(F.max("over").alias("over"))
    return surface.join(tops, ["row", "col"], "left").select("row", "col", F.coalesce(F.col("over") > F.col("z") + slack, F.lit(False)).alias("shaded"))


def through_layer(sh: Column, layer: Column, transmissivity: float) -> Column:
    """Light left by a floating layer of that transmissivity."""
    return sh - (1 - layer) * (1 - transmissivity)


#: Patches in each altitude band of the sky, by option.
SKY_BANDS = {
    1: (30, 30, 24, 24, 18, 12, 6, 1),
    2: (31, 30, 28, 24, 19, 13, 7, 1),
    3: (62, 60, 56, 48, 38, 26, 14, 1),
    4: (62, 62, 60, 60, 56, 56, 48, 48, 38, 38, 26, 26, 14, 14, 1),
}


#: Fixed values of the sky divisions: altitudes of the bands and where azimuths start, by option.
SKY_ALTITUDES = {k: (6, 18, 30, 42, 54, 66, 78, 90) for k in (1, 2, 3)} | {4: (3, 9, 15, 21, 27, 33, 39, 45, 51, 57, 63, 69, 75, 81, 90)}
SKY_STARTS = {k: (0, 4, 2, 5, 8, 0, 10, 0) for k in (1, 2, 3)} | {4: (0, 0, 4, 4, 2, 2, 5, 5, 8, 8, 0, 0, 10, 10, 0)}


def sky_patches(spark, option: int) -> DataFrame:
    """(band, patch, altitude, azimuth) of a sky division: azimuths are even within a band, from its start."""
    rows = [(k + 1, n, a, s) for k, (n, a, s) in enumerate(zip(SKY_BANDS[option], SKY_ALTITUDES[option], SKY_STARTS[option], strict=True))]
    bands = spark.createDataFrame(rows, "band int, n int, altitude int, start int")
    each = bands.withColumn("patch", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return each.select("band", "patch", "altitude", (F.col("start") + F.col("patch") * 360.0 / F.col("n")).alias("azimuth"))
