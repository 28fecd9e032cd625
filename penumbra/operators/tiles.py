"""Array functions over raster tiles: skeletons and their scores, sky view, wall direction, region growing, carried state."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.operators.graph import cut_lineage
from penumbra.operators.raster import SKY_ALTITUDES, SKY_BANDS, SKY_STARTS


def grid(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int], fill: float = 0) -> np.ndarray:
    out = np.full(shape, fill, dtype=values.dtype)
    out[rows, cols] = values
    return out


def skeleton(mask: np.ndarray) -> np.ndarray:
    """One pixel wide centre lines by two-pass thinning: border pixels go that have 2 to 6 neighbours and one crossing, until none is left."""
    m = np.pad(mask.astype(bool), 1)
    while True:
        before = m.sum()
        for odd in (False, True):
            p = [np.roll(m, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]  # from north, clockwise
            n = sum(x.astype(int) for x in p)
            crossings = sum((~p[k] & p[(k + 1) % 8]).astype(int) for k in range(8))
            north, east, south, west = p[0], p[2], p[4], p[6]
            loose = ~(north & east & west) & ~(north & south & west) if odd else ~(north & east & south) & ~(east & south & west)
            m &= ~(m & (n >= 2) & (n <= 6) & (crossings == 1) & loose)
        if m.sum() == before:
            return m[1:-1, 1:-1]


def dilated(mask: np.ndarray, r: int) -> np.ndarray:
    p = np.pad(mask.astype(bool), r)
    out = np.zeros_like(mask, bool)
    for a in range(-r, r + 1):
        for b in range(-r, r + 1):
            if a * a + b * b <= r * r:
                out |= p[r + a : r + a + mask.shape[0], r + b : r + b + mask.shape[1]]
    return out


def centre_scores(pred: np.ndarray, truth: np.ndarray, slack: int = 3) -> tuple[float, float]:
    """Centre-line Dice, and F1 where a pixel within slack of the other mask counts as hit; 1 if both are empty."""
    if not pred.any() and not truth.any():
        return 1.0, 1.0

    def share(a: np.ndarray, b: np.ndarray) -> float:
        return float((a & b).sum() / a.sum()) if a.any() else 0.0

    def f(p: float, r: float) -> float:
        return 2 * p * r / (p + r) if p + r else 0.0

    return f(share(skeleton(pred), truth), share(skeleton(truth), pred)), f(share(pred, dilated(truth, slack)), share(truth, dilated(pred, slack)))


def tile_scores(pixels: DataFrame, size: int, slack: int = 3) -> DataFrame:
    """(tile_row, tile_col, cldice, relaxed_f1) of pixels (row, col, pred, truth); a tile has at most size * size rows."""
    tiled = pixels.select(F.floor(F.col("row") / size).cast("long").alias("tile_row"), F.floor(F.col("col") / size).cast("long").alias("tile_col"), (F.col("row") % size).alias("r"), (F.col("col") % size).alias("c"), "pred", "truth")

    def run(t: pa.Table) -> pa.Table:
        r, c = t.column("r").to_numpy(), t.column("c").to_numpy()
        masks = [grid(r, c, t.column(k).to_numpy(zero_copy_only=False), (size, size), False) for k in ("pred", "truth")]
        a, b = centre_scores(*masks, slack)
        return pa.table({"tile_row": t.column("tile_row")[:1], "tile_col": t.column("tile_col")[:1], "cldice": [a], "relaxed_f1": [b]})

    return tiled.groupBy("tile_row", "tile_col").applyInArrow(run, "tile_row long, tile_col long, cldice double, relaxed_f1 double")


def cast(z: np.ndarray, azimuth: float, altitude: float, steps: int) -> np.ndarray:
    """Where the sun at that azimuth and altitude (degrees) is hidden: surface shifted away from it, lowered by its tangent, running maximum."""
    rad = np.radians(azimuth)
    dx, dy, rise = np.sin(rad), -np.cos(rad), np.tan(np.radians(altitude))
    top = np.full_like(z, -np.inf)
    for k in range(1, steps + 1):
        a, b = round(k * dy), round(k * dx)
        moved = np.full_like(z, -np.inf)
        h, w = z.shape
        moved[max(0, -a) : h - max(0, a), max(0, -b) : w - max(0, b)] = z[max(0, a) : h - max(0, -a), max(0, b) : w - max(0, -b)]
        top = np.maximum(top, moved - k * rise)
    return top > z


def sky_view(z: np.ndarray, option: int = 1, steps: int = 20) -> dict[str, np.ndarray]:
    """Share of the sky that each pixel sees, whole and by direction; bands weigh by the sine of their width, patches evenly.

    The direction of the north takes azimuths from 270 to 90; the inventory notes that the model it follows leaves north at 0, an
    omission that is not repeated here.
    """
    out = {k: np.zeros_like(z, float) for k in ("all", "east", "south", "west", "north")}
    total = dict.fromkeys(out, 0.0)
    edges = np.concatenate([[0], (np.array(SKY_ALTITUDES[option][:-1]) + np.array(SKY_ALTITUDES[option][1:])) / 2, [90]])
    for k, (n, alt, start) in enumerate(zip(SKY_BANDS[option], SKY_ALTITUDES[option], SKY_STARTS[option], strict=True)):
        weight = (np.sin(np.radians(edges[k + 1])) - np.sin(np.radians(edges[k]))) / n
        for p in range(n):
            az = (start + p * 360 / n) % 360
            seen = ~cast(z, az, min(alt, 89.9), steps)
            for name, inside in (("all", True), ("east", az < 180), ("south", 90 <= az < 270), ("west", az >= 180), ("north", az >= 270 or az < 90)):
                if inside:
                    out[name] += weight * seen
                    total[name] += weight
    return {k: v / total[k] for k, v in out.items()}


def tile_sky_view(surface: DataFrame, size: int, halo: int, option: int = 1) -> DataFrame:
    """(row, col, svf, svf_east, svf_south, svf_west, svf_north) of surface (row, col, z), tile by tile with a halo on every side."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size)))
    dealt = surface.withColumn("tile_row", span("row")).withColumn("tile_col", span("col"))
    names = ["all", "east", "south", "west", "north"]

    def run(t: pa.Table) -> pa.Table:
        r0, c0 = t.column("tile_row")[0].as_py() * size - halo, t.column("tile_col")[0].as_py() * size - halo
        r, c = t.column("row").to_numpy() - r0, t.column("col").to_numpy() - c0
        z = grid(r, c, t.column("z").to_numpy().astype(float), (size + 2 * halo,) * 2, -np.inf)
        seen = sky_view(z, option, halo)
        inner = (r >= halo) & (r < halo + size) & (c >= halo) & (c < halo + size)
        r, c = r[inner], c[inner]
        return pa.table({"row": r + r0, "col": c + c0} | {k: seen[k][r, c] for k in names})

    out = dealt.groupBy("tile_row", "tile_col").applyInArrow(run, "row long, col long, " + ", ".join(f"{k} double" for k in names))
    return out.select("row", "col", F.col("all").alias("svf"), *[F.col(k).alias(f"svf_{k}") for k in names[1:]])


def wall_aspects(walls: np.ndarray, dem: np.ndarray, reach: int = 4) -> np.ndarray:
    """Degrees that each wall pixel faces: the line filter of 180 turned ones that holds most wall pixels, facing its lower side; nan elsewhere."""
    on, best, aspect = walls > 0, np.full(walls.shape, -1.0), np.full(walls.shape, np.nan)
    z, w = np.pad(dem.astype(float), reach, "edge"), np.pad(on.astype(float), reach)
    h, k = walls.shape
    at = lambda a, dy, dx: a[reach + dy : reach + dy + h, reach + dx : reach + dx + k]
    for deg in range(180):
        rad = np.radians(deg)
        dx, dy = np.sin(rad), -np.cos(rad)  # along the wall
        line = sum(at(w, round(s * dy), round(s * dx)) for s in range(-reach, reach + 1))
        right = sum(at(z, round(s * dx), round(-s * dy)) for s in range(1, reach + 1))
        left = sum(at(z, round(-s * dx), round(s * dy)) for s in range(1, reach + 1))
        won = on & (line > best)
        best[won] = line[won]
        aspect[won] = np.where(right <= left, (deg + 90) % 360, (deg + 270) % 360)[won]
    return aspect


def grow_regions(pixels: DataFrame, threshold: float = 14, rounds: int = 10) -> DataFrame:
    """(row, col, label): labelled pixels and, round by round, neighbours whose colour (l, a, b) lies within the threshold of the component's median.

    pixels: row, col, l, a, b, label (null: free). Of several labels the least wins. Each round is a join over the newest pixels only.
    """
    seeds = pixels.filter("label is not null")
    medians = cut_lineage(seeds.groupBy("label").agg(*[F.percentile(c, F.lit(0.5)).alias(f"m{c}") for c in "lab"]))
    free = pixels.filter("label is null").select("row", "col", "l", "a", "b")
    grown = cut_lineage(seeds.select("row", "col", "label"))
    fresh = grown
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    for _ in range(rounds):
        near = fresh.select("label", F.explode(steps).alias("o"), "row", "col").select("label", (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"))
        far2 = sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "lab"), F.lit(0.0))
        fit = near.join(free, ["row", "col"]).join(medians, "label").filter(far2 < threshold * threshold)
        fresh = cut_lineage(fit.groupBy("row", "col").agg(F.min("label").alias("label")).join(grown.select("row", "col"), ["row", "col"], "left_anti").select("row", "col", "label"))
        if fresh.isEmpty():
            break
        grown = cut_lineage(grown.unionByName(fresh))
    return grown


def carried(df: DataFrame, keys: list[str], hour: str, value: str, minutes: float = 60.0) -> DataFrame:
    """keys, hour, delayed: each hour's surface value mixed with what was carried from the hour before, the weight falling with time.

    A day's hours of a key are folded in order in one expression; the first hour carries nothing. Nulls keep what is carried.
    """
    keep = float(np.exp(-33.27 * minutes / 1440))
    day = F.array_sort(F.collect_list(F.struct(F.col(hour).alias("h"), F.col(value).cast("double").alias("v"))))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<struct<h:bigint,v:double>>").alias("out"))

    def step(s, x):
        now = F.when(s["last"].isNull(), x["v"]).when(x["v"].isNull(), s["last"]).otherwise(x["v"] * (1 - keep) + s["last"] * keep)
        return F.struct(now.alias("last"), F.concat(s["out"], F.array(F.struct(x["h"].cast("bigint").alias("h"), now.alias("v")))).alias("out"))

    folded = df.groupBy(*keys).agg(day.alias("day")).select(*keys, F.explode(F.aggregate("day", start, step, lambda s: s["out"])).alias("o"))
    return folded.select(*keys, F.col("o.h").alias("hour"), F.col("o.v").alias("delayed"))
