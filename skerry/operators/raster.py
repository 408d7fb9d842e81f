"""Raster operators on a pixel table (scene_id, px_row, px_col, value). A window never spans a scene: sums run first along
rows, then along columns, so a partition is one line of one scene."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fixpoint import components, cut
from .pairs import point_pairs
from .relations import interpolated
from .runs import HELD, quantiles, small


def window_sums(pixels: DataFrame, values: dict[str, tuple[int, Column]]) -> DataFrame:
    """Sums over the (2 half + 1)-wide square around each pixel, of the pixels that exist, for several (half, value) at once:
    one pass along rows and one along columns carry all of them, so pixels are dealt twice whatever the number of sums."""
    along = Window.partitionBy("scene_id", "px_row").orderBy("px_col")
    down = Window.partitionBy("scene_id", "px_col").orderBy("px_row")
    rows = pixels.select("*", *[F.sum(v).over(along.rangeBetween(-half, half)).alias(f"_{k}") for k, (half, v) in values.items()])
    return rows.select(*pixels.columns, *[F.sum(f"_{k}").over(down.rangeBetween(-half, half)).alias(k) for k, (half, _) in values.items()])


def box_sums(pixels: DataFrame, half: int, values: dict[str, Column]) -> DataFrame:
    """As `window_sums`, with one width."""
    return window_sums(pixels, {k: (half, v) for k, v in values.items()})


def extents(pixels: DataFrame) -> DataFrame:
    """The last row and column of each scene: one row a scene, broadcast behind a count."""
    return small(pixels.groupBy("scene_id").agg(F.max("px_row").alias("_h"), F.max("px_col").alias("_w")))


def calibrate(pixels: DataFrame, lut: DataFrame) -> DataFrame:
    """Backscatter value^2 / sigma^2 by the table's lines, at least 1e-10; a zero in the table counts as one."""
    s = F.when(F.col("sigma") == 0, F.lit(1.0)).otherwise(F.col("sigma"))
    return interpolated(pixels, lut).withColumn("sigma0", F.greatest(F.col("value") * F.col("value") / (s * s), F.lit(1e-10)))


def to_uint8(linear: Column) -> Column:
    """Decibels clipped to [-25, 0] on a scale of 255."""
    db = F.least(F.greatest(10 * F.log10(linear), F.lit(-25.0)), F.lit(0.0))
    return F.floor((db + 25) / 25 * 255).cast("int")


def from_db(db: Column) -> Column:
    """Decibels, held to [-50, 30], back to linear power; no-data (-1000 or less) is 0."""
    held = F.least(F.greatest(db, F.lit(-50.0)), F.lit(30.0))
    return F.when(db <= -1000, 0.0).when(db.isNotNull(), F.pow(F.lit(10.0), held / 10))


def mirrored(pixels: DataFrame, half: int) -> DataFrame:
    """Adds the reflected border (edge pixel repeated) that a centred window needs."""
    joined = pixels.join(extents(pixels), "scene_id")
    places = lambda x, top: F.array_compact(F.array(F.col(x), F.when(F.col(x) < half, -1 - F.col(x)), F.when(F.col(top) - F.col(x) < half, 2 * F.col(top) + 1 - F.col(x))))
    return joined.select("scene_id", F.explode(places("px_row", "_h")).alias("px_row"), "px_col", "value", "_h", "_w").select("scene_id", "px_row", F.explode(places("px_col", "_w")).alias("px_col"), "value", "_h", "_w")


def lee_filter(pixels: DataFrame, size: int = 7) -> DataFrame:
    """m + k (x - m) with k = v / (v + mean v) over the scene; an even size grows by one; without noise the input stays."""
    half = (size | 1) // 2
    n = (2 * half + 1) ** 2
    sums = box_sums(mirrored(pixels, half), half, {"s": F.col("value"), "q": F.col("value") * F.col("value")})
    inner = sums.where((F.col("px_row") >= 0) & (F.col("px_col") >= 0) & (F.col("px_row") <= F.col("_h")) & (F.col("px_col") <= F.col("_w"))).withColumn("m", F.col("s") / n)
    local = inner.withColumn("v", F.greatest(F.col("q") / n - F.col("m") * F.col("m"), F.lit(0.0)))
    noise = small(local.groupBy("scene_id").agg(F.avg("v").alias("noise")))
    k = F.col("v") / (F.col("v") + F.col("noise"))
    return local.join(noise, "scene_id").select("scene_id", "px_row", "px_col", F.when(F.col("noise") == 0, F.col("value")).otherwise(F.col("m") + k * (F.col("value") - F.col("m"))).alias("filtered"))


def assign_tiles(pixels: DataFrame, size: int, overlap: int) -> DataFrame:
    """A row for each tile that covers a pixel, with the place inside it."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    covering = lambda x: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(x) - size + 1) / step)), F.floor(F.col(x) / step)))
    out = pixels.withColumn("tile_row", covering("px_row")).withColumn("tile_col", covering("px_col"))
    return out.select(*pixels.columns, "tile_row", "tile_col", (F.col("px_row") - F.col("tile_row") * step).alias("in_row"), (F.col("px_col") - F.col("tile_col") * step).alias("in_col"))


def flush_tiles(pixels: DataFrame, size: int, overlap: int) -> DataFrame:
    """As `assign_tiles`, but a last tile that would stick out is moved back to end with the scene. Adds where the tile
    starts and the place inside it."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    ends = pixels.groupBy("scene_id").agg((F.max("px_row") + 1).alias("_h"), (F.max("px_col") + 1).alias("_w"))

    def starts(x: str, extent: str) -> Column:
        last = F.greatest(F.lit(0), F.col(extent) - size)
        regular = F.filter(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(x) - size + 1) / step)), F.floor(F.col(x) / step)), lambda k: k * step <= last)
        flush = F.when((last % step > 0) & (F.col(x) >= last), F.array(last.cast("long")))
        return F.explode(F.concat(F.transform(regular, lambda k: k * step), F.coalesce(flush, F.array().cast("array<bigint>"))))

    out = pixels.join(ends, "scene_id").withColumn("row_off", starts("px_row", "_h")).withColumn("col_off", starts("px_col", "_w"))
    return out.select(*pixels.columns, "row_off", "col_off", (F.col("px_row") - F.col("row_off")).alias("in_row"), (F.col("px_col") - F.col("col_off")).alias("in_col"))


def tile_bounds(tiles: DataFrame, scenes: DataFrame, size: int) -> DataFrame:
    """The box in degrees around the four corners of each tile (scene_id, row_off, col_off) under its scene's affine (c0, c1,
    c2 for lon; f0, f1, f2 for lat), which may turn it."""
    corners = [(F.col("col_off") + dx * size, F.col("row_off") + dy * size) for dx in (0, 1) for dy in (0, 1)]
    lons = [F.col("c0") + F.col("c1") * x + F.col("c2") * y for x, y in corners]
    lats = [F.col("f0") + F.col("f1") * x + F.col("f2") * y for x, y in corners]
    ends = [F.least(*lons).alias("lon_min"), F.greatest(*lons).alias("lon_max"), F.least(*lats).alias("lat_min"), F.greatest(*lats).alias("lat_max")]
    return tiles.join(scenes, "scene_id").select(*tiles.columns, *ends)


def ca_cfar(pixels: DataFrame, guard: int = 2, training: int = 6, pfa: float = 1e-2, deviations: float | None = None, valid: Column | None = None) -> DataFrame:
    """Cell-averaging detection over the training ring. `training` counts from the centre and holds the guard; pixels closer
    to the border than that are left out.

    For power (exponential clutter) a hit is above alpha times the mean of the ring; with `deviations`, for decibels
    (Gaussian clutter), it is above the mean plus so many standard deviations. Pixels that are not valid are no hits, but
    count in the ring of others."""
    n = (2 * training + 1) ** 2 - (2 * guard + 1) ** 2
    alpha = n * (pfa ** (-1 / n) - 1)
    of = {"": F.col("value")} if deviations is None else {"": F.col("value"), "2": F.col("value") * F.col("value")}
    sums = {f"{name}{k}": (half, v) for k, v in of.items() for name, half in (("_outer", training), ("_inner", guard))}
    both = window_sums(pixels, sums).join(extents(pixels), "scene_id")
    inside = F.col("px_row").between(training, F.col("_h") - training) & F.col("px_col").between(training, F.col("_w") - training)
    mean = (F.col("_outer") - F.col("_inner")) / n
    threshold = alpha * mean
    if deviations is not None:
        threshold = mean + deviations * F.sqrt(F.greatest((F.col("_outer2") - F.col("_inner2")) / n - mean * mean, F.lit(0.0)))
    snr = F.when(mean > 0, F.col("value") / mean)
    hit = F.col("value") > threshold
    hit = hit if valid is None else hit & F.coalesce(valid, F.lit(False))
    return both.where(inside).select("scene_id", "px_row", "px_col", "value", mean.alias("background"), snr.alias("snr"), hit.alias("hit"))


def tiled(pixels: DataFrame, size: int, halo: int) -> DataFrame:
    """Each pixel in its tile of size * size and, near an edge, in the neighbours that see it within the halo."""
    if not 0 <= halo <= size:
        raise ValueError("the halo must not be wider than a tile")
    first = lambda x: F.greatest(F.floor((F.col(x) - halo) / size), F.when(F.col(x) >= 0, 0))  # noqa: E731  no tiles before the scene
    near = lambda x: F.explode(F.sequence(first(x).cast("int"), F.floor((F.col(x) + halo) / size).cast("int")))
    return pixels.withColumn("_tr", near("px_row")).withColumn("_tc", near("px_col"))


def os_cfar(pixels: DataFrame, guard: int = 1, training: int = 3, q: float = 0.75, k: float = 2.0, size: int = 256) -> DataFrame:
    """Ordered-statistic hits: x > k times the training value at int(q (n - 1)) in order, of pixels whose window lies inside
    the scene. A task holds a tile with its halo as an array and sorts the windows of a few lines at a time; a pixel without
    a value is missing in the windows of others."""
    side = np.arange(-training, training + 1)
    ring = np.maximum(np.abs(side[:, None]), np.abs(side[None, :])) > guard
    span = 2 * training + 1

    def hits(key: tuple, t: pa.Table) -> pa.Table:
        top, left = key[1].as_py() * size - training, key[2].as_py() * size - training
        grid = np.full((size + 2 * training, size + 2 * training), np.nan)
        grid[t.column("px_row").to_numpy() - top, t.column("px_col").to_numpy() - left] = t.column("value").to_numpy()
        windows, found = np.lib.stride_tricks.sliding_window_view(grid, (span, span)), []
        for low in range(0, size, 32):
            v = np.sort(windows[low : low + 32][..., ring], axis=-1)  # missing ones come last
            n = np.count_nonzero(~np.isnan(v), axis=-1)
            at = np.floor(q * (np.maximum(n, 1) - 1)).astype(int)
            chosen = np.take_along_axis(v, at[..., None], axis=-1)[..., 0]
            x = grid[training + low : training + low + len(v), training : training + size]
            rows, cols = np.nonzero((n > 0) & (x > k * chosen))
            found.append((rows + low + top + training, cols + left + training, x[rows, cols]))
        row, col, value = (np.concatenate(x) for x in zip(*found, strict=True))
        h, w = t.column("_h")[0].as_py(), t.column("_w")[0].as_py()
        inside = (row >= training) & (row <= h - training) & (col >= training) & (col <= w - training)
        return pa.table({"scene_id": pa.array([key[0].as_py()] * int(inside.sum()), pa.int64()), "px_row": pa.array(row[inside], pa.int32()), "px_col": pa.array(col[inside], pa.int32()), "value": value[inside]})

    rows = pixels.select("scene_id", F.col("px_row").cast("int").alias("px_row"), F.col("px_col").cast("int").alias("px_col"), F.col("value").cast("double").alias("value")).where("value is not null")
    return tiled(rows.join(extents(pixels), "scene_id"), size, training).groupBy("scene_id", "_tr", "_tc").applyInArrow(hits, "scene_id long, px_row int, px_col int, value double")


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """(scene_id, point_id, cluster): the least core id of the cluster; a border point joins the least adjacent cluster;
    noise is null. points: (scene_id, point_id, x, y); ids may come again in other scenes. No side of a join is broadcast: all
    of them grow with the points."""
    near = point_pairs(points, points, ["scene_id"], eps, F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), F.lit(2)) + F.pow(F.col("a.y") - F.col("b.y"), F.lit(2))) <= eps, "x", "y")
    key = lambda end: F.struct("scene_id", F.col(f"{end}.point_id").alias("point_id")).alias(end)
    edges = cut(near.select(key("a"), key("b")))
    core = edges.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("a").alias("core")).hint("merge")
    between = edges.join(core, edges["a"] == core["core"], "left_semi").join(core, edges["b"] == core["core"], "left_semi").select("a", "b")
    comp = components(between).withColumnRenamed("id", "b")
    joined = edges.join(comp.hint("merge"), "b").groupBy("a").agg(F.min("comp.point_id").alias("border"), F.min(F.when(F.col("a") == F.col("b"), F.col("comp.point_id"))).alias("own"))
    labels = joined.select("a.scene_id", "a.point_id", F.coalesce("own", "border").alias("cluster"))
    return points.select("scene_id", "point_id").join(labels.hint("merge"), ["scene_id", "point_id"], "left")


def hit_clusters(hits: DataFrame, eps: float = 1.5, least: int = 3, min_snr: float = 0.0) -> DataFrame:
    """Boxes of clustered hits (scene_id, px_row, px_col, value, snr) with their centre (halves to even), mean and largest value
    and mean ratio. A
    cluster is named by its first core pixel, row * 2^32 + column."""
    ids = hits.withColumn("point_id", F.shiftleft(F.col("px_row").cast("long"), 32) + F.col("px_col"))
    labels = dbscan(ids.select("scene_id", "point_id", F.col("px_col").cast("double").alias("x"), F.col("px_row").cast("double").alias("y")), eps, least)
    out = ids.join(labels.hint("merge"), ["scene_id", "point_id"]).where("cluster is not null").groupBy("scene_id", "cluster").agg(
        F.min("px_col").alias("x_min"), F.min("px_row").alias("y_min"), F.max("px_col").alias("x_max"), F.max("px_row").alias("y_max"),
        F.bround(F.avg("px_col")).cast("int").alias("x_center"), F.bround(F.avg("px_row")).cast("int").alias("y_center"), F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"), F.avg("snr").alias("mean_snr"),
    )
    return out.where(F.col("mean_snr") >= min_snr)


def saturated_guard(hits: DataFrame, pixels: DataFrame, most: float = 0.05) -> DataFrame:
    """The hits of scenes where they are at most `most` of the valid pixels."""
    valid = pixels.where("value <> 0").groupBy("scene_id").agg(F.count("*").alias("_v"))
    full = hits.groupBy("scene_id").agg(F.count("*").alias("_h")).join(valid, "scene_id").where(F.col("_h") > most * F.col("_v"))
    return hits.join(full, "scene_id", "left_anti")


def cfar_score(pixels: DataFrame, guard: int = 2, training: int = 6) -> DataFrame:
    """max(0, (x - mean) / deviation) of the window guard + training wide, from 0 to 1 over the scene."""
    half = guard + training
    sums = box_sums(pixels, half, {"n": F.lit(1), "s": F.col("value"), "q": F.col("value") * F.col("value")})
    mean = F.col("s") / F.col("n")
    deviation = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    raw = sums.withColumn("raw", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("value") - mean, deviation), F.lit(0.0))))
    ends = small(raw.groupBy("scene_id").agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi")))
    return raw.join(ends, "scene_id").select("scene_id", "px_row", "px_col", F.coalesce(F.try_divide(F.col("raw") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)).alias("score"))


def optical_scale(reflectance: Column) -> Column:
    return F.floor(F.least(F.greatest(reflectance * 255 / 3000, F.lit(0.0)), F.lit(255.0))).cast("int")


def chip_pixels(pixels: DataFrame, chips: DataFrame, cell: int = 64, most: int = HELD) -> DataFrame:
    """The pixels inside each chip (scene_id, chip_id, r0, c0, r1, c1; ends open), log-scaled and stretched from the 2nd to
    the 98th percentile. Chips meet pixels by grid cell; what they hold is written once, and chips of any size have exact
    percentiles."""
    spans = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell)))
    tiled = chips.withColumn("_r", spans("r0", "r1")).withColumn("_c", spans("c0", "c1"))
    p = pixels.withColumn("_r", F.floor(F.col("px_row") / cell)).withColumn("_c", F.floor(F.col("px_col") / cell))
    inside = (F.col("px_row") >= F.col("r0")) & (F.col("px_row") < F.col("r1")) & (F.col("px_col") >= F.col("c0")) & (F.col("px_col") < F.col("c1"))
    held = cut(p.join(tiled, ["scene_id", "_r", "_c"]).where(inside).select("scene_id", "chip_id", "px_row", "px_col", F.log1p(F.greatest(F.col("value"), F.lit(0.0))).alias("v")))
    ends = quantiles(held, "v", ["scene_id", "chip_id"], most, lo=0.02, hi=0.98)
    scaled = F.coalesce(F.try_divide(F.least(F.greatest("v", "lo"), F.col("hi")) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * 255
    return held.join(ends, ["scene_id", "chip_id"]).select("scene_id", "chip_id", "px_row", "px_col", scaled.alias("grey"))


def convex_footprint(pixels: DataFrame, least: int = 100) -> DataFrame:
    """The hull of each scene's valid pixels as a ring of (col, row). Only the ends of every row go on, which hold the hull;
    the chain is then built for each scene."""
    valid = pixels.where("value > -1000 and value <> 0")
    ends = valid.groupBy("scene_id", "px_row").agg(F.min("px_col").alias("lo"), F.max("px_col").alias("hi"), F.count("*").alias("n"))
    enough = ends.groupBy("scene_id").agg(F.sum("n").alias("total")).where(F.col("total") >= least)

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        points = sorted({(int(c), int(r)) for r, lo, hi in zip(pdf.px_row, pdf.lo, pdf.hi, strict=True) for c in (lo, hi)})

        def half(run) -> list:
            out: list = []
            for p in run:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        ring = half(points) + half(reversed(points)) if len(points) > 1 else points
        return pd.DataFrame({"scene_id": pdf.scene_id.iloc[0], "vertex": range(len(ring)), "col": [p[0] for p in ring], "row": [p[1] for p in ring]})

    return ends.join(enough, "scene_id", "left_semi").groupBy("scene_id").applyInPandas(hull, "scene_id long, vertex int, col int, row int")


def score_tiles(tiles: DataFrame, scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Detections of a user's detector. `scorer` is called once in each Python worker to load it; what it returns takes tile
    rows (scene_id, tile_row, tile_col, pixels) and returns (scene_id, tile_row, tile_col, class_name, confidence, x_min,
    y_min, x_max, y_max)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = scorer()
        for batch in batches:
            yield detect(batch)

    return tiles.mapInPandas(run, "scene_id long, tile_row long, tile_col long, class_name string, confidence double, x_min double, y_min double, x_max double, y_max double")
