"""Detection and run relations: optional filters, joins, paging. A predicate is added only when it is asked for, so that
it reaches the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import exprs as X


def _where(df: DataFrame, tests: dict[str, tuple[Column, object]]) -> DataFrame:
    for test, wanted in tests.values():
        if wanted is not None:
            df = df.where(test)
    return df


def search_detections(dets: DataFrame, runs: DataFrame, profile: str | None = None, model: str | None = None, min_conf: float | None = None, since=None, until=None, bbox: Sequence[float] | None = None, on_land: bool | None = None, cluster: bool | None = None, verdict: str | None = None, execution_id=None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Detections of successful runs with their run's provenance. With a limit or an offset, a page of them: highest
    confidence first, then det_id."""
    d = _where(
        dets,
        {
            "conf": (F.col("confidence") >= F.lit(min_conf), min_conf),
            "since": (F.col("created_at") >= F.lit(since), since),
            "until": (F.col("created_at") <= F.lit(until), until),
            "bbox": (X.point_in_bbox("longitude", "latitude", bbox or (0, 0, 0, 0)), bbox),
            "land": (F.col("on_land") == F.lit(on_land), on_land),
            "cluster": (F.col("cluster_anomaly") == F.lit(cluster), cluster),
            "run": (F.col("execution_id") == F.lit(execution_id), execution_id),
        },
    )
    if verdict is not None:
        d = d.where(F.col("quality_verdict") == verdict)
    r = _where(runs.where("status = 'success'"), {"p": (F.col("constraint_profile") == F.lit(profile), profile), "m": (F.col("model_name") == F.lit(model), model)})
    r = r.select(F.col("id").alias("execution_id"), "constraint_profile", "model_name", "model_version", "image_id")
    out = d.join(r, "execution_id")
    return out if limit is None and not offset else page(out, [F.desc_nulls_last("confidence"), F.col("det_id")], limit, offset)


def page(df: DataFrame, order: Sequence[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def search_executions(runs: DataFrame, profile: str | None = None, model: str | None = None, status: str | None = None, since=None, until=None) -> DataFrame:
    return _where(
        runs,
        {
            "p": (F.col("constraint_profile") == F.lit(profile), profile),
            "m": (F.col("model_name") == F.lit(model), model),
            "s": (F.col("status") == F.lit(status), status),
            "since": (F.col("created_at") >= F.lit(since), since),
            "until": (F.col("created_at") <= F.lit(until), until),
        },
    )


def _between(column: str, since, until) -> dict[str, tuple[Column, object]]:
    return {"since": (F.col(column) >= F.lit(since), since), "until": (F.col(column) <= F.lit(until), until)}


def ogc_items(dets: DataFrame, runs: DataFrame, bbox: Sequence[float] | None = None, since=None, until=None) -> DataFrame:
    """Detections with the sensing time of their run, filtered by place and by that time; order by created_at desc, det_id."""
    sensed = _where(runs.select(F.col("id").alias("execution_id"), F.col("created_at").alias("sensed")), _between("sensed", since, until))
    inside = _where(dets, {"bbox": (X.point_in_bbox("longitude", "latitude", bbox or (0, 0, 0, 0)), bbox)})
    return inside.join(sensed, "execution_id")


def stac_search(scenes: DataFrame, ring: Sequence[tuple[Column, Column]], bbox: Sequence[float] | None = None, since=None, until=None) -> DataFrame:
    """Scenes whose footprint meets the box, sensed in an interval, latest first, unknown times last; scenes: (scene_id, sensed)."""
    found = _where(scenes, _between("sensed", since, until))
    if bbox is not None:
        found = found.where(X.polygon_meets_envelope(ring, bbox))
    return found.orderBy(F.desc_nulls_last("sensed"), "scene_id")


def catalogue_search(scenes: DataFrame, ring: Sequence[tuple[Column, Column]], bbox: Sequence[float], after, before, sensor: str = "s1", top: int = 5, cloud: float = 20.0) -> DataFrame:
    """The latest scenes of a sensor (scenes: sensor, sensed, cloud_pct) over a box, strictly between two times; optical ones
    (s2) only below a share of cloud."""
    found = scenes.where((F.col("sensor") == sensor) & (F.col("sensed") > F.lit(after)) & (F.col("sensed") < F.lit(before)) & X.polygon_meets_envelope(ring, bbox))
    if sensor == "s2":
        found = found.where(F.col("cloud_pct") < cloud)
    return page(found, [F.desc("sensed"), F.col("scene_id")], top)


def validation_runs(runs: DataFrame, model: str | None = None, technique: str | None = None, dataset: str | None = None, limit: int | None = None) -> DataFrame:
    """Stored evaluations, newest (highest run_id) first."""
    wanted = {"model_name": model, "compression_technique": technique, "dataset": dataset}
    return page(_where(runs, {k: (F.col(k) == F.lit(v), v) for k, v in wanted.items()}), [F.desc("run_id")], limit)


def bundle_executions(runs: DataFrame, since=None, until=None, zone: str | None = None, model: str | None = None, profile: str | None = None) -> DataFrame:
    """The runs of an evidence bundle; order by created_at."""
    wanted = {"search_zone": zone, "model_name": model, "constraint_profile": profile}
    return _where(runs, _between("created_at", since, until) | {k: (F.col(k) == F.lit(v), v) for k, v in wanted.items() if v is not None})


def bundle_detections(dets: DataFrame, runs: DataFrame) -> DataFrame:
    """The detections of the runs (id)."""
    return dets.join(runs.select(F.col("id").alias("execution_id")), "execution_id", "left_semi")


def queue(cues: DataFrame, status: str | None = "pending", limit: int | None = None) -> DataFrame:
    """Cues by priority, then age."""
    return page(_where(cues, {"s": (F.col("status") == F.lit(status), status)}), [F.desc("priority"), F.col("created_at"), F.col("id")], limit)


def paging(matched: DataFrame, limit: int) -> DataFrame:
    """Of the column matched at each offset: the offsets before and after, null where there is none."""
    o = F.col("offset")
    return matched.select("offset", "matched", F.when(o > 0, F.greatest(F.lit(0), o - limit)).alias("prev_offset"), F.when(o + limit < F.col("matched"), o + limit).alias("next_offset"))


def edge_swath_filter(dets: DataFrame, scenes: DataFrame, buffer_px: float) -> DataFrame:
    """Drops detections whose centre lies within the buffer of the scene's edge; scenes: (scene_id, n_rows, n_cols). An
    unknown scene passes."""
    cx, cy = (F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2
    inside = (cx >= buffer_px) & (cy >= buffer_px) & (cx <= F.col("n_cols") - buffer_px) & (cy <= F.col("n_rows") - buffer_px)
    return dets.join(scenes, "scene_id", "left").where(F.col("n_rows").isNull() | inside).drop("n_rows", "n_cols")


def edge_swath_by_tiles(dets: DataFrame, tiles: DataFrame, scenes: DataFrame, buffer_px: float) -> DataFrame:
    """As `edge_swath_filter`, for boxes in tile coordinates. A scene's size is the one stated in scenes (scene_id, n_rows,
    n_cols), else as far as its tiles (scene_id, tile_index, row_off, col_off, tile_rows, tile_cols) reach. Detections of
    unknown tiles, and of scenes without a size, pass; without a buffer all do."""
    if buffer_px <= 0:
        return dets
    reach = tiles.groupBy("scene_id").agg(F.max(F.col("row_off") + F.col("tile_rows")).alias("_h"), F.max(F.col("col_off") + F.col("tile_cols")).alias("_w"))
    stated = scenes.select("scene_id", "n_rows", "n_cols").where("n_rows is not null and n_cols is not null")
    known = F.col("n_rows").isNotNull()
    size = reach.join(stated, "scene_id", "left").select("scene_id", F.when(known, F.col("n_rows")).otherwise(F.col("_h")).alias("_h"), F.when(known, F.col("n_cols")).otherwise(F.col("_w")).alias("_w"))
    place = tiles.select("scene_id", "tile_index", "row_off", "col_off").join(size, "scene_id")
    cx, cy = F.col("col_off") + (F.col("x_min") + F.col("x_max")) / 2, F.col("row_off") + (F.col("y_min") + F.col("y_max")) / 2
    near = (cx < buffer_px) | (cx > F.col("_w") - buffer_px) | (cy < buffer_px) | (cy > F.col("_h") - buffer_px)
    drop = F.coalesce((F.col("_h") > 0) & (F.col("_w") > 0) & near, F.lit(False))
    return dets.join(place, ["scene_id", "tile_index"], "left").where(~drop).select(*dets.columns)


def column_density_filter(dets: DataFrame, least_rows: int = 15, most_in_column: int = 8) -> DataFrame:
    """Scenes with more than `least_rows` detections lose those whose longitude, to three decimals, comes `most_in_column`
    times or more. Counts are joined back, so a crowded scene is not gathered in one task."""
    lon = F.round("longitude", 3)
    crowded = dets.groupBy("scene_id", lon.alias("_lon")).agg(F.count("*").alias("_in_column"))
    scene = crowded.groupBy("scene_id").agg(F.sum("_in_column").alias("_rows")).where(F.col("_rows") > least_rows)
    stripes = crowded.where(F.col("_in_column") >= most_in_column).join(scene, "scene_id").select("scene_id", "_lon")
    return dets.withColumn("_lon", lon).join(stripes, ["scene_id", "_lon"], "left_anti").drop("_lon")


def scene_quality(scenes: DataFrame, required: dict[str, Column]) -> DataFrame:
    """Which prerequisites a scene lacks, and whether it is valid."""
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in required.items()]))
    return scenes.withColumn("missing", missing).withColumn("scene_status", F.when(F.size("missing") == 0, "valid").otherwise("invalid"))


def land_lookup(dets: DataFrame, mask: DataFrame, resolution: float = 0.05) -> DataFrame:
    """on_land by the cell of the point; flags, never drops."""
    cells = mask.select("cell_x", "cell_y").distinct().withColumn("_land", F.lit(True))
    cell = lambda col: F.floor(F.col(col) / resolution).cast("int")
    return dets.withColumn("cell_x", cell("longitude")).withColumn("cell_y", cell("latitude")).join(cells, ["cell_x", "cell_y"], "left").withColumn("mask_on_land", F.coalesce("_land", F.lit(False))).drop("_land", "cell_x", "cell_y")


def points_in_zones(points: DataFrame, zones: DataFrame, broadcast_rows: int = 300, cell: float = 0.25) -> DataFrame:
    """Pairs of points and the zone boxes that hold them (edges included). Few zones are broadcast; beyond the bound, zones
    and points meet by grid cell."""
    inside = X.point_in_bbox("longitude", "latitude", [F.col(k) for k in ("lon_min", "lat_min", "lon_max", "lat_max")])
    if zones.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return points.join(F.broadcast(zones), inside)
    steps = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    tiled = zones.withColumn("_cx", steps("lon_min", "lon_max")).withColumn("_cy", steps("lat_min", "lat_max"))
    located = points.withColumn("_cx", F.floor(F.col("longitude") / cell)).withColumn("_cy", F.floor(F.col("latitude") / cell))
    return located.join(tiled, ["_cx", "_cy"]).where(inside).drop("_cx", "_cy")


def interpolated(rows: DataFrame, lut: DataFrame, at: str = "px_row", bucket: int = 64) -> DataFrame:
    """Adds `sigma`, linear between the table's lines around each row and constant beyond the ends. The table (scene_id,
    line, sigma) becomes intervals; rows meet them by scene and bucket of lines, so a row is compared with the intervals of
    its bucket only."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("scene_id").orderBy("line")
    spans = lut.select("scene_id", F.col("line").alias("_l0"), F.col("sigma").alias("_s0"), F.lead("line").over(w).alias("_l1"), F.lead("sigma").over(w).alias("_s1"))
    last = F.greatest(F.floor(F.col("_l0") / bucket), F.floor((F.coalesce("_l1", F.col("_l0") + 1) - 1) / bucket))
    spans = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_l0") / bucket), last)))
    ends = lut.groupBy("scene_id").agg(F.min("line").alias("_lo"), F.max("line").alias("_hi"))
    x = F.col("_x")
    placed = rows.join(ends, "scene_id").withColumn("_x", F.least(F.greatest(F.col(at), "_lo"), "_hi")).withColumn("_bucket", F.floor(x / bucket))
    held = (x >= F.col("_l0")) & (F.col("_l1").isNull() | (x < F.col("_l1")))
    share = F.when(F.col("_l1").isNull(), F.lit(0.0)).otherwise((x - F.col("_l0")) / (F.col("_l1") - F.col("_l0")))
    out = placed.join(spans, ["scene_id", "_bucket"]).where(held)
    return out.withColumn("sigma", F.col("_s0") + share * (F.coalesce("_s1", "_s0") - F.col("_s0"))).drop("_l0", "_s0", "_l1", "_s1", "_lo", "_hi", "_x", "_bucket")


def lineage(runs: DataFrame, cues: DataFrame) -> DataFrame:
    """Each run with the cues that it raised and the cue that raised it."""
    up = cues.where("execution_id is not null").groupBy(F.col("execution_id").alias("id")).agg(F.min("id").alias("upstream_cue"))
    down = cues.groupBy(F.col("triggered_by").alias("id")).agg(F.count("*").alias("downstream_cues"))
    return runs.join(up, "id", "left").join(down, "id", "left").withColumn("downstream_cues", F.coalesce("downstream_cues", F.lit(0)))
