"""Filters, joins, projections and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions import exprs as X
from skerry.operators import relations as R
from skerry.operators import runs as A
from skerry.operators import tasking as T

from .registry import query, statement

AREA = (-5.8, 35.6, -5.2, 36.2)
_IN_AREA = "longitude BETWEEN -5.8 AND -5.2 AND latitude BETWEEN 35.6 AND 36.2"
RING = [(-5.9003, 35.6007), (-5.2009, 35.7001), (-5.1003, 36.2007), (-5.8001, 36.1003)]
_SIDES = [f"(({x1} - ({x0})) * (latitude - {y0}) - ({y1} - {y0}) * (longitude - ({x0})))" for (x0, y0), (x1, y1) in zip(RING, [*RING[1:], RING[0]], strict=True)]


@query(
    f"SELECT d.det_id, d.execution_id, d.confidence, d.source, d.longitude, d.latitude, e.constraint_profile, e.model_name, e.model_version, e.image_id FROM fx_detections d JOIN fx_executions e ON d.execution_id = e.id WHERE e.status = 'success' AND d.confidence >= 0.5 AND {_IN_AREA} AND d.on_land = FALSE",
    "fx_detections", "fx_executions",
)
def f1_search_detections(dets: DataFrame, runs: DataFrame) -> DataFrame:
    return R.search_detections(dets, runs, min_conf=0.5, bbox=AREA, on_land=False).select("det_id", "execution_id", "confidence", "source", "longitude", "latitude", "constraint_profile", "model_name", "model_version", "image_id")


@query(f"SELECT count(*) AS n FROM fx_detections d JOIN fx_executions e ON d.execution_id = e.id WHERE e.status = 'success' AND d.confidence >= 0.5 AND {_IN_AREA} AND d.on_land = FALSE", "fx_detections", "fx_executions")
def f2_count_detections(dets: DataFrame, runs: DataFrame) -> DataFrame:
    return R.search_detections(dets, runs, min_conf=0.5, bbox=AREA, on_land=False).agg(F.count("*").alias("n"))


@query("SELECT id, created_at, status, model_name, count(*) OVER () AS matched FROM fx_executions WHERE constraint_profile = 'sat-mid' AND status = 'success' ORDER BY created_at DESC, id LIMIT 50 OFFSET 10", "fx_executions")
def f3_search_executions(runs: DataFrame) -> DataFrame:
    found = R.search_executions(runs, profile="sat-mid", status="success")
    total = found.agg(F.count("*").alias("matched"))
    return R.page(found, [F.desc_nulls_last("created_at"), F.col("id")], 50, 10).select("id", "created_at", "status", "model_name").crossJoin(F.broadcast(total))


@query(
    """SELECT d.det_id, d.confidence, e.model_name FROM fx_detections d JOIN fx_executions e ON d.execution_id = e.id
    WHERE e.status = 'success' AND d.quality_verdict = 'valid_sea_target' AND d.created_at >= TIMESTAMP '1995-01-01' ORDER BY d.confidence DESC, d.det_id LIMIT 100 OFFSET 20""",
    "fx_detections", "fx_executions",
)
def f1_search_page(dets: DataFrame, runs: DataFrame) -> DataFrame:
    return R.search_detections(dets, runs, verdict="valid_sea_target", since="1995-01-01", limit=100, offset=20).select("det_id", "confidence", "model_name")


@query(
    f"""SELECT d.det_id, e.created_at AS sensed, d.longitude, d.latitude FROM fx_detections d JOIN fx_executions e ON d.execution_id = e.id
    WHERE {_IN_AREA} AND e.created_at >= TIMESTAMP '1995-01-01' AND e.created_at <= TIMESTAMP '1997-12-31'""",
    "fx_detections", "fx_executions",
)
def f4_ogc_items(dets: DataFrame, runs: DataFrame) -> DataFrame:
    return R.ogc_items(dets, runs, AREA, "1995-01-01", "1997-12-31").select("det_id", "sensed", "longitude", "latitude")


_FOOT = "SELECT scene_id, min(longitude) AS lon0, min(latitude) AS lat0, max(longitude) AS lon1, max(latitude) AS lat1, min(created_at) AS sensed FROM fx_detections GROUP BY scene_id"


def footprints(dets: DataFrame) -> DataFrame:
    return dets.groupBy("scene_id").agg(F.min("longitude").alias("lon0"), F.min("latitude").alias("lat0"), F.max("longitude").alias("lon1"), F.max("latitude").alias("lat1"), F.min("created_at").alias("sensed"))


def ring_of(lon0="lon0", lat0="lat0", lon1="lon1", lat1="lat1"):
    x0, y0, x1, y1 = map(F.col, (lon0, lat0, lon1, lat1))
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


@query(f"SELECT scene_id, sensed FROM ({_FOOT}) f WHERE lon1 >= -5.8 AND lon0 <= -5.2 AND lat1 >= 35.6 AND lat0 <= 36.2 ORDER BY sensed DESC NULLS LAST, scene_id", "fx_detections")
def f5_stac_search(dets: DataFrame) -> DataFrame:
    return R.stac_search(footprints(dets), ring_of(), AREA).select("scene_id", "sensed")


@query(
    f"""SELECT scene_id, sensed FROM ({_FOOT}) f WHERE lon1 >= -5.8 AND lon0 <= -5.2 AND lat1 >= 35.6 AND lat0 <= 36.2
    AND sensed > TIMESTAMP '1992-01-04' AND sensed < TIMESTAMP '1996-01-12' AND scene_id % 2 = 1 AND scene_id % 50 < 20 ORDER BY sensed DESC, scene_id LIMIT 20""",
    "fx_detections",
)
def f6_catalogue_search(dets: DataFrame) -> DataFrame:
    scenes = footprints(dets).withColumns({"sensor": F.when(F.col("scene_id") % 2 == 0, "s1").otherwise("s2"), "cloud_pct": (F.col("scene_id") % 50).cast("double")})
    return R.catalogue_search(scenes, ring_of(), AREA, "1992-01-04", "1996-01-12", "s2", 20).select("scene_id", "sensed")


@query("SELECT run_id, model_name, dataset, pd, map FROM fx_validation WHERE model_name = 'alpha' AND compression_technique = 'none' ORDER BY run_id DESC", "fx_validation")
def f7_validation_runs(runs: DataFrame) -> DataFrame:
    return R.validation_runs(runs, model="alpha", technique="none").select("run_id", "model_name", "dataset", "pd", "map")


@query(
    "SELECT id, created_at, image_id FROM fx_executions WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1997-06-30' AND id % 3 = 0 AND constraint_profile = 'sat-mid'",
    "fx_executions",
)
def f8_bundle_executions(runs: DataFrame) -> DataFrame:
    zoned = runs.withColumn("search_zone", F.when(F.col("id") % 3 == 0, "west").otherwise("central"))
    return R.bundle_executions(zoned, "1996-01-01", "1997-06-30", zone="west", profile="sat-mid").select("id", "created_at", "image_id")


@query(
    "SELECT e.id AS run_id, d.det_id FROM fx_detections d JOIN fx_executions e ON d.execution_id = e.id WHERE e.created_at >= TIMESTAMP '1996-01-01' AND e.model_name = 'beta'",
    "fx_detections", "fx_executions",
)
def f8_bundle_detections(dets: DataFrame, runs: DataFrame) -> DataFrame:
    return R.bundle_detections(dets, R.bundle_executions(runs, "1996-01-01", model="beta")).select(F.col("execution_id").alias("run_id"), "det_id")


@query("SELECT id, target_zone, priority, created_at FROM fx_cues WHERE status = 'pending' ORDER BY priority DESC, created_at, id", "fx_cues")
def f9_queue(cues: DataFrame) -> DataFrame:
    return R.queue(cues).select("id", "target_zone", "priority", "created_at")


@query("SELECT o.off AS \"offset\", m.matched, CASE WHEN o.off > 0 THEN greatest(0, o.off - 100) END AS prev_offset, CASE WHEN o.off + 100 < m.matched THEN o.off + 100 END AS next_offset FROM (SELECT unnest([0, 50, 100, 1000, 100000000]) AS off) o, (SELECT count(*) AS matched FROM fx_executions) m", "fx_executions")
def f10_prev_next_offsets(runs: DataFrame) -> DataFrame:
    total = runs.agg(F.count("*").alias("matched"))
    return R.paging(total.select("matched", F.explode(F.array(*map(F.lit, (0, 50, 100, 1000, 100_000_000)))).alias("offset")), 100)


@query(f"SELECT det_id FROM fx_detections WHERE {_IN_AREA}", "fx_detections")
def p1_point_in_bbox(dets: DataFrame) -> DataFrame:
    return dets.where(X.point_in_bbox("longitude", "latitude", AREA)).select("det_id")


@query("SELECT det_id FROM fx_detections WHERE " + " AND ".join(f"{s} > 0.002 * sqrt(({x1} - ({x0})) * ({x1} - ({x0})) + ({y1} - {y0}) * ({y1} - {y0}))" for s, ((x0, y0), (x1, y1)) in zip(_SIDES, zip(RING, [*RING[1:], RING[0]], strict=True), strict=True)), "fx_detections")
def p2_point_in_convex_polygon(dets: DataFrame) -> DataFrame:
    return dets.where(X.point_in_convex_polygon("longitude", "latitude", RING, 0.002)).select("det_id")


@query(f"SELECT scene_id FROM ({_FOOT}) f WHERE lon1 >= -5.3 AND lon0 <= -5.0 AND lat1 >= 36.0 AND lat0 <= 36.1", "fx_detections")
def p3_polygon_meets_envelope(dets: DataFrame) -> DataFrame:
    return footprints(dets).where(X.polygon_meets_envelope(ring_of(), (-5.3, 36.0, -5.0, 36.1))).select("scene_id")


@query("SELECT det_id, CASE WHEN source = 'cfar' AND on_land THEN NULL WHEN source = 'yolo' AND on_land THEN NULL ELSE round(confidence, 6) END AS snr FROM fx_detections", "fx_detections")
def p4_finite_or_null(dets: DataFrame) -> DataFrame:
    raw = F.when((F.col("source") == "cfar") & F.col("on_land"), F.lit(float("inf"))).when((F.col("source") == "yolo") & F.col("on_land"), F.lit(float("nan"))).otherwise(F.col("confidence"))
    return dets.select("det_id", F.round(X.finite_or_null(raw), 6).alias("snr"))


@query("SELECT det_id, CASE WHEN NOT (" + " AND ".join(f"{s} >= 0" for s in _SIDES) + ") THEN 'outside_footprint' WHEN on_land THEN 'land_artifact' WHEN cluster_anomaly THEN 'cluster_artifact' WHEN source IN ('yolo', 'fused') THEN 'valid_sea_target' ELSE 'candidate' END AS verdict FROM fx_detections", "fx_detections")
def p5_quality_verdict(dets: DataFrame) -> DataFrame:
    return dets.select("det_id", X.quality_verdict(~X.point_in_convex_polygon("longitude", "latitude", RING)).alias("verdict"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'dynamic_int8' ELSE compression_technique END AS technique FROM fx_executions", "fx_executions")
def p6_normalize_technique(runs: DataFrame) -> DataFrame:
    odd = runs.withColumn("compression_technique", F.when(F.col("id") % 2 == 0, "int8_dynamic").otherwise(F.col("compression_technique")))
    return A.normalize_technique(odd).select("id", F.col("compression_technique").alias("technique"))


@query(
    "SELECT id, CASE WHEN status = 'success' AND id % 2 = 0 THEN NULL WHEN id % 2 = 0 THEN 'Reaped: stuck' WHEN id % 3 = 0 THEN 'late' END AS error_message FROM fx_executions",
    "fx_executions",
)
def p6_clear_reaped_errors(runs: DataFrame) -> DataFrame:
    noted = runs.withColumn("error_message", F.when(F.col("id") % 2 == 0, "Reaped: stuck").when(F.col("id") % 3 == 0, "late"))
    return A.clear_reaped_errors(noted).select("id", "error_message")


@query(
    """SELECT id, CASE WHEN r THEN 'pending' ELSE status END AS status, CASE WHEN r THEN 0 ELSE attempts END AS attempts, CASE WHEN NOT r THEN last_error END AS last_error, CASE WHEN NOT r THEN execution_id END AS execution_id
    FROM (SELECT *, status IN ('failed', 'pending') AND target_zone IN ('zone-1', 'zone-2') AND coalesce(last_error = 'unknown search zone: x', FALSE) AS r
          FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 'unknown search zone: x' WHEN id % 3 = 0 THEN 'timeout' END AS last_error FROM fx_cues) c) t""",
    "fx_cues",
)
def p6_reset_mapping_failures(cues: DataFrame) -> DataFrame:
    noted = cues.withColumn("last_error", F.when(F.col("id") % 2 == 0, "unknown search zone: x").when(F.col("id") % 3 == 0, "timeout"))
    return T.reset_mapping_failures(noted, ("zone-1", "zone-2")).select("id", "status", "attempts", "last_error", "execution_id")


@query("SELECT scene_id, CASE WHEN n < 50 THEN 'few_detections' ELSE '' END AS reasons, CASE WHEN n < 50 THEN 'invalid' ELSE 'valid' END AS scene_status FROM (SELECT scene_id, count(*) AS n FROM fx_detections GROUP BY scene_id) s", "fx_detections")
def p7_scene_quality(dets: DataFrame) -> DataFrame:
    scenes = dets.groupBy("scene_id").agg(F.count("*").alias("n"))
    return R.scene_quality(scenes, {"few_detections": F.col("n") >= 50}).select("scene_id", F.array_join("missing", ",").alias("reasons"), "scene_status")


@query("SELECT d.det_id FROM fx_detections d JOIN (SELECT scene_id, max(x_max) AS n_cols, max(y_max) AS n_rows FROM fx_detections GROUP BY scene_id) s ON d.scene_id = s.scene_id WHERE (x_min + x_max) / 2 BETWEEN 40 AND n_cols - 40 AND (y_min + y_max) / 2 BETWEEN 40 AND n_rows - 40", "fx_detections")
def p8_edge_swath_filter(dets: DataFrame) -> DataFrame:
    scenes = dets.groupBy("scene_id").agg(F.max("x_max").alias("n_cols"), F.max("y_max").alias("n_rows"))
    return R.edge_swath_filter(dets, scenes, 40).select("det_id")


@query("SELECT det_id FROM (SELECT det_id, count(*) OVER (PARTITION BY scene_id, round(longitude, 3)) AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM fx_detections) t WHERE NOT (n > 15 AND k >= 8)", "fx_detections")
def p9_column_density_filter(dets: DataFrame) -> DataFrame:
    return R.column_density_filter(dets).select("det_id")


@query("SELECT DISTINCT model_name, model_name LIKE 'cfar%' OR model_name = 'alpha' AS approved FROM fx_executions", "fx_executions")
def p10_approved_for_sar(runs: DataFrame) -> DataFrame:
    classes = F.when(F.col("model_name") == "alpha", F.array(F.lit(" Ship "), F.lit("plane"))).otherwise(F.array(F.lit("tree")))
    return runs.select("model_name", X.approved_for_sar("model_name", classes).alias("approved")).distinct()


statement("j1_inner_join", "SELECT d.det_id, e.model_name, e.status FROM fx_detections d JOIN fx_executions e ON d.execution_id = e.id")
statement("j2_left_join_count", "SELECT e.id, count(d.det_id) AS n FROM fx_executions e LEFT JOIN fx_detections d ON d.execution_id = e.id AND d.confidence >= 0.9 GROUP BY e.id")


@query("SELECT id FROM fx_executions WHERE id IN (SELECT execution_id FROM fx_detections WHERE source = 'fused')", "fx_executions", "fx_detections")
def j3_semi_join(runs: DataFrame, dets: DataFrame) -> DataFrame:
    return runs.join(dets.where("source = 'fused'").select(F.col("execution_id").alias("id")), "id", "left_semi").select("id")


@query("SELECT id FROM fx_executions WHERE id NOT IN (SELECT execution_id FROM fx_detections WHERE source = 'fused')", "fx_executions", "fx_detections")
def j4_anti_join(runs: DataFrame, dets: DataFrame) -> DataFrame:
    return runs.join(dets.where("source = 'fused'").select(F.col("execution_id").alias("id")), "id", "left_anti").select("id")


statement(
    "j5_full_outer",
    "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'EXTRA' WHEN b.id IS NULL THEN 'MISSING' WHEN a.h = b.h THEN 'OK' ELSE 'MISMATCH' END AS verdict FROM (SELECT id, num_detections AS h FROM fx_executions WHERE status <> 'pending') a FULL OUTER JOIN (SELECT id, num_detections + CASE WHEN cpu_usage_pct > 390 THEN 1 ELSE 0 END AS h FROM fx_executions WHERE status <> 'error') b ON a.id = b.id",
)
statement("j6_cross_small_dims", "SELECT p.profile, l.link, count(*) AS runs, round(sum(e.image_size_mb * 8 / l.mbps) / 3600, 4) AS hours FROM fx_executions e JOIN fx_profiles p ON e.constraint_profile = p.profile CROSS JOIN fx_links l GROUP BY p.profile, l.link")


@query("SELECT z.zone_id, d.det_id FROM fx_detections d JOIN fx_zones z ON d.longitude BETWEEN z.lon_min AND z.lon_max AND d.latitude BETWEEN z.lat_min AND z.lat_max", "fx_detections", "fx_zones")
def j7_points_in_zones(dets: DataFrame, zones: DataFrame) -> DataFrame:
    return R.points_in_zones(dets.select("det_id", "longitude", "latitude"), zones).select("zone_id", "det_id")


@query("SELECT d.det_id, m.cell_x IS NOT NULL AS mask_on_land FROM fx_detections d LEFT JOIN fx_land m ON m.cell_x = CAST(floor(d.longitude / CAST(0.05 AS DOUBLE)) AS INT) AND m.cell_y = CAST(floor(d.latitude / CAST(0.05 AS DOUBLE)) AS INT)", "fx_detections", "fx_land")
def j10_land_lookup(dets: DataFrame, mask: DataFrame) -> DataFrame:
    return R.land_lookup(dets, mask).select("det_id", "mask_on_land")


@query(
    "SELECT e.id, (SELECT min(c.id) FROM fx_cues c WHERE c.execution_id = e.id) AS upstream_cue, (SELECT count(*) FROM fx_cues c WHERE c.triggered_by = e.id) AS downstream_cues FROM fx_executions e", "fx_executions", "fx_cues",
)
def j11_lineage(runs: DataFrame, cues: DataFrame) -> DataFrame:
    return R.lineage(runs, cues).select("id", "upstream_cue", "downstream_cues")


statement("u1_union_all", "SELECT 'with' AS scenario, constraint_profile, count(*) AS n FROM fx_executions WHERE num_detections > 0 GROUP BY constraint_profile UNION ALL SELECT 'without' AS scenario, constraint_profile, count(*) AS n FROM fx_executions WHERE num_detections = 0 GROUP BY constraint_profile")


@query("SELECT image_id FROM fx_executions WHERE status = 'success' EXCEPT SELECT image_id FROM fx_executions WHERE status = 'error' AND num_detections > 48", "fx_executions")
def u2_set_difference(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'success'").select("image_id").distinct().subtract(runs.where("status = 'error' and num_detections > 48").select("image_id"))


@query("SELECT scene_id, tile_index FROM fx_detections WHERE source = 'cfar' UNION SELECT scene_id, tile_index FROM fx_detections WHERE source = 'yolo'", "fx_detections")
def u3_tile_union(dets: DataFrame) -> DataFrame:
    keys = dets.where("source = 'cfar'").select("scene_id", "tile_index")
    return keys.union(dets.where("source = 'yolo'").select("scene_id", "tile_index")).distinct()


statement("u4_distinct_counts", "SELECT constraint_profile, count(DISTINCT image_id) AS images, count(DISTINCT model_name) AS models FROM fx_executions GROUP BY constraint_profile")

statement("c1_bbox_parts", "SELECT det_id, CAST(x_min AS DOUBLE) AS lon_min, x_min <= x_max AND y_min <= y_max AS valid FROM fx_detections")


@query("SELECT det_id, round(1 - exp(-confidence), 6) AS conf FROM fx_detections", "fx_detections")
def c5_snr_to_confidence(dets: DataFrame) -> DataFrame:
    return dets.select("det_id", F.round(X.snr_to_confidence(F.col("confidence") * 10), 6).alias("conf"))


@query("SELECT id, CASE WHEN cpu_usage_pct * 100 < 60 THEN concat(CAST(CAST(floor(cpu_usage_pct * 100) AS INT) AS VARCHAR), ' s') WHEN cpu_usage_pct * 100 < 3600 THEN concat(CAST(CAST(floor(cpu_usage_pct * 100 / 60) AS INT) AS VARCHAR), ' min') ELSE concat(CAST(CAST(floor(cpu_usage_pct * 100 / 3600) AS INT) AS VARCHAR), ' h') END AS gap FROM fx_executions", "fx_executions")
def c6_human_gap(runs: DataFrame) -> DataFrame:
    return runs.select("id", X.human_gap(F.col("cpu_usage_pct") * 100).alias("gap"))


@query("SELECT id, CASE status WHEN 'error' THEN 'timeout' WHEN 'pending' THEN 'oom' END AS kind FROM fx_executions", "fx_executions")
def c7_error_class(runs: DataFrame) -> DataFrame:
    message = F.when(F.col("status") == "error", "TimeoutError: preprocessing").when(F.col("status") == "pending", "MemoryError()")
    return runs.select("id", X.error_class(message).alias("kind"))


@query("SELECT det_id, CASE WHEN longitude BETWEEN -5.6 AND -5.3 AND latitude BETWEEN 35.8 AND 36.1 THEN 'strait' WHEN longitude BETWEEN -6 AND -5 AND latitude BETWEEN 35.5 AND 36 THEN 'south' ELSE 'other' END AS aoi FROM fx_detections", "fx_detections")
def c4_aoi_label(dets: DataFrame) -> DataFrame:
    return dets.select("det_id", X.labelled_box("longitude", "latitude", [("strait", (-5.6, 35.8, -5.3, 36.1)), ("south", (-6, 35.5, -5, 36))]).alias("aoi"))


@query("SELECT det_id, x_min AS lon_min, y_min AS lat_min, x_max AS lon_max, y_max AS lat_max FROM fx_detections", "fx_detections")
def c3_ring_round_trip(dets: DataFrame) -> DataFrame:
    ring = X.bbox_to_ring([F.col(k) for k in ("x_min", "y_min", "x_max", "y_max")])
    return dets.select("det_id", X.ring_to_bbox(ring).alias("b")).select("det_id", "b.*")
