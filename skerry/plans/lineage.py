"""Provenance, tasking and text outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.functions import exprs as X
from skerry.operators import fixpoint
from skerry.operators import provenance as H
from skerry.operators import tasking as T
from skerry.sources import files

from .registry import query, statement

_ROW = "concat_ws('|', CAST(det_id AS VARCHAR), CAST(tile_index AS VARCHAR), source)"


@query(
    f"""WITH r AS (SELECT execution_id, sha256({_ROW}) AS h FROM fx_detections), b AS (SELECT execution_id, substr(h, 1, 2) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM r GROUP BY ALL)
    SELECT execution_id, sha256(string_agg(concat(b, h), ',' ORDER BY concat(b, h))) AS output_hash FROM b GROUP BY ALL""",
    "fx_detections",
)
def h1_result_hash(dets):
    return H.result_hash(dets, "execution_id", "det_id", "tile_index", "source")


@query("SELECT id, sha256(concat('model=', model_name, ';profile=', constraint_profile, ';version=', model_version)) AS params FROM fx_executions", "fx_executions")
def h2_params_hash(runs):
    params = F.create_map(F.lit("version"), "model_version", F.lit("model"), "model_name", F.lit("profile"), "constraint_profile")
    return runs.select("id", H.params_hash(params).alias("params"))


@query("SELECT det_id, sha256(concat(CAST(tile_index AS VARCHAR), ',', CAST(scene_id AS VARCHAR), '|2|int64')) AS h FROM fx_detections", "fx_detections")
def h3_array_hash(dets):
    return dets.select("det_id", H.array_hash(F.array(F.col("tile_index").cast("long"), F.col("scene_id").cast("long")), F.lit(2), F.lit("int64")).alias("h"))


@query("SELECT CASE WHEN a.id IS NULL THEN 'EXTRA' WHEN b.id IS NULL THEN 'MISSING' WHEN a.h = b.h THEN 'OK' ELSE 'MISMATCH' END AS verdict, count(*) AS n FROM (SELECT id, image_id AS h FROM fx_executions WHERE status <> 'pending') a FULL OUTER JOIN (SELECT id, CASE WHEN num_detections > 45 THEN 'x' ELSE image_id END AS h FROM fx_executions WHERE status <> 'error') b ON a.id = b.id GROUP BY 1", "fx_executions")
def h5_verify_bundle(runs):
    path = F.col("id").cast("string").alias("path")
    declared = runs.where("status <> 'pending'").select(path, H.sha(F.col("image_id")).alias("sha256"))
    found = runs.where("status <> 'error'").select(path, H.sha(F.when(F.col("num_detections") > 45, "x").otherwise(F.col("image_id"))).alias("sha256"))
    return H.compared(declared, found).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN num_detections % 2 = 0 THEN '***' ELSE concat('db://user:***@', image_id) END AS value FROM fx_executions", "fx_executions")
def h6_mask_secrets(runs):
    key = F.when(F.col("num_detections") % 2 == 0, "DB_PASSWORD").otherwise("DB_URL")
    return runs.select("id", X.masked(key, F.concat(F.lit("db://user:"), F.col("model_name"), F.lit("@"), F.col("image_id"))).alias("value"))


@query("SELECT DISTINCT m.model_id, c.card_name FROM fx_models m JOIN (SELECT DISTINCT name AS card_name, min(model_id) OVER (PARTITION BY name) AS first_id FROM fx_models) c ON m.name = c.card_name OR m.model_id = c.first_id + 1", "fx_models")
def h7_cards_for_models(models):
    hashed = models.withColumn("file_hash", F.sha2(F.col("model_id").cast("string").cast("binary"), 256))
    cards = models.groupBy(F.col("name").alias("card_name")).agg(F.concat(F.lit("made from "), F.sha2((F.min("model_id") + 1).cast("string").cast("binary"), 256)).alias("card_text"))
    return H.cards_for_models(hashed, cards).select("model_id", "card_name")


statement("h8_hash_completeness", "SELECT model_name, round(avg(CASE WHEN num_detections > 0 AND peak_ram_mb > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS complete FROM fx_executions GROUP BY model_name")


@query(
    """WITH k AS (SELECT execution_id, det_id, row_number() OVER (PARTITION BY execution_id ORDER BY confidence DESC, det_id) AS rn FROM fx_detections), b AS (SELECT execution_id, string_agg(CAST(det_id AS VARCHAR), ',' ORDER BY rn) AS best FROM k WHERE rn <= 3 GROUP BY 1)
    SELECT e.id, (SELECT min(c.id) FROM fx_cues c WHERE c.execution_id = e.id) AS upstream_cue, (SELECT count(*) FROM fx_cues c WHERE c.triggered_by = e.id) AS downstream_cues, b.best FROM fx_executions e LEFT JOIN b ON e.id = b.execution_id""",
    "fx_executions", "fx_detections", "fx_cues",
)
def h9_provenance_chain(runs, dets, cues):
    return H.provenance_chain(runs, dets, cues).select("id", "upstream_cue", "downstream_cues", "best")


@query("SELECT coalesce(a.name, b.name) AS name, coalesce(a.version, b.version) AS version, CASE WHEN b.name IS NULL THEN a.h ELSE b.h END AS size_mb FROM (SELECT name, version, max(size_mb) AS h FROM fx_models WHERE size_mb < 40 GROUP BY ALL) a FULL OUTER JOIN (SELECT name, version, max(size_mb) + 1 AS h FROM fx_models WHERE size_mb > 10 GROUP BY ALL) b ON a.name = b.name AND a.version = b.version", "fx_models")
def h10_upsert_models(models):
    one = lambda test, more: models.where(test).groupBy("name", "version").agg((F.max("size_mb") + more).alias("size_mb"), F.max("file_name").alias("file_hash"))
    return H.upsert_models(one("size_mb < 40", 0), one("size_mb > 10", 1)).select("name", "version", "size_mb")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN model_name ELSE concat(model_name, '-int8-static') END AS file, model_name AS base, CASE WHEN id % 2 = 0 THEN 'none' ELSE 'static_int8' END AS technique, CASE WHEN id % 3 = 0 THEN 'onnx' ELSE 'pytorch' END AS format FROM fx_executions", "fx_executions")
def h11_parse_model_name(runs):
    file = F.concat(F.col("model_name"), F.when(F.col("id") % 2 == 0, "").otherwise("-int8-static"))
    full = F.concat(file, F.when(F.col("id") % 3 == 0, ".onnx").otherwise(".pt"))
    return runs.select("id", file.alias("file"), H.parse_model_name(full).alias("m")).select("id", "file", "m.*")


@query("SELECT id, CASE WHEN num_detections > 40 THEN 'success' ELSE status END AS status, CASE WHEN num_detections > 40 OR status = 'success' THEN NULL ELSE concat('was ', status) END AS error_message FROM fx_executions", "fx_executions")
def h12_partial_update(runs):
    base = runs.select("id", "status", F.concat(F.lit("was "), F.col("status")).alias("error_message"))
    return H.partial_update(base, runs.where("num_detections > 40").select("id", F.lit("success").alias("status")))


_TIP = "SELECT d.execution_id, z.zone_id, count(*) AS n, avg(confidence) AS conf, max(z.priority) AS zp, min(longitude) - 0.05 AS lon_min, max(latitude) + 0.05 AS lat_max FROM fx_detections d JOIN fx_zones z ON d.longitude BETWEEN z.lon_min AND z.lon_max AND d.latitude BETWEEN z.lat_min AND z.lat_max WHERE NOT on_land AND NOT cluster_anomaly AND source IN ('yolo', 'fused') AND confidence >= 0.4 GROUP BY ALL HAVING count(*) >= 2"


@query(
    f"SELECT execution_id, zone_id, n, round(lon_min, 6) AS lon_min, round(lat_max, 6) AS lat_max, least(2, greatest(zp, CASE WHEN n >= 5 AND conf >= 0.85 THEN 2 WHEN n >= 3 OR conf >= 0.8 THEN 1 ELSE 0 END)) AS priority, concat(CASE WHEN conf >= 0.85 THEN 'high_confidence' ELSE 'moderate_confidence' END, '_in_', zone_id, CASE WHEN n >= 5 THEN '_cluster_detected' ELSE '' END) AS reason FROM ({_TIP}) t",
    "fx_detections", "fx_zones",
)
def t1_tips(dets, zones):
    return T.tips(dets, zones, 0.4).select("execution_id", "zone_id", "n", F.round("lon_min", 6).alias("lon_min"), F.round("lat_max", 6).alias("lat_max"), "priority", "reason")


@query(
    """WITH h AS (SELECT d.execution_id, z.zone_id, d.det_id, count(*) OVER (PARTITION BY d.execution_id, z.zone_id) AS n FROM fx_detections d JOIN fx_zones z ON d.longitude BETWEEN z.lon_min AND z.lon_max AND d.latitude BETWEEN z.lat_min AND z.lat_max
      WHERE NOT on_land AND NOT cluster_anomaly AND source IN ('yolo', 'fused') AND confidence >= 0.4) SELECT execution_id, zone_id, det_id FROM h WHERE n >= 2""",
    "fx_detections", "fx_zones",
)
def t1_tip_detections(dets, zones):
    return T.tip_detections(dets, zones, 0.4)


@query(
    """WITH RECURSIVE f AS (SELECT target_zone, created_at, min(id) AS id FROM fx_cues GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY target_zone ORDER BY created_at, id) AS rk FROM f),
    w AS (SELECT target_zone, id, rk, created_at AS last, TRUE AS keep FROM t WHERE rk = 1 UNION ALL SELECT t.target_zone, t.id, t.rk, CASE WHEN t.created_at >= w.last + INTERVAL 60 MINUTE THEN t.created_at ELSE w.last END, t.created_at >= w.last + INTERVAL 60 MINUTE FROM w JOIN t ON t.target_zone = w.target_zone AND t.rk = w.rk + 1)
    SELECT target_zone, id FROM w WHERE keep""",
    "fx_cues",
)
def t2_cooldown(cues):
    return T.cooldown(cues, "target_zone", 60)


@query("SELECT n.id FROM fx_cues n WHERE n.priority = 2 AND NOT EXISTS (SELECT 1 FROM fx_cues q WHERE q.status IN ('pending', 'processing') AND q.priority = 1 AND q.target_zone = n.target_zone AND n.created_at > q.created_at AND n.created_at < q.created_at + INTERVAL 10 MINUTE)", "fx_cues")
def t3_admit_cues(cues):
    return T.admit_cues(cues.where("priority = 2"), cues.where("priority = 1"), 10).select("id")


@query("SELECT id, CASE WHEN status <> 'processing' THEN status WHEN priority = 0 THEN 'completed' WHEN attempts >= max_attempts THEN 'failed' ELSE 'pending' END AS status, CASE WHEN status = 'processing' AND priority <> 0 AND attempts < max_attempts THEN TIMESTAMP '1998-01-01 00:15:00' END AS cooldown_until FROM fx_cues", "fx_cues")
def t4_finish_cues(cues):
    outcomes = cues.where("status = 'processing'").select("id", (F.col("priority") == 0).alias("ok"))
    return T.finish_cues(cues, outcomes, "1998-01-01 00:00:00").select("id", "status", "cooldown_until")


@query("SELECT id, CASE WHEN status = 'pending' AND created_at < TIMESTAMP '1997-01-01' - INTERVAL 30 MINUTE THEN 'failed' ELSE status END AS status, CASE WHEN status = 'pending' AND created_at < TIMESTAMP '1997-01-01' - INTERVAL 30 MINUTE THEN concat(CASE WHEN num_detections > 25 THEN 'slow | ' ELSE '' END, 'reaped: stuck in pending for >30 minutes') WHEN num_detections > 25 THEN 'slow' ELSE '' END AS error_message FROM fx_executions", "fx_executions")
def t5_reap_orphans(runs):
    noted = runs.withColumn("error_message", F.when(F.col("num_detections") > 25, "slow").otherwise(""))
    return T.reap_orphans(noted, "1997-01-01 00:00:00", 30).select("id", "status", "error_message")


@query(
    """WITH k AS (SELECT execution_id, confidence, row_number() OVER (PARTITION BY execution_id ORDER BY confidence DESC, det_id) AS rn FROM fx_detections), m AS (SELECT execution_id, avg(confidence) AS conf FROM k WHERE rn <= 12 GROUP BY 1),
    r AS (SELECT e.id, e.created_at, m.conf FROM fx_executions e LEFT JOIN m ON e.id = m.execution_id)
    SELECT c.id, CAST(epoch_us(b.created_at) - epoch_us(a.created_at) AS DOUBLE) / 1e6 AS gap_s, round(b.conf - a.conf, 6) AS uplift FROM fx_cues c JOIN r a ON c.triggered_by = a.id JOIN r b ON c.execution_id = b.id""",
    "fx_cues", "fx_executions", "fx_detections",
)
def t6_replay_chain(cues, runs, dets):
    return T.replay_chain(cues, runs, dets).select("id", "gap_s", F.round("uplift", 6).alias("uplift"))


@query("SELECT det_id, concat('{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[', CAST(tile_index AS VARCHAR), ',', CAST(execution_id AS VARCHAR), ']},\"properties\":{\"det_id\":', CAST(det_id AS VARCHAR), ',\"source\":\"', source, '\"}}') AS feature FROM fx_detections", "fx_detections")
def s6_geojson_features(dets):
    return files.features(dets.select("det_id", "source", F.col("tile_index").cast("long").alias("longitude"), F.col("execution_id").alias("latitude"), *[F.lit(None).cast("long").alias(k) for k in ("x_min", "y_min", "x_max", "y_max")]))


@query(
    """SELECT det_id, concat('{"type":"Feature","geometry":', CASE source WHEN 'cfar' THEN concat('{"type":"LineString","coordinates":[[0,0],[', CAST(tile_index AS VARCHAR), ',1]]}')
    WHEN 'yolo' THEN concat('{"type":"Point","coordinates":[', CAST(tile_index AS VARCHAR), ',', CAST(execution_id AS VARCHAR), ']}')
    ELSE concat('{"type":"Polygon","coordinates":[[[0,0],[', CAST(tile_index AS VARCHAR), ',0],[', CAST(tile_index AS VARCHAR), ',1],[0,1],[0,0]]]}') END,
    ',"properties":{"det_id":', CAST(det_id AS VARCHAR), ',"source":"', source, '","x_min":0,"y_min":0,"x_max":', CAST(tile_index AS VARCHAR), ',"y_max":1}}') AS feature FROM fx_detections""",
    "fx_detections",
)
def s6_geometry_first(dets):
    tile, source = F.col("tile_index").cast("long"), F.col("source")
    line = F.concat(F.lit('{"type":"LineString","coordinates":[[0,0],['), tile.cast("string"), F.lit(",1]]}"))
    geometry = F.when(source == "cfar", line).when(source == "yolo", F.lit(" "))
    centre = [F.when(source != "fused", c).alias(n) for c, n in ((tile, "longitude"), (F.col("execution_id").cast("long"), "latitude"))]
    box = [F.lit(0).cast("long").alias("x_min"), F.lit(0).cast("long").alias("y_min"), tile.alias("x_max"), F.lit(1).cast("long").alias("y_max")]
    return files.features(dets.select("det_id", "source", geometry.alias("geometry"), *centre, *box))


@query("SELECT scene_id AS item_id, round(min(longitude), 6) AS lon_min, round(max(latitude), 6) AS lat_max, 'ascending' AS orbit_state, max(created_at) AS datetime FROM fx_detections GROUP BY scene_id", "fx_detections")
def s8_stac_items(dets):
    scenes = dets.groupBy("scene_id").agg(F.min("longitude").alias("a"), F.min("latitude").alias("b"), F.max("longitude").alias("c"), F.max("latitude").alias("d"), F.max("created_at").alias("created_at"))
    rings = scenes.select("scene_id", X.bbox_to_ring([F.col(k) for k in "abcd"]).alias("ring"), F.lit("VV+VH").alias("polarisation"), F.lit("ASCENDING").alias("orbit_state"), F.lit(None).cast("timestamp_ntz").alias("sensed"), "created_at")
    return files.stac_items(rings).select("item_id", F.round(F.get("bbox", F.lit(0)), 6).alias("lon_min"), F.round(F.get("bbox", F.lit(3)), 6).alias("lat_max"), "orbit_state", "datetime")


@query("SELECT id, CASE WHEN status = 'pending' THEN 0 ELSE num_detections END AS num_detections FROM fx_executions", "fx_executions")
def s11_snapshot_rows(runs):
    """A new version of the table, written beside the old one and read."""
    changed = runs.where("status = 'pending'").withColumn("num_detections", F.lit(0))
    return files.write_snapshot(runs, changed, ["id"], fixpoint.folder(runs.sparkSession)).select("id", "num_detections")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN CAST(num_detections AS DOUBLE) END AS lon_min, id % 2 = 0 AS valid FROM fx_executions", "fx_executions")
def c1_parse_bbox(runs):
    n = F.col("num_detections").cast("string")
    text = F.when(F.col("id") % 2 == 0, F.concat(n, F.lit(", 1.5,"), n, F.lit(",2"))).otherwise(F.lit("x,1,2"))
    return runs.select("id", X.parse_bbox(text).alias("b")).select("id", "b.lon_min", "b.valid")


@query("SELECT id, CASE id % 3 WHEN 0 THEN created_at WHEN 1 THEN NULL ELSE created_at END AS begin_at, CASE id % 3 WHEN 2 THEN NULL ELSE created_at END AS end_at FROM fx_executions", "fx_executions")
def c2_parse_interval(runs):
    at = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("id") % 3 == 0, at).when(F.col("id") % 3 == 1, F.concat(F.lit("../"), at)).otherwise(F.concat(at, F.lit("/..")))
    return runs.select("id", X.parse_interval(text).alias("i")).select("id", F.col("i.begin").cast("timestamp_ntz").alias("begin_at"), F.col("i.finish").cast("timestamp_ntz").alias("end_at"))


@query("SELECT det_id, concat('{\"type\":\"Feature\",\"id\":', CAST(det_id AS VARCHAR), ',\"geometry\":{\"type\":\"Point\",\"coordinates\":[', CAST(tile_index AS VARCHAR), ',', CAST(execution_id AS VARCHAR), ']},\"properties\":{\"source\":\"', source, '\"}}') AS feature FROM fx_detections", "fx_detections")
def s7_ogc_features(dets):
    placed = dets.select("det_id", "source", F.col("tile_index").cast("long").alias("longitude"), F.col("execution_id").alias("latitude"), *[F.lit(None).cast("long").alias(k) for k in ("x_min", "y_min", "x_max", "y_max")])
    return files.ogc_features(placed, ("source",))


@query(
    """SELECT CAST(id AS VARCHAR) AS id, created_at, image_id, concat('{"type":"Point","coordinates":[', CAST(id AS VARCHAR), ',1]}') AS image_bbox_geojson, CASE WHEN id % 2 = 0 THEN 'west' END AS search_zone, model_name, model_version,
    model_size_mb, compression_technique, constraint_profile, num_detections, round(avg_confidence, 2) AS avg_confidence, peak_ram_mb, status, CASE WHEN id % 3 = 0 THEN 'said "no", twice' END AS hostname FROM fx_executions""",
    "fx_executions",
)
def s1_executions_round_trip(runs):
    """All columns of an exported run, with quoted cells and empty ones, written as CSV and read again."""
    given = runs.withColumns({
        "id": F.col("id").cast("string"), "image_bbox_geojson": F.to_json(files.point_geometry(F.col("id"), F.lit(1).cast("long"))),
        "search_zone": F.when(F.col("id") % 2 == 0, "west"), "hostname": F.when(F.col("id") % 3 == 0, 'said "no", twice'),
    })
    kinds = dict(c.split() for c in files.EXECUTIONS.split(", "))
    path = fixpoint.folder(runs.sparkSession)
    files.write_csv(given.select(*[F.col(n) if n in given.columns else F.lit(None).cast(k).alias(n) for n, k in kinds.items()]), path)
    back = files.read_executions_csv(runs.sparkSession, path)
    kept = ["id", "created_at", "image_id", "image_bbox_geojson", "search_zone", "model_name", "model_version", "model_size_mb", "compression_technique", "constraint_profile", "num_detections"]
    return back.select(*kept, F.round("avg_confidence", 2).alias("avg_confidence"), "peak_ram_mb", "status", "hostname")


@query(
    """SELECT concat('/scenes/', CAST(scene_id AS VARCHAR)) AS image_path, CAST(scene_id AS DOUBLE) + 0.5 AS scene_area_km2, x_min, y_min, x_max, y_max, gt_id % 2 = 0 AS is_vessel, count(*) AS n FROM fx_ground_truth GROUP BY ALL""",
    "fx_ground_truth",
)
def s4_manifest_round_trip(truths):
    """Lists of scenes with their boxes, written as JSON files and read again."""
    path, spark = fixpoint.folder(truths.sparkSession), truths.sparkSession
    labels = truths.withColumns({"is_vessel": F.col("gt_id") % 2 == 0, "confidence": F.lit("HIGH")})
    scenes = truths.select("scene_id").distinct().select("scene_id", F.concat(F.lit("/scenes/"), F.col("scene_id").cast("string")).alias("image_path"), (F.col("scene_id") + F.lit(0.5)).alias("scene_area_km2"))
    files.write_manifest(labels, scenes, path)
    boxes, faulty = files.read_manifest(spark, path)
    key = ["image_path", "scene_area_km2", "x_min", "y_min", "x_max", "y_max", "is_vessel"]
    return boxes.join(faulty.select("image_path").distinct(), "image_path", "left_anti").groupBy(*key).agg(F.count("*").alias("n"))


@query(
    """SELECT d.det_id, d.execution_id, e.image_id, e.model_name, e.constraint_profile, e.status, e.created_at AS run_created_at, e.num_detections FROM fx_detections d JOIN fx_executions e ON d.execution_id = e.id""",
    "fx_detections", "fx_executions",
)
def h9_detection_provenance(dets, runs):
    out = H.detection_provenance(dets, runs)
    return out.select("det_id", "execution_id", "image_id", "model_name", "constraint_profile", "status", "run_created_at", "num_detections")


@query(
    """SELECT d.det_id, CAST(d.det_id AS VARCHAR) AS detection_id, e.image_id AS scene_id, e.model_name, e.constraint_profile, d.source, d.on_land, d.quality_verdict, d.execution_id FROM fx_detections d JOIN fx_executions e ON d.execution_id = e.id""",
    "fx_detections", "fx_executions",
)
def s7_provenance_properties(dets, runs):
    """The properties of each feature, read back from its JSON."""
    made = files.ogc_features(files.provenance_properties(dets, runs))
    read = F.from_json(F.get_json_object("feature", "$.properties"), "detection_id string, scene_id string, model_name string, constraint_profile string, source string, on_land boolean, quality_verdict string, execution_id long")
    return made.select("det_id", read.alias("p")).select("det_id", "p.*")


_ZONED = "CASE priority WHEN 0 THEN 'strait' WHEN 1 THEN '' ELSE target_zone END"


@query(f"SELECT id, CASE priority WHEN 0 THEN 'west' WHEN 1 THEN 'gibraltar' ELSE target_zone END AS search_zone FROM (SELECT id, priority, target_zone FROM fx_cues) c", "fx_cues", "fx_zones")
def t7_resolve_search_zone(cues, zones):
    return T.resolve_search_zone(cues.withColumn("target_zone", F.expr(_ZONED)), zones).select("id", "search_zone")


@query("SELECT id, created_at, status, target_zone, CAST(id % 4 AS INT) AS triggering_count FROM fx_cues ORDER BY created_at DESC, id LIMIT 50", "fx_cues")
def t7_replays(cues):
    ids = F.when(F.col("id") % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), F.col("id") % 4))
    return T.replays(cues.withColumn("triggering_detections", ids)).select("id", "created_at", "status", "target_zone", "triggering_count")
