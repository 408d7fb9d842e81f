"""Bundles, crops, ledgers, rings and replay records."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.functions import exprs as X
from skerry.operators import boxes as B
from skerry.operators import bundle, fixpoint
from skerry.operators import provenance as H
from skerry.operators import raster as P
from skerry.operators import relations as L
from skerry.operators import runs as R
from skerry.operators import tasking as T

from .registry import query

_RUNS = "(SELECT * FROM fx_executions WHERE model_name = 'alpha' AND constraint_profile = 'ground' AND created_at >= TIMESTAMP '1995-01-01')"


@query(
    f"""SELECT (SELECT count(*) FROM {_RUNS} r) AS executions, (SELECT count(*) FROM fx_detections d WHERE d.execution_id IN (SELECT id FROM {_RUNS} r)) AS detections,
    CAST(1 AS BIGINT) AS models, CAST(0 AS BIGINT) AS n_bad, TRUE AS root_ok, 'PASS' AS verdict""",
    "fx_executions", "fx_detections",
)
def h4_evidence_bundle(runs, dets):
    """Written, read back and verified; of three cards one belongs to the model."""
    spark, folder = runs.sparkSession, fixpoint.folder(runs.sparkSession) + "/bundle"
    settings = spark.createDataFrame([("DB_PASSWORD", "x"), ("ZONE", "west")], "key string, value string")
    cards = runs.select(F.col("model_name").alias("card_name")).distinct().withColumn("card_text", F.concat(F.lit("card of "), "card_name"))
    root = bundle.write_bundle(spark, runs, dets, settings, cards, folder, "2024-01-01T00:00:00Z", since="1995-01-01", model="alpha", profile="ground")
    summary = bundle.verify_bundle(spark, folder)[1]
    counts = root.select(*[F.col("counts")[k].alias(k) for k in ("executions", "detections", "models")])
    return counts.crossJoin(F.broadcast(summary)).select("executions", "detections", "models", (F.col("n_mismatch") + F.col("n_missing") + F.col("n_extra")).alias("n_bad"), "root_ok", "verdict")


@query(
    """WITH f AS (SELECT concat('scene-', CAST(scene_id AS VARCHAR)) AS path, count(*) AS length, sha256(string_agg(CAST(det_id AS VARCHAR), ',' ORDER BY det_id)) AS sha256 FROM fx_detections GROUP BY scene_id),
    l AS (SELECT sha256(concat_ws('|', path, CAST(length AS VARCHAR), sha256)) AS h FROM f), b AS (SELECT substr(h, 1, 2) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM l GROUP BY 1)
    SELECT sha256(string_agg(concat(b, h), ',' ORDER BY concat(b, h))) AS root FROM b""",
    "fx_detections",
)
def h5_manifest_root(dets):
    """The root over one file for each scene."""
    listed = dets.groupBy("scene_id").agg(F.count("*").alias("length"), H.sha(F.array_join(F.transform(F.array_sort(F.collect_list("det_id")), lambda i: i.cast("string")), ",")).alias("sha256"))
    return bundle.manifest_root(listed.select(F.concat(F.lit("scene-"), F.col("scene_id").cast("string")).alias("path"), "length", "sha256"))


_CORNERS = [(x, y) for x in ("lon_min", "lon_max") for y in ("lat_min", "lat_max")]
_COLS = ", ".join(f"(f2 * ({x} - c0) - c2 * ({y} - f0)) / det" for x, y in _CORNERS)
_ROWS = ", ".join(f"(c1 * ({y} - f0) - f1 * ({x} - c0)) / det" for x, y in _CORNERS)


@query(
    f"""WITH a AS (SELECT scene_id, min(longitude) + 0.1 * (scene_id % 9) AS lon_min, min(latitude) AS lat_min, max(longitude) + 0.1 * (scene_id % 9) AS lon_max, max(latitude) - 0.05 AS lat_max FROM fx_detections GROUP BY scene_id),
    d AS (SELECT a.*, t.* EXCLUDE (scene_id), c1 * f2 - c2 * f1 AS det FROM a JOIN fx_transforms t ON a.scene_id = t.scene_id),
    w AS (SELECT *, greatest(0, CAST(trunc(least({_COLS})) AS BIGINT)) AS x0, least(n_cols, CAST(trunc(greatest({_COLS})) AS BIGINT) + 1) AS x1, greatest(0, CAST(trunc(least({_ROWS})) AS BIGINT)) AS y0, least(n_rows, CAST(trunc(greatest({_ROWS})) AS BIGINT) + 1) AS y1 FROM d),
    v AS (SELECT scene_id, x0 < x1 AND y0 < y1 AS crops, c0, c1, c2, f0, f1, f2, CASE WHEN x0 < x1 AND y0 < y1 THEN x0 ELSE 0 END AS col_start, CASE WHEN x0 < x1 AND y0 < y1 THEN x1 ELSE n_cols END AS col_end,
      CASE WHEN x0 < x1 AND y0 < y1 THEN y0 ELSE 0 END AS row_start, CASE WHEN x0 < x1 AND y0 < y1 THEN y1 ELSE n_rows END AS row_end FROM w)
    SELECT scene_id, crops, col_start, col_end, row_start, row_end, round(c0 + col_start * c1 + row_start * c2, 9) AS new_c0, round(f0 + col_start * f1 + row_start * f2, 9) AS new_f0 FROM v""",
    "fx_detections", "fx_transforms",
)
def b3_aoi_window(dets, scenes):
    shift = (F.col("scene_id") % 9) / 10  # the double next to so many tenths, which 0.1 times the number may miss
    areas = dets.groupBy("scene_id").agg(F.min("longitude").alias("a"), F.min("latitude").alias("lat_min"), F.max("longitude").alias("b"), (F.max("latitude") - 0.05).alias("lat_max"))
    areas = areas.select("scene_id", (F.col("a") + shift).alias("lon_min"), "lat_min", (F.col("b") + shift).alias("lon_max"), "lat_max")
    out = B.aoi_window(scenes, areas)
    return out.select("scene_id", "crops", "col_start", "col_end", "row_start", "row_end", F.round("new_c0", 9).alias("new_c0"), F.round("new_f0", 9).alias("new_f0"))


_SHIFTED = "(SELECT det_id, tile_index, x_max + CASE WHEN det_id % 2 = 0 THEN (tile_index % 4) * 640 ELSE 0 END AS x, y_max + CASE WHEN det_id % 2 = 0 THEN floor(tile_index / 4) * 640 ELSE 0 END AS y FROM fx_detections)"


@query(f"SELECT det_id, CAST(CASE WHEN x > 960 OR y > 960 THEN x - (tile_index % 4) * 640 ELSE x END AS DOUBLE) AS x_max, CAST(CASE WHEN x > 960 OR y > 960 THEN y - floor(tile_index / 4) * 640 ELSE y END AS DOUBLE) AS y_max FROM {_SHIFTED} s", "fx_detections")
def b12_tile_local(dets):
    """Every other box comes in scene coordinates."""
    even, col, row = F.col("det_id") % 2 == 0, (F.col("tile_index") % 4) * 640, F.floor(F.col("tile_index") / 4) * 640
    moved = dets.withColumns({k: F.col(k) + F.when(even, by).otherwise(0) for k, by in (("x_min", col), ("x_max", col), ("y_min", row), ("y_max", row))})
    return B.tile_local(moved).select("det_id", *[F.col(k).cast("double").alias(k) for k in ("x_max", "y_max")])


@query(
    """WITH j AS (SELECT id, p.processor, image_size_mb * 10 / 1000 * tdp_watts * least(cpu_usage_pct / 100, 1.0) AS pre, inference_ms / 1000 * tdp_watts * least(cpu_usage_pct / 100, 1.0) AS inf,
      CAST(num_detections AS DOUBLE) / 1000 * tdp_watts * least(cpu_usage_pct / 100, 1.0) AS post FROM fx_executions e, fx_processors p),
    s AS (SELECT *, pre + inf + post AS total, unnest([{'stage': 'preprocessing', 'j': pre}, {'stage': 'inference', 'j': inf}, {'stage': 'postprocessing', 'j': post}]) AS s FROM j)
    SELECT id, processor, s.stage AS stage, s.j AS joules, coalesce(s.j * 100 / nullif(total, 0), 0) AS share_pct, total AS total_joules, total / 3600 AS total_wh FROM s""",
    "fx_executions", "fx_processors",
)
def e1_stage_energy(runs, processors):
    timed = runs.withColumns({"preprocessing_ms": F.col("image_size_mb") * 10, "postprocessing_ms": F.col("num_detections").cast("double")})
    return R.stage_energy(timed, processors, {k: f"{k}_ms" for k in ("preprocessing", "inference", "postprocessing")})


@query(
    """SELECT det_id, CASE det_id % 6 WHEN 1 THEN 'open' WHEN 2 THEN 'not JSON' WHEN 4 THEN 'empty' WHEN 5 THEN 'not a polygon' END AS problem,
    CASE WHEN det_id % 6 < 2 THEN x_min END AS lon_min, CASE WHEN det_id % 6 < 2 THEN y_min END AS lat_min, CASE WHEN det_id % 6 < 2 THEN x_max END AS lon_max, CASE WHEN det_id % 6 < 2 THEN y_max END AS lat_max FROM fx_detections""",
    "fx_detections",
)
def c3_geojson_ring(dets):
    """A closed, an open, a broken, a null and an empty ring, and one of another kind, in turn."""
    kind, ring = F.col("det_id") % 6, X.bbox_to_ring([F.col(k) for k in ("x_min", "y_min", "x_max", "y_max")])
    whole = X.ring_to_geojson(F.when(kind == 1, F.slice(ring, 1, 4)).otherwise(ring))
    text = F.when(kind == 2, F.substring(whole, 1, 30)).when(kind == 3, None).when(kind == 4, '{"type":"Polygon","coordinates":[]}').when(kind == 5, F.regexp_replace(whole, "Polygon", "MultiPoint")).otherwise(whole)
    read = dets.select("det_id", X.geojson_to_ring(text).alias("r"))
    return read.select("det_id", "r.problem", X.ring_to_bbox(F.col("r.ring")).alias("b")).select("det_id", "problem", "b.*")


@query(
    """WITH n AS (SELECT c.*, d.det_id, d.confidence FROM fx_cues c JOIN fx_detections d ON d.execution_id = c.triggered_by AND d.tile_index % 3 = 0),
    a AS (SELECT id, string_agg(CAST(det_id AS VARCHAR), ',' ORDER BY confidence DESC, det_id) AS ids, avg(confidence) AS t0 FROM n GROUP BY id),
    k AS (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY confidence DESC, det_id) AS rn FROM fx_detections),
    b AS (SELECT execution_id, string_agg(CAST(det_id AS VARCHAR), ',' ORDER BY confidence DESC, det_id) AS ids, avg(confidence) AS t1 FROM k WHERE rn <= 2 GROUP BY 1)
    SELECT c.id, coalesce(a.ids, '') AS triggering, coalesce(b.ids, '') AS confirming, CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN round(t1 - t0, 6) END AS uplift,
      CAST(epoch_us(y.created_at) - epoch_us(x.created_at) AS DOUBLE) / 1e6 AS t0_to_t1_s
    FROM fx_cues c LEFT JOIN a ON a.id = c.id LEFT JOIN b ON b.execution_id = c.execution_id LEFT JOIN fx_executions x ON x.id = c.triggered_by LEFT JOIN fx_executions y ON y.id = c.execution_id""",
    "fx_cues", "fx_executions", "fx_detections",
)
def t6_replay_record(cues, runs, dets):
    """A cue's triggering detections are those of its run in every third tile."""
    named = dets.where("tile_index % 3 = 0").join(cues.select(F.col("triggered_by").alias("execution_id")).distinct(), "execution_id", "left_semi")
    ids = named.groupBy(F.col("execution_id").alias("triggered_by")).agg(F.collect_list("det_id").alias("triggering"))
    out = T.replay_record(cues.join(ids, "triggered_by", "left"), runs, dets, 2)
    text = lambda c: F.array_join(F.transform(c, lambda s: s["det_id"].cast("string")), ",")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, s: a + s["confidence"]) / F.size(c)
    uplift = F.when(F.col("confidence_uplift").isNotNull(), F.round(mean("confirming_detections") - mean("triggering_detections"), 6))
    return out.select("id", text("triggering_detections").alias("triggering"), text("confirming_detections").alias("confirming"), uplift.alias("uplift"), "t0_to_t1_s")


_TILES = "(SELECT DISTINCT scene_id, tile_index, floor(tile_index / 4) * 640 AS row_off, (tile_index % 4) * 640 AS col_off FROM fx_detections WHERE tile_index <> 6)"


@query(
    f"""WITH z AS (SELECT scene_id, CASE WHEN scene_id % 2 = 0 THEN 1000 ELSE max(row_off + 640) END AS h, CASE WHEN scene_id % 2 = 0 THEN 2000 ELSE max(col_off + 640) END AS w FROM {_TILES} t GROUP BY scene_id),
    d AS (SELECT d.det_id, col_off + (x_min + x_max) / 2 AS cx, row_off + (y_min + y_max) / 2 AS cy, h, w FROM fx_detections d LEFT JOIN {_TILES} t ON t.scene_id = d.scene_id AND t.tile_index = d.tile_index LEFT JOIN z ON z.scene_id = t.scene_id)
    SELECT det_id FROM d WHERE cx IS NULL OR (cx BETWEEN 40 AND w - 40 AND cy BETWEEN 40 AND h - 40)""",
    "fx_detections",
)
def p8_edge_by_tiles(dets):
    """Every other scene states its size; one tile is not listed."""
    place = {"row_off": F.floor(F.col("tile_index") / 4) * 640, "col_off": (F.col("tile_index") % 4) * 640, "tile_rows": F.lit(640), "tile_cols": F.lit(640)}
    tiles = dets.where("tile_index <> 6").select("scene_id", "tile_index").distinct().withColumns(place)
    scenes = dets.where("scene_id % 2 = 0").select("scene_id", F.lit(1000).alias("n_rows"), F.lit(2000).alias("n_cols")).distinct()
    return L.edge_swath_by_tiles(dets, tiles, scenes, 40).select("det_id")


@query("SELECT scene_id, px_row, px_col, round(CASE WHEN px_col % 7 = 0 THEN 0 ELSE pow(10.0, least(greatest(value - 60, -50), 30) / 10) END, 6) AS linear FROM fx_two_scenes", "fx_two_scenes")
def r2_from_db(pixels):
    """Every seventh column holds no data."""
    db = F.when(F.col("px_col") % 7 == 0, -9999.0).otherwise(F.col("value") - 60)
    return pixels.select("scene_id", "px_row", "px_col", F.round(P.from_db(db), 6).alias("linear"))
