"""Box, point and raster algorithms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from skerry.operators import boxes as B
from skerry.operators import raster as P
from skerry.operators import relations as R

from .registry import query

IOU = "(greatest(0, least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * greatest(0, least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min)) / ((a.x_max - a.x_min) * (a.y_max - a.y_min) + (b.x_max - b.x_min) * (b.y_max - b.y_min) - greatest(0, least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * greatest(0, least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min))))"


def greedy_oracle(source: str, conflict: str) -> str:
    """One step for each rank; all scenes advance together."""
    return f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY confidence DESC, det_id) rk FROM {source}),
    e AS (SELECT b.scene_id, b.rk, list(a.rk) cf FROM r a JOIN r b ON a.scene_id = b.scene_id AND a.rk < b.rk WHERE {conflict} GROUP BY 1, 2),
    x AS (SELECT r.scene_id, r.rk, coalesce(e.cf, []) cf FROM r LEFT JOIN e USING (scene_id, rk)),
    w AS (SELECT scene_id, rk, [rk] kept FROM x WHERE rk = 1 UNION ALL SELECT x.scene_id, x.rk, CASE WHEN list_has_any(w.kept, x.cf) THEN w.kept ELSE list_append(w.kept, x.rk) END FROM w JOIN x ON x.scene_id = w.scene_id AND x.rk = w.rk + 1)
    SELECT r.scene_id, r.det_id FROM (SELECT scene_id, unnest(kept) rk FROM (SELECT scene_id, arg_max(kept, rk) kept FROM w GROUP BY 1)) k JOIN r USING (scene_id, rk)"""


def match_oracle(preds: str, truths: str, keys: str, score: str, test: str, rank: str, out: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    step = " AND ".join(f"x.{k} = w.{k}" for k in keys.split(", "))
    free = "list_filter(x.cand, lambda g: NOT list_contains(w.used, g))"
    return f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {rank}) rk FROM ({preds})),
    e AS (SELECT {", ".join("a." + k for k in keys.split(", "))}, a.rk, list(b.gt_id ORDER BY {score}, b.gt_id) cand FROM p a JOIN ({truths}) b ON {on} WHERE {test} GROUP BY ALL),
    x AS (SELECT {", ".join("p." + k for k in keys.split(", "))}, p.rk, p.det_id, coalesce(e.cand, []) cand FROM p LEFT JOIN e USING ({keys}, rk)),
    w AS (SELECT {keys}, rk, det_id, cand[1] gt, CASE WHEN len(cand) > 0 THEN [cand[1]] ELSE [] END used FROM x WHERE rk = 1
      UNION ALL SELECT {", ".join("x." + k for k in keys.split(", "))}, x.rk, x.det_id, {free}[1], CASE WHEN len({free}) > 0 THEN list_append(w.used, {free}[1]) ELSE w.used END FROM w JOIN x ON {step} AND x.rk = w.rk + 1)
    {out}"""


@query(f"SELECT a.det_id AS a_id, b.det_id AS b_id, round({IOU}, 6) AS iou FROM fx_detections a JOIN fx_detections b ON a.scene_id = b.scene_id AND a.det_id < b.det_id WHERE {IOU} >= 0.3", "fx_detections")
def b1_overlapping_pairs(dets):
    from skerry.functions import exprs as X
    from skerry.operators.pairs import box_pairs

    slim = dets.select("scene_id", "det_id", *B.BOX)
    test = (F.col("a.det_id") < F.col("b.det_id")) & (X.iou("a", "b") >= 0.3)
    return box_pairs(slim, slim, ["scene_id"], 64.0, test).select(F.col("a.det_id").alias("a_id"), F.col("b.det_id").alias("b_id"), F.round(X.iou("a", "b"), 6).alias("iou"))


_XS, _YS = [f"({x} + (tile_index % 4) * 640)" for x in ("x_min", "x_max")], [f"({y} + floor(tile_index / 4) * 640)" for y in ("y_min", "y_max")]
_CORNERS = {k: ", ".join(f"{k}0 + {k}1 * {x} + {k}2 * {y}" for x in _XS for y in _YS) for k in "cf"}
_CENTRE = {k: f"{k}0 + {k}1 * ({_XS[0]} + {_XS[1]}) / 2 + {k}2 * ({_YS[0]} + {_YS[1]}) / 2" for k in "cf"}


@query(
    f"""SELECT det_id, round({_CENTRE["c"]}, 6) AS lon, round({_CENTRE["f"]}, 6) AS lat, round(least({_CORNERS["c"]}), 6) AS lon_min, round(greatest({_CORNERS["c"]}), 6) AS lon_max,
    round(least({_CORNERS["f"]}), 6) AS lat_min, round(greatest({_CORNERS["f"]}), 6) AS lat_max FROM fx_detections d JOIN fx_transforms t ON d.scene_id = t.scene_id""",
    "fx_detections", "fx_transforms",
)
def b2_pixel_to_geo(dets, scenes):
    """Tile offsets and an affine that turns, another one for each scene."""
    out = B.pixel_to_geo(dets, scenes.drop("n_rows", "n_cols"))
    names = {"geo_lon": "lon", "geo_lat": "lat", "geo_lon_min": "lon_min", "geo_lon_max": "lon_max", "geo_lat_min": "lat_min", "geo_lat_max": "lat_max"}
    return out.select("det_id", *[F.round(a, 6).alias(b) for a, b in names.items()])


@query("SELECT det_id, CAST(floor((longitude + 6) * 1024) AS BIGINT) AS px, CAST(floor((37 - latitude) * 512) AS BIGINT) AS py FROM fx_detections", "fx_detections")
def b3_geo_to_pixel(dets):
    scenes = dets.select("scene_id").distinct().select("scene_id", *[F.lit(v).alias(k) for k, v in (("c0", -6.0), ("c1", 1 / 1024), ("c2", 0.0), ("f0", 37.0), ("f1", 0.0), ("f2", -1 / 512))])
    return B.geo_to_pixel(dets.select("det_id", "scene_id", "longitude", "latitude"), scenes).select("det_id", "px", "py")


@query(greedy_oracle("fx_detections", f"{IOU} >= 0.3"), "fx_detections")
def b4_nms(dets):
    return B.nms(dets.select("scene_id", "det_id", "confidence", *B.BOX)).select("scene_id", "det_id")


@query(greedy_oracle("(SELECT det_id, scene_id, confidence, x_min + (tile_index % 4) * 640 AS x_min, x_max + (tile_index % 4) * 640 AS x_max, y_min + floor(tile_index / 4) * 640 AS y_min, y_max + floor(tile_index / 4) * 640 AS y_max FROM fx_detections)", f"{IOU} >= 0.3"), "fx_detections")
def b5_merge_tiles(dets):
    return B.merge_tiles(dets.select("scene_id", "det_id", "confidence", "tile_index", *B.BOX)).select("scene_id", "det_id")


@query(greedy_oracle("fx_detections", "abs(a.longitude - b.longitude) <= 0.0101 AND abs(a.latitude - b.latitude) <= 0.0101"), "fx_detections")
def b6_geo_dedup(dets):
    return B.geo_dedup(dets.select("scene_id", "det_id", "confidence", "longitude", "latitude"), 0.0101).select("scene_id", "det_id")


_TRUTH = "SELECT gt_id, scene_id, x_min, y_min, x_max, y_max FROM fx_ground_truth"


@query(match_oracle("SELECT * FROM fx_detections", _TRUTH, "scene_id", f"{IOU} DESC", f"{IOU} >= 0.5", "confidence DESC, det_id", "SELECT det_id, gt AS gt_id FROM w WHERE gt IS NOT NULL"), "fx_detections", "fx_ground_truth")
def b7_greedy_match(dets, truths):
    return B.matches(dets, truths)


_DIST = "sqrt(((a.x_min + a.x_max) / 2 - (b.x_min + b.x_max) / 2) * ((a.x_min + a.x_max) / 2 - (b.x_min + b.x_max) / 2) + ((a.y_min + a.y_max) / 2 - (b.y_min + b.y_max) / 2) * ((a.y_min + a.y_max) / 2 - (b.y_min + b.y_max) / 2))"


@query(match_oracle("SELECT * FROM fx_detections", _TRUTH, "scene_id", _DIST, f"{_DIST} <= 6", "confidence DESC, det_id", "SELECT det_id, gt AS gt_id FROM w WHERE gt IS NOT NULL"), "fx_detections", "fx_ground_truth")
def b7_match_by_centre(dets, truths):
    return B.matches(dets, truths, threshold=6.0, mode="center")


_FUSED_ROWS = match_oracle(
    "SELECT * FROM fx_detections WHERE source = 'cfar'", "SELECT det_id AS gt_id, scene_id, tile_index, x_min, y_min, x_max, y_max FROM fx_detections WHERE source = 'yolo'", "scene_id, tile_index", f"{IOU} DESC", f"{IOU} >= 0.3", "det_id",
    """, m AS (SELECT det_id, gt FROM w WHERE gt IS NOT NULL)
    SELECT c.det_id, 'fused' AS source, least(1, y.confidence / 2 + (1 - exp(-c.snr / 10)) / 2) AS confidence FROM m JOIN fx_detections c ON c.det_id = m.det_id JOIN fx_detections y ON y.det_id = m.gt
    UNION ALL SELECT det_id, source, (1 - exp(-snr / 10)) * 0.6 FROM fx_detections WHERE source = 'cfar' AND det_id NOT IN (SELECT det_id FROM m)
    UNION ALL SELECT det_id, source, confidence FROM fx_detections WHERE source = 'yolo' AND det_id NOT IN (SELECT gt FROM m)""",
)


@query(f"SELECT det_id, source, round(confidence, 6) AS confidence FROM ({_FUSED_ROWS}) f", "fx_detections")
def b8_fuse(dets):
    return B.fuse(dets).select("det_id", "source", F.round("confidence", 6).alias("confidence"))


_NEAR = "SELECT a.scene_id, a.longitude, a.latitude, sum(b.k) AS n FROM (SELECT scene_id, longitude, latitude, count(*) AS k FROM fx_detections GROUP BY ALL) a JOIN (SELECT scene_id, longitude, latitude, count(*) AS k FROM fx_detections GROUP BY ALL) b ON a.scene_id = b.scene_id WHERE sqrt((a.longitude - b.longitude) * (a.longitude - b.longitude) + (a.latitude - b.latitude) * (a.latitude - b.latitude)) <= 0.0101 GROUP BY ALL"


@query(f"SELECT d.det_id, n.n >= 4 AS is_cluster FROM fx_detections d JOIN ({_NEAR}) n ON d.scene_id = n.scene_id AND d.longitude = n.longitude AND d.latitude = n.latitude", "fx_detections")
def b9_cluster_anomaly(dets):
    return B.cluster_anomaly(dets.select("scene_id", "det_id", "longitude", "latitude"), 0.0101, 4).select("det_id", "is_cluster")


def _two_runs(dets):
    slim = dets.select("det_id", "scene_id", "confidence", *B.BOX)
    return slim, slim.where("confidence > 0.02").withColumn("confidence", F.col("confidence") + F.when(F.col("scene_id") % 3 == 0, 0.05).otherwise(0.0))


_RUN_A = "SELECT det_id, scene_id, confidence, x_min, y_min, x_max, y_max FROM fx_detections"
_RUN_B = "SELECT det_id AS gt_id, scene_id, x_min, y_min, x_max, y_max, confidence + CASE WHEN scene_id % 3 = 0 THEN 0.05 ELSE 0 END AS cb FROM fx_detections WHERE confidence > 0.02"
_B10 = match_oracle(_RUN_A, _RUN_B, "scene_id", f"{IOU} DESC", f"{IOU} >= 0.9", "confidence DESC, det_id", f""", m AS (SELECT w.scene_id, count(*) AS matched, avg(abs(a.confidence - b.cb)) AS diff FROM w JOIN ({_RUN_A}) a ON w.det_id = a.det_id JOIN ({_RUN_B}) b ON w.gt = b.gt_id GROUP BY 1),
    n AS (SELECT scene_id, count(*) AS n_a, count(*) FILTER (WHERE confidence > 0.02) AS n_b FROM fx_detections GROUP BY 1), t AS (SELECT n.scene_id, n_a, n_b, coalesce(matched, 0) AS matched, coalesce(diff, 0) AS diff FROM n LEFT JOIN m ON n.scene_id = m.scene_id)
    SELECT scene_id, n_a, n_b, matched, round(CAST(diff AS DOUBLE), 6) AS mean_diff, CASE WHEN n_a = n_b AND matched = n_a AND diff <= 0.01 THEN 'REPRODUCIBLE' WHEN matched > 0 THEN 'PARTIAL' ELSE 'DIFFERENT' END AS verdict FROM t""")


@query(_B10, "fx_detections")
def b10_reproducibility_diff(dets):
    a, b = _two_runs(dets)
    return B.reproducibility(a, b).select("scene_id", "n_a", "n_b", "matched", F.round("mean_diff", 6).alias("mean_diff"), "verdict")


_B11 = match_oracle("SELECT * FROM fx_detections", _TRUTH, "scene_id", f"{IOU} DESC", f"{IOU} >= 0.5", "confidence DESC, det_id", """, t AS (SELECT scene_id, count(*) AS tp FROM w WHERE gt IS NOT NULL GROUP BY 1), n AS (SELECT scene_id, count(*) AS n_p, sum((x_max - x_min) * (y_max - y_min)) / 1000 AS km2 FROM fx_detections GROUP BY 1), g AS (SELECT scene_id, count(*) AS n_g FROM fx_ground_truth GROUP BY 1)
    SELECT n.scene_id, coalesce(tp, 0) AS tp, n_p - coalesce(tp, 0) AS fp, coalesce(n_g, 0) - coalesce(tp, 0) AS fn, round(coalesce(tp, 0) / n_p, 6) AS precision, round(coalesce(coalesce(tp, 0) / nullif(n_g, 0), 0), 6) AS pd, round((n_p - coalesce(tp, 0)) / km2, 6) AS far_km2 FROM n LEFT JOIN t ON n.scene_id = t.scene_id LEFT JOIN g ON n.scene_id = g.scene_id""")


@query(_B11, "fx_detections", "fx_ground_truth")
def b11_evaluate(dets, truths):
    areas = dets.groupBy("scene_id").agg((F.sum((F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))) / 1000).alias("km2"))
    out = B.evaluate(dets, truths, areas)
    return out.select("scene_id", "tp", "fp", "fn", *[F.round(k, 6).alias(k) for k in ("precision", "pd", "far_km2")])


def _side(lo: str, hi: str) -> tuple[str, str]:
    mid, half = f"({lo} + {hi}) / 2", f"greatest(({hi} - {lo}) / 2 + 32, 32)"
    return f"greatest(0, floor({mid} - {half}))", f"least(640, ceil({mid} + {half}))"


@query(f"SELECT det_id, CAST({_side('x_min', 'x_max')[0]} AS DOUBLE) AS chip_x0, CAST({_side('y_min', 'y_max')[0]} AS DOUBLE) AS chip_y0, CAST({_side('x_min', 'x_max')[1]} AS DOUBLE) AS chip_x1, CAST({_side('y_min', 'y_max')[1]} AS DOUBLE) AS chip_y1 FROM fx_detections", "fx_detections")
def b12_chip_window(dets):
    return B.chip_window(dets)


@query(
    "WITH c AS (SELECT *, CAST(floor(px_row / 32) * 8 + floor(px_col / 32) AS BIGINT) AS chip_id, ln(1 + greatest(value, 0)) AS v FROM fx_pixels), e AS (SELECT chip_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM c GROUP BY 1) SELECT c.scene_id, c.chip_id, px_row, px_col, round(coalesce((least(greatest(v, lo), hi) - lo) / nullif(hi - lo, 0), 0) * 255, 4) AS grey FROM c JOIN e ON c.chip_id = e.chip_id",
    "fx_pixels",
)
def b13_chip_pixels(pixels):
    r, c = F.floor(F.col("px_row") / 32), F.floor(F.col("px_col") / 32)
    chips = pixels.select("scene_id", r.alias("r"), c.alias("c")).distinct().select("scene_id", (F.col("r") * 8 + F.col("c")).alias("chip_id"), (F.col("r") * 32).alias("r0"), (F.col("c") * 32).alias("c0"), (F.col("r") * 32 + 32).alias("r1"), (F.col("c") * 32 + 32).alias("c1"))
    return P.chip_pixels(pixels, chips).withColumn("grey", F.round("grey", 4))


# the steps of the batch job one after the other, as the queries above have them
_PLACED = f"""SELECT d.det_id, d.scene_id, f.source, f.confidence, {_CENTRE["c"]} AS longitude, {_CENTRE["f"]} AS latitude, (x_min + x_max) / 2 AS cx, (y_min + y_max) / 2 AS cy, n_rows, n_cols
    FROM fx_detections d JOIN ({_FUSED_ROWS}) f ON d.det_id = f.det_id JOIN fx_transforms t ON d.scene_id = t.scene_id"""
_LON3 = "round(CAST(CAST(longitude AS VARCHAR) AS DECIMAL(24, 17)), 3)"  # halves as they are written
_FOOTPRINT = [(-5.95, 35.65), (-5.55, 35.65), (-5.55, 36.15), (-5.95, 36.15)]
_POSTPROCESS = f"""WITH placed AS MATERIALIZED (SELECT det_id, scene_id, source, confidence, longitude, latitude FROM ({_PLACED}) p WHERE cx BETWEEN 40 AND n_cols - 40 AND cy BETWEEN 40 AND n_rows - 40),
    single AS MATERIALIZED (SELECT p.* FROM placed p JOIN ({greedy_oracle("placed", "abs(a.longitude - b.longitude) <= 0.0005 AND abs(a.latitude - b.latitude) <= 0.0005")}) k USING (det_id)),
    level AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY scene_id, {_LON3}) AS in_column, count(*) OVER (PARTITION BY scene_id) AS in_scene FROM single) t WHERE NOT (in_scene > 15 AND in_column >= 8)),
    near AS (SELECT a.det_id, count(*) AS n FROM level a JOIN level b ON a.scene_id = b.scene_id WHERE sqrt((a.longitude - b.longitude) * (a.longitude - b.longitude) + (a.latitude - b.latitude) * (a.latitude - b.latitude)) <= 0.01 GROUP BY a.det_id)
    SELECT l.det_id, l.scene_id, l.source, round(l.confidence, 6) AS confidence, round(l.longitude, 6) AS longitude,
    CASE WHEN NOT (longitude BETWEEN -5.95 AND -5.55 AND latitude BETWEEN 35.65 AND 36.15) THEN 'outside_footprint' WHEN m.cell_x IS NOT NULL THEN 'land_artifact' WHEN n.n >= 8 THEN 'cluster_artifact'
    WHEN source IN ('yolo', 'fused') THEN 'valid_sea_target' ELSE 'candidate' END AS verdict FROM level l JOIN near n ON n.det_id = l.det_id
    LEFT JOIN fx_land m ON m.cell_x = CAST(floor(longitude / CAST(0.05 AS DOUBLE)) AS INT) AND m.cell_y = CAST(floor(latitude / CAST(0.05 AS DOUBLE)) AS INT)"""


@query(_POSTPROCESS, "fx_detections", "fx_land", "fx_transforms")
def b14_postprocess(dets, mask, scenes):
    out = B.postprocess(dets, scenes, mask, _FOOTPRINT, buffer_px=40)
    return out.select("det_id", "scene_id", "source", "confidence", F.round("longitude", 6).alias("longitude"), "verdict")


_LUT = """SELECT p.scene_id, p.px_row, p.px_col, p.value, CASE WHEN px_row < 30 THEN 400 + px_row / 30 * 20 WHEN px_row < 60 THEN 420 - (px_row - 30) / 30 * 10 WHEN px_row < 90 THEN 410 + (px_row - 60) / 30 * 40 ELSE 450 END AS sigma FROM fx_pixels p"""


@query(f"SELECT scene_id, px_row, px_col, round(sigma, 6) AS sigma FROM ({_LUT}) t", "fx_pixels", "fx_lut")
def j9_interpolated_lut(pixels, lut):
    return R.interpolated(pixels, lut).select("scene_id", "px_row", "px_col", F.round("sigma", 6).alias("sigma"))


@query(f"SELECT scene_id, px_row, px_col, round(greatest(value * value / (sigma * sigma), 0.0000000001), 9) AS sigma0 FROM ({_LUT}) t", "fx_pixels", "fx_lut")
def r1_calibrate(pixels, lut):
    return P.calibrate(pixels, lut).select("scene_id", "px_row", "px_col", F.round("sigma0", 9).alias("sigma0"))


@query(f"SELECT scene_id, px_row, px_col, CAST(floor((least(greatest(10 * log10(greatest(value * value / (sigma * sigma), 0.0000000001)), -25), 0) + 25) / 25 * 255) AS INT) AS grey FROM ({_LUT}) t", "fx_pixels", "fx_lut")
def r2_to_db_uint8(pixels, lut):
    return P.calibrate(pixels, lut).select("scene_id", "px_row", "px_col", P.to_uint8(F.col("sigma0")).alias("grey"))


_SIZES = "(SELECT p.*, h, w FROM fx_two_scenes p JOIN (SELECT scene_id, max(px_row) AS h, max(px_col) AS w FROM fx_two_scenes GROUP BY scene_id) s ON p.scene_id = s.scene_id)"
_MIRROR = f"(SELECT scene_id, px_col, unnest([px_row, CASE WHEN px_row < 3 THEN -1 - px_row END, CASE WHEN h - px_row < 3 THEN 2 * h + 1 - px_row END]) AS r, value, h, w FROM {_SIZES} z)"
_MIRROR2 = f"(SELECT scene_id, r, unnest([px_col, CASE WHEN px_col < 3 THEN -1 - px_col END, CASE WHEN w - px_col < 3 THEN 2 * w + 1 - px_col END]) AS c, value, h, w FROM {_MIRROR} m WHERE r IS NOT NULL)"


@query(
    f"""WITH a AS (SELECT * FROM {_MIRROR2} m WHERE c IS NOT NULL),
    s AS (SELECT *, sum(value) OVER along AS s1, sum(value * value) OVER along AS q1 FROM a WINDOW along AS (PARTITION BY scene_id, r ORDER BY c RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    t AS (SELECT *, sum(s1) OVER down / 49 AS m, sum(q1) OVER down / 49 AS q FROM s WINDOW down AS (PARTITION BY scene_id, c ORDER BY r RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    v AS (SELECT *, greatest(q - m * m, 0) AS v FROM t WHERE r BETWEEN 0 AND h AND c BETWEEN 0 AND w), n AS (SELECT scene_id, avg(v) AS noise FROM v GROUP BY scene_id)
    SELECT v.scene_id, r AS px_row, c AS px_col, round(m + v / (v + noise) * (value - m), 4) AS filtered FROM v JOIN n ON v.scene_id = n.scene_id""",
    "fx_two_scenes",
)
def r3_lee_filter(pixels):
    return P.lee_filter(pixels, 7).withColumn("filtered", F.round("filtered", 4))


@query("SELECT px_row, px_col, CAST(t.r AS BIGINT) AS tile_row, CAST(u.c AS BIGINT) AS tile_col FROM fx_pixels p JOIN (SELECT unnest(range(0, max(px_row) // 24 + 1)) AS r FROM fx_pixels) t ON p.px_row BETWEEN t.r * 24 AND t.r * 24 + 31 JOIN (SELECT unnest(range(0, max(px_col) // 24 + 1)) AS c FROM fx_pixels) u ON p.px_col BETWEEN u.c * 24 AND u.c * 24 + 31", "fx_pixels")
def r4_assign_tiles(pixels):
    return P.assign_tiles(pixels, 32, 8).select("px_row", "px_col", "tile_row", "tile_col")


_FLUSH = "SELECT DISTINCT off FROM (SELECT k * 24 AS off FROM (SELECT unnest(range(0, top // 24 + 1)) AS k, top FROM e) s WHERE k * 24 <= top UNION ALL SELECT top FROM e) u"


@query(
    f"""WITH g AS (SELECT max(px_row) + 1 AS h, max(px_col) + 1 AS w FROM fx_pixels), r AS (WITH e AS (SELECT greatest(0, h - 32) AS top FROM g) {_FLUSH}), c AS (WITH e AS (SELECT greatest(0, w - 32) AS top FROM g) {_FLUSH})
    SELECT px_row, px_col, CAST(r.off AS BIGINT) AS row_off, CAST(c.off AS BIGINT) AS col_off FROM fx_pixels p JOIN r ON p.px_row BETWEEN r.off AND r.off + 31 JOIN c ON p.px_col BETWEEN c.off AND c.off + 31""",
    "fx_pixels",
)
def r4_flush_tiles(pixels):
    return P.flush_tiles(pixels, 32, 8).select("px_row", "px_col", "row_off", "col_off")


_CORNER = {k: ", ".join(f"{k}0 + {k}1 * (col_off + {x}) + {k}2 * (row_off + {y})" for x in (0, 640) for y in (0, 640)) for k in "cf"}


@query(
    f"""SELECT t.scene_id, row_off, col_off, round(least({_CORNER["c"]}), 6) AS lon_min, round(greatest({_CORNER["c"]}), 6) AS lon_max, round(least({_CORNER["f"]}), 6) AS lat_min, round(greatest({_CORNER["f"]}), 6) AS lat_max
    FROM (SELECT DISTINCT scene_id, CAST(floor(tile_index / 4) * 640 AS BIGINT) AS row_off, CAST((tile_index % 4) * 640 AS BIGINT) AS col_off FROM fx_detections) t JOIN fx_transforms s ON t.scene_id = s.scene_id""",
    "fx_detections", "fx_transforms",
)
def r5_tile_bounds(dets, scenes):
    tiles = dets.select("scene_id", (F.floor(F.col("tile_index") / 4) * 640).alias("row_off"), ((F.col("tile_index") % 4) * 640).cast("long").alias("col_off")).distinct()
    out = P.tile_bounds(tiles, scenes, 640)
    return out.select("scene_id", "row_off", "col_off", *[F.round(c, 6).alias(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max")])


_RING = """WITH h AS (SELECT scene_id, max(px_row) AS h, max(px_col) AS w FROM fx_two_scenes GROUP BY 1), o AS (SELECT * FROM (SELECT unnest(range(-6, 7)) AS dr) a, (SELECT unnest(range(-6, 7)) AS dc) b WHERE greatest(abs(dr), abs(dc)) > 2),
    s AS (SELECT p.scene_id, p.px_row, p.px_col, p.value, sum(q.value) / 144 AS m, sum(q.value * q.value) / 144 AS m2 FROM fx_two_scenes p JOIN h ON p.scene_id = h.scene_id, o JOIN fx_two_scenes q ON q.px_row = p.px_row + dr AND q.px_col = p.px_col + dc AND q.scene_id = p.scene_id
      WHERE p.px_row BETWEEN 6 AND h - 6 AND p.px_col BETWEEN 6 AND w - 6 GROUP BY ALL)"""


@query(
    f"{_RING} SELECT scene_id, px_row, px_col, round(m, 7) AS background, value > 144 * (pow(0.01, -1 / CAST(144 AS DOUBLE)) - 1) * m AS hit FROM s",
    "fx_two_scenes",
)
def r6_ca_cfar(pixels):
    return P.ca_cfar(pixels).select("scene_id", "px_row", "px_col", F.round("background", 7).alias("background"), "hit")


@query(
    f"{_RING} SELECT scene_id, px_row, px_col, value > m + 1.5 * sqrt(greatest(m2 - m * m, 0)) AND px_col % 5 <> 0 AS hit FROM s",
    "fx_two_scenes",
)
def r6_gaussian_cfar(pixels):
    return P.ca_cfar(pixels, deviations=1.5, valid=F.col("px_col") % 5 != 0).select("scene_id", "px_row", "px_col", "hit")


@query(
    f"""WITH o AS (SELECT * FROM (SELECT unnest(range(-3, 4)) AS dr) a, (SELECT unnest(range(-3, 4)) AS dc) b WHERE greatest(abs(dr), abs(dc)) > 1),
    s AS (SELECT p.scene_id, p.px_row, p.px_col, p.value, list_sort(list(q.value)) AS v FROM {_SIZES} p, o JOIN fx_two_scenes q ON q.scene_id = p.scene_id AND q.px_row = p.px_row + dr AND q.px_col = p.px_col + dc
      WHERE p.px_row BETWEEN 3 AND h - 3 AND p.px_col BETWEEN 3 AND w - 3 GROUP BY ALL)
    SELECT scene_id, px_row, px_col, value FROM s WHERE value > 2 * v[CAST(floor(0.75 * (len(v) - 1)) AS INT) + 1]""",
    "fx_two_scenes",
)
def r7_os_cfar(pixels):
    return P.os_cfar(pixels)


def cluster_oracle(points: str, out: str, head: str = "WITH RECURSIVE ") -> str:
    """Density clusters of the points (scene_id, r, c) of a grid, eight neighbours, three or more with the point itself."""
    return f"""{head}p AS ({points}), e AS (SELECT a.scene_id, a.r, a.c, b.r AS r2, b.c AS c2 FROM p a JOIN p b ON a.scene_id = b.scene_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
    k AS (SELECT scene_id, r, c FROM e GROUP BY ALL HAVING count(*) >= 3), x AS (SELECT e.* FROM e JOIN k a ON (a.scene_id, a.r, a.c) = (e.scene_id, e.r, e.c) JOIN k b ON (b.scene_id, b.r, b.c) = (e.scene_id, e.r2, e.c2)),
    w AS (SELECT scene_id, r, c, r AS r2, c AS c2 FROM k UNION SELECT w.scene_id, w.r, w.c, x.r2, x.c2 FROM w JOIN x ON (x.scene_id, x.r, x.c) = (w.scene_id, w.r2, w.c2)),
    own AS (SELECT scene_id, r, c, min(r2 * 4294967296 + c2) AS cluster FROM w GROUP BY ALL),
    near AS (SELECT e.scene_id, e.r, e.c, min(o.cluster) AS cluster FROM e JOIN own o ON (o.scene_id, o.r, o.c) = (e.scene_id, e.r2, e.c2) GROUP BY ALL),
    l AS (SELECT p.scene_id, p.r, p.c, coalesce(o.cluster, n.cluster) AS cluster FROM p LEFT JOIN own o ON (o.scene_id, o.r, o.c) = (p.scene_id, p.r, p.c) LEFT JOIN near n ON (n.scene_id, n.r, n.c) = (p.scene_id, p.r, p.c))
    {out}"""


@query(cluster_oracle("SELECT scene_id, CAST(px_row AS BIGINT) AS r, CAST(px_col AS BIGINT) AS c FROM fx_two_scenes WHERE value > 80", "SELECT scene_id, r * 4294967296 + c AS point_id, cluster FROM l"), "fx_two_scenes")
def r8_dbscan(pixels):
    """Two scenes that hold the same point ids."""
    hits = pixels.where("value > 80")
    points = hits.select("scene_id", (F.shiftleft(F.col("px_row").cast("long"), 32) + F.col("px_col")).alias("point_id"), F.col("px_col").cast("double").alias("x"), F.col("px_row").cast("double").alias("y"))
    return P.dbscan(points, 1.5, 3).select("scene_id", "point_id", "cluster")


@query(
    cluster_oracle(
        "SELECT scene_id, CAST(px_row AS BIGINT) AS r, CAST(px_col AS BIGINT) AS c FROM s WHERE value > 144 * (pow(0.2, -1 / CAST(144 AS DOUBLE)) - 1) * m",
        """SELECT l.scene_id, l.cluster, CAST(min(l.c) AS INT) AS x_min, CAST(min(l.r) AS INT) AS y_min, CAST(max(l.c) AS INT) AS x_max, CAST(max(l.r) AS INT) AS y_max, count(*) AS n, round(avg(s.value), 9) AS mean_value
        FROM l JOIN s ON s.scene_id = l.scene_id AND s.px_row = l.r AND s.px_col = l.c WHERE l.cluster IS NOT NULL GROUP BY l.scene_id, l.cluster""",
        _RING.replace("WITH h", "WITH RECURSIVE h") + ", ",
    ),
    "fx_two_scenes",
)
def r9_cfar_clusters(pixels):
    return P.hit_clusters(P.ca_cfar(pixels, pfa=0.2).where("hit")).select("scene_id", "cluster", "x_min", "y_min", "x_max", "y_max", "n", F.round("mean_value", 9).alias("mean_value"))


@query("WITH h AS (SELECT scene_id, px_row FROM fx_pixels WHERE value > 90), v AS (SELECT count(*) AS v FROM fx_pixels WHERE value <> 0) SELECT px_row, count(*) AS n FROM h, v WHERE (SELECT count(*) FROM h) <= 0.5 * v GROUP BY px_row", "fx_pixels")
def r10_saturated_tile_guard(pixels):
    return P.saturated_guard(pixels.where("value > 90"), pixels, 0.5).groupBy("px_row").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT *, sum(value) OVER a AS s1, sum(value * value) OVER a AS q1, count(*) OVER a AS n1 FROM fx_pixels WINDOW a AS (PARTITION BY px_row ORDER BY px_col RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING)),
    t AS (SELECT px_row, px_col, value, sum(s1) OVER b AS s, sum(q1) OVER b AS q, sum(n1) OVER b AS n FROM s WINDOW b AS (PARTITION BY px_col ORDER BY px_row RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING)),
    r AS (SELECT px_row, px_col, greatest(0, coalesce((value - s / n) / nullif(sqrt(greatest(q / n - s / n * s / n, 0)), 0), 0)) AS raw FROM t)
    SELECT px_row, px_col, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 4) AS score FROM r""",
    "fx_pixels",
)
def r11_cfar_score(pixels):
    return P.cfar_score(pixels).select("px_row", "px_col", F.round("score", 4).alias("score"))


@query("SELECT a.px_row, a.px_col, CAST(floor(least(greatest(a.value * 10 * 255 / 3000, 0), 255)) AS INT) AS red, CAST(floor(least(greatest(b.value * 20 * 255 / 3000, 0), 255)) AS INT) AS green FROM fx_pixels a JOIN fx_pixels b ON a.px_row = b.px_row AND a.px_col = b.px_col", "fx_pixels")
def r12_optical_scale(pixels):
    key = ["scene_id", "px_row", "px_col"]
    red, green = pixels.select(*key, (F.col("value") * 10).alias("b4")), pixels.select(*key, (F.col("value") * 20).alias("b3"))
    return red.join(green, key).select("px_row", "px_col", P.optical_scale(F.col("b4")).alias("red"), P.optical_scale(F.col("b3")).alias("green"))


def bright_spots(threshold: float = 95.0):
    """A stand-in detector: one box around the pixels of a tile above a threshold."""

    def load():
        def detect(tiles: pd.DataFrame) -> pd.DataFrame:
            out = []
            for t in tiles.itertuples():
                hot = [p for p in t.pixels if p["value"] > threshold]
                if hot:
                    cols, rows = [p["in_col"] for p in hot], [p["in_row"] for p in hot]
                    out.append((t.scene_id, t.tile_row, t.tile_col, "spot", min(1.0, len(hot) / 100), float(min(cols)), float(min(rows)), float(max(cols)), float(max(rows))))
            return pd.DataFrame(out, columns=["scene_id", "tile_row", "tile_col", "class_name", "confidence", "x_min", "y_min", "x_max", "y_max"])

        return detect

    return load


@query("SELECT tile_row, tile_col, min(in_col) AS x_min, min(in_row) AS y_min, max(in_col) AS x_max, max(in_row) AS y_max FROM (SELECT CAST(floor(px_row / 32) AS BIGINT) AS tile_row, CAST(floor(px_col / 32) AS BIGINT) AS tile_col, CAST(px_col % 32 AS DOUBLE) AS in_col, CAST(px_row % 32 AS DOUBLE) AS in_row, value FROM fx_pixels) t WHERE value > 95 GROUP BY ALL", "fx_pixels")
def r13_score_tiles(pixels):
    tiles = P.assign_tiles(pixels, 32, 0).groupBy("scene_id", "tile_row", "tile_col").agg(F.collect_list(F.struct("in_row", "in_col", "value")).alias("pixels"))
    return P.score_tiles(tiles, bright_spots()).select("tile_row", "tile_col", "x_min", "y_min", "x_max", "y_max")


@query("SELECT px_row, px_col, round(sum(s1) OVER (PARTITION BY px_col ORDER BY px_row RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS total FROM (SELECT *, sum(value) OVER (PARTITION BY px_row ORDER BY px_col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s1 FROM fx_pixels) t", "fx_pixels")
def w11_box_sum(pixels):
    return P.box_sums(pixels, 2, {"total": F.col("value")}).select("px_row", "px_col", F.round("total", 4).alias("total"))


# of every column the lowest and the highest row; a corner is where the steepest way back is less steep than the least steep way on
_HULL = """WITH e AS (SELECT scene_id, px_col AS x, min(px_row) AS lo, max(px_row) AS hi FROM fx_two_scenes WHERE value > -1000 AND value <> 0 {} GROUP BY scene_id, px_col),
    big AS (SELECT scene_id, min(x) AS x0, max(x) AS x1 FROM e JOIN (SELECT scene_id FROM fx_two_scenes WHERE value > -1000 AND value <> 0 {} GROUP BY scene_id HAVING count(*) >= 100) b USING (scene_id) GROUP BY scene_id),
    s AS (SELECT a.scene_id, a.x, a.lo, a.hi, max(CASE WHEN b.x < a.x THEN (a.lo - b.lo) / CAST(a.x - b.x AS DOUBLE) END) AS lo_back, min(CASE WHEN b.x > a.x THEN (b.lo - a.lo) / CAST(b.x - a.x AS DOUBLE) END) AS lo_on,
    min(CASE WHEN b.x < a.x THEN (a.hi - b.hi) / CAST(a.x - b.x AS DOUBLE) END) AS hi_back, max(CASE WHEN b.x > a.x THEN (b.hi - a.hi) / CAST(b.x - a.x AS DOUBLE) END) AS hi_on FROM e a JOIN e b ON a.scene_id = b.scene_id GROUP BY ALL),
    c AS (SELECT s.scene_id, 0 AS upper, x, lo AS y FROM s JOIN big USING (scene_id) WHERE (lo_back IS NULL OR lo_on IS NULL OR lo_back < lo_on) AND NOT (x = x1 AND lo = hi)
    UNION ALL SELECT s.scene_id, 1, x, hi FROM s JOIN big USING (scene_id) WHERE (hi_back IS NULL OR hi_on IS NULL OR hi_back > hi_on) AND NOT (x = x0 AND lo = hi))
    SELECT scene_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY upper, CASE WHEN upper = 0 THEN x ELSE -x END) - 1 AS INT) AS vertex, CAST(x AS INT) AS col, CAST(y AS INT) AS row FROM c"""


@query(_HULL.format("", ""), "fx_two_scenes")
def a16_convex_footprint(pixels):
    return P.convex_footprint(pixels)


@query(_HULL.format("AND value > 60", "AND value > 60"), "fx_two_scenes")
def a16_bright_footprint(pixels):
    return P.convex_footprint(pixels.where("value > 60"))
