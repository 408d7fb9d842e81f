"""Aggregates, windows and cost columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators import runs as R

from .registry import query, statement


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    "SELECT model_name, model_version, model_size_mb, compression_technique, constraint_profile, count(*) AS runs, round(avg(inference_ms), 4) AS avg_inference_ms, round(quantile_cont(inference_ms, 0.5), 4) AS p50_inference_ms, round(quantile_cont(inference_ms, 0.95), 4) AS p95_inference_ms, round(avg(peak_ram_mb), 4) AS avg_peak_ram_mb, round(avg(cpu_usage_pct), 4) AS avg_cpu_pct, round(avg(num_detections), 4) AS avg_detections, round(avg(avg_confidence), 4) AS avg_confidence FROM fx_executions WHERE status = 'success' GROUP BY ALL",
    "fx_executions",
)
def a1_benchmarks(runs):
    return rounded(R.benchmarks(runs), 4)


@query("SELECT image_id, model_name, constraint_profile, model_version, round(avg(inference_ms), 7) AS avg_latency_ms, round(avg(peak_ram_mb), 7) AS avg_ram_mb, round(avg(num_detections), 7) AS avg_detections, count(*) FILTER (WHERE status = 'success') AS successes, count(*) FILTER (WHERE status <> 'success') AS failures FROM fx_executions GROUP BY ALL", "fx_executions")
def a2_profile_comparison(runs):
    return rounded(R.profile_comparison(runs), 7)


@query("SELECT count(*) AS n, round(avg(confidence), 6) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence, count(*) FILTER (WHERE source = 'cfar') AS n_cfar, count(*) FILTER (WHERE source = 'yolo') AS n_yolo, count(*) FILTER (WHERE source = 'fused') AS n_fused, round(min(longitude), 6) AS lon_min, round(min(latitude), 6) AS lat_min, round(max(longitude), 6) AS lon_max, round(max(latitude), 6) AS lat_max FROM fx_detections", "fx_detections")
def a3_detection_stats(dets):
    return rounded(R.detection_stats(dets))


@query(
    """WITH b AS (SELECT *, source <> 'cfar' AS boxed, (x_max - x_min) / 20000.0 AS w, (y_max - y_min) / 20000.0 AS h FROM fx_detections)
    SELECT count(*) AS n, round(avg(confidence), 6) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence,
    count(*) FILTER (WHERE source = 'cfar') AS n_cfar, count(*) FILTER (WHERE source = 'yolo') AS n_yolo, count(*) FILTER (WHERE source = 'fused') AS n_fused,
    round(min(longitude - CASE WHEN boxed THEN w ELSE 0 END), 6) AS lon_min, round(min(latitude - CASE WHEN boxed THEN h ELSE 0 END), 6) AS lat_min,
    round(max(longitude + CASE WHEN boxed THEN w ELSE 0 END), 6) AS lon_max, round(max(latitude + CASE WHEN boxed THEN h ELSE 0 END), 6) AS lat_max FROM b""",
    "fx_detections",
)
def a3_extent_by_box(dets):
    w, h = (F.col("x_max") - F.col("x_min")) / 20000.0, (F.col("y_max") - F.col("y_min")) / 20000.0
    box = F.array(F.col("longitude") - w, F.col("latitude") - h, F.col("longitude") + w, F.col("latitude") + h)
    return rounded(R.detection_stats(dets.withColumn("bbox_geo", F.when(F.col("source") != "cfar", box))))


@query("SELECT source, count(*) AS total, count(*) FILTER (WHERE on_land) AS on_land, count(*) FILTER (WHERE cluster_anomaly) AS anomaly, count(*) FILTER (WHERE on_land AND cluster_anomaly) AS both, count(*) FILTER (WHERE NOT on_land AND NOT cluster_anomaly) AS clean, round(avg(confidence), 6) AS avg_conf, min(confidence) AS min_conf, max(confidence) AS max_conf FROM fx_detections GROUP BY source", "fx_detections")
def a4_operational_metrics(dets):
    return rounded(R.operational_metrics(dets))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE source = 'fused') AS fused, round(count(*) FILTER (WHERE source = 'fused') / count(*), 6) AS agreement, round(count(*) FILTER (WHERE NOT on_land AND NOT cluster_anomaly AND source = 'cfar') / count(*) FILTER (WHERE NOT on_land AND NOT cluster_anomaly), 6) AS far_proxy FROM fx_detections", "fx_detections")
def a5_detector_agreement(dets):
    return rounded(R.detector_agreement(dets))


@query("SELECT e.id, e.num_detections, CAST(coalesce(n, 0) AS INT) AS actual FROM fx_executions e LEFT JOIN (SELECT execution_id, count(*) AS n FROM fx_detections GROUP BY 1) d ON d.execution_id = e.id WHERE e.num_detections IS DISTINCT FROM coalesce(n, 0)", "fx_executions", "fx_detections")
def a6_reconcile_run_stats(runs, dets):
    return R.reconcile_run_stats(runs, dets).select("id", "num_detections", "actual")


@query("SELECT scene_id, tile_index, count(*) AS n FROM fx_detections WHERE confidence > 0.5 GROUP BY ALL HAVING count(*) > 3 AND count(*) FILTER (WHERE source IN ('yolo', 'fused')) = 0", "fx_detections")
def a7_suspect_runs(dets):
    return R.suspect_runs(dets.where("confidence > 0.5"), 3).select("scene_id", "tile_index", "n")


statement("a8_collection_extent", "SELECT round(min(longitude), 6) AS lon_min, round(max(longitude), 6) AS lon_max, round(min(latitude), 6) AS lat_min, round(max(latitude), 6) AS lat_max, min(created_at) AS first_seen, max(created_at) AS last_seen, count(DISTINCT scene_id) AS scenes FROM fx_detections")


@query("SELECT run_id, count(*) AS n, max(ram_mb) AS peak_ram, round(avg(ram_mb), 6) AS avg_ram, max(cpu_pct) AS peak_cpu, round(avg(cpu_pct), 6) AS avg_cpu, round(quantile_cont(gap, 0.95), 4) AS p95_gap_s FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY ts, ram_mb, cpu_pct))) / 1e6 AS gap FROM fx_samples) t GROUP BY run_id", "fx_samples")
def a9_resource_summary(samples):
    out = R.resource_summary(samples)
    return out.select("run_id", "n", "peak_ram", F.round("avg_ram", 6).alias("avg_ram"), "peak_cpu", F.round("avg_cpu", 6).alias("avg_cpu"), F.round("p95_gap_s", 4).alias("p95_gap_s"))


@query("SELECT model_name, round(avg(inference_ms), 4) AS mean, round(stddev_pop(inference_ms), 4) AS std, min(inference_ms) AS min, max(inference_ms) AS max, round(quantile_cont(inference_ms, 0.5), 4) AS p50, round(quantile_cont(inference_ms, 0.95), 4) AS p95, round(quantile_cont(inference_ms, 0.99), 4) AS p99 FROM fx_executions GROUP BY model_name", "fx_executions")
def a10_latency_summary(runs):
    return rounded(R.latency_summary(runs, "inference_ms", "model_name"), 4)


statement("a11_value_report", "SELECT constraint_profile, count(*) AS runs, round(avg(image_size_mb), 4) AS avg_mb, round(avg(2 + num_detections / 2), 4) AS avg_kb, round(avg(image_size_mb) * 1024 / avg(2 + num_detections / 2), 3) AS ratio, round(sum(image_size_mb - (2 + num_detections / 2) / 1024) / 1024, 4) AS saved_gb FROM fx_executions WHERE image_size_mb > 0 AND status = 'success' GROUP BY constraint_profile")
_AREAS = [("strait", (-5.5053, 35.8, -5.4947, 36.1)), ("west", (-6.0, 35.0, -5.5003, 35.8997)), ("north", (-6.0, 35.8997, -5.0, 36.5))]
_SCENES = """SELECT *, CASE WHEN lon BETWEEN -5.5053 AND -5.4947 AND lat BETWEEN 35.8 AND 36.1 THEN 'strait' WHEN lon BETWEEN -6.0 AND -5.5003 AND lat BETWEEN 35.0 AND 35.8997 THEN 'west'
    WHEN lon BETWEEN -6.0 AND -5.0 AND lat BETWEEN 35.8997 AND 36.5 THEN 'north' ELSE 'other' END AS area, lon >= -5.5203 AND lon <= -5.4803 AND lat >= 35.8803 AND lat <= 35.9203 AS in_frame
    FROM (SELECT scene_id, count(*) AS n, count(*) FILTER (WHERE source <> 'cfar') AS n_vessels, median(latitude) AS lat, median(longitude) AS lon, min(longitude) AS lon_min, min(latitude) AS lat_min, max(longitude) AS lon_max,
    max(latitude) AS lat_max FROM fx_detections GROUP BY scene_id) m"""


def _scenes(dets):
    vessels = dets.select("scene_id", "latitude", "longitude", (F.col("source") != "cfar").alias("is_vessel"))
    return R.scene_summary(vessels, _AREAS, (-5.5203, 35.8803, -5.4803, 35.9203))


@query(f"SELECT scene_id, n, n_vessels, area, in_frame, round(lat, 6) AS lat, round(lon, 6) AS lon, round(lon_min, 6) AS lon_min, round(lat_min, 6) AS lat_min, round(lon_max, 6) AS lon_max, round(lat_max, 6) AS lat_max FROM ({_SCENES}) s", "fx_detections")
def a12_scene_summary(dets):
    return rounded(_scenes(dets))


@query(f"SELECT area, count(*) AS scenes, CAST(sum(n) AS BIGINT) AS detections, count(*) FILTER (WHERE in_frame) AS scenes_in_frame, CAST(coalesce(sum(n) FILTER (WHERE in_frame), 0) AS BIGINT) AS detections_in_frame FROM ({_SCENES}) s GROUP BY area", "fx_detections")
def a12_area_histogram(dets):
    return R.area_histogram(_scenes(dets))


@query(
    """WITH m AS (SELECT scene_id, count(*) AS n, avg(pixel) AS mp, avg(line) AS ml, avg(lon) AS mx, avg(lat) AS my FROM fx_gcps GROUP BY scene_id HAVING count(*) >= 4),
    s AS (SELECT g.scene_id, sum((pixel - mp) * (pixel - mp)) AS pp, sum((pixel - mp) * (line - ml)) AS pq, sum((line - ml) * (line - ml)) AS qq, sum((pixel - mp) * (lon - mx)) AS px, sum((line - ml) * (lon - mx)) AS qx, sum((pixel - mp) * (lat - my)) AS py, sum((line - ml) * (lat - my)) AS qy FROM fx_gcps g JOIN m ON g.scene_id = m.scene_id GROUP BY g.scene_id)
    SELECT s.scene_id, n, round((px * qq - qx * pq) / (pp * qq - pq * pq), 8) AS lon_per_pixel, round((qx * pp - px * pq) / (pp * qq - pq * pq), 8) AS lon_per_line, round((py * qq - qy * pq) / (pp * qq - pq * pq), 8) AS lat_per_pixel, round((qy * pp - py * pq) / (pp * qq - pq * pq), 8) AS lat_per_line FROM s JOIN m ON s.scene_id = m.scene_id""",
    "fx_gcps",
)
def a13_gcp_affine_fit(gcps):
    return rounded(R.gcp_affine_fit(gcps).select("scene_id", "n", "lon_per_pixel", "lon_per_line", "lat_per_pixel", "lat_per_line"), 8)


@query("SELECT scene_id, round(avg(20 + tile_index * 1.5), 6) AS incidence_mean, array_to_string(list_sort(list_distinct(list(source))), '+') AS polarisations FROM fx_detections GROUP BY scene_id", "fx_detections")
def a14_scene_modes(dets):
    seen = dets.select("scene_id", (20 + F.col("tile_index") * F.lit(1.5)).alias("incidence"), F.col("source").alias("polarisation"))
    return R.scene_modes(seen).withColumn("incidence_mean", F.round("incidence_mean", 6))


statement("a15_valid_area", "SELECT scene_id, round(CAST(count(CASE WHEN value > -1000 AND value <> 0 THEN 1 END) AS DOUBLE) * CAST(0.0001 AS DOUBLE), 6) AS km2 FROM fx_pixels GROUP BY scene_id")
statement(
    "a17_alerts_per_day",
    "SELECT date_trunc('day', created_at) AS day, metric, count(*) AS checks, count(CASE WHEN is_drifting THEN 1 END) AS alerts FROM fx_drift_checks GROUP BY date_trunc('day', created_at), metric",
    "SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS day, metric, count(*) AS checks, count(CASE WHEN is_drifting THEN 1 END) AS alerts FROM fx_drift_checks GROUP BY 1, 2",
)
statement(
    "a17_bitflip_curve",
    "SELECT model_variant, num_flips, round(avg(avg_detections), 6) AS avg_detections, round(avg(avg_confidence), 6) AS avg_confidence FROM fx_bitflips GROUP BY model_variant, num_flips",
)
statement(
    "a17_max_degradation",
    "SELECT model_variant, round(coalesce(least(100, max(CASE WHEN degradation_pct > 1 THEN degradation_pct ELSE degradation_pct * 100 END)), 0), 6) AS max_degradation FROM fx_bitflips GROUP BY model_variant",
)
statement(
    "a17_decision_totals",
    "SELECT CAST(coalesce(sum(process_count), 0) AS BIGINT) AS process, CAST(coalesce(sum(fallback_cfar_count), 0) AS BIGINT) AS fallback_cfar, CAST(coalesce(sum(skip_count), 0) AS BIGINT) AS skip FROM fx_orbit_runs",
)
statement("a18_ambiguous_models", "SELECT name, count(DISTINCT version) AS versions FROM fx_models GROUP BY name HAVING count(DISTINCT version) > 1")


def _scored(dets):
    return dets.select("det_id", "confidence", F.when(F.col("source") == "fused", 1).otherwise(0).alias("tp"))


@query("SELECT det_id, CAST(sum(CASE WHEN source = 'fused' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS tp_sum, round(CAST(sum(CASE WHEN source = 'fused' THEN 1 ELSE 0 END) OVER w AS DOUBLE) / count(*) OVER w, 6) AS precision FROM fx_detections WINDOW w AS (ORDER BY confidence DESC, det_id ROWS UNBOUNDED PRECEDING)", "fx_detections")
def w1_pr_curve(dets):
    scored = _scored(dets)
    return R.pr_curve(scored, scored.agg(F.sum("tp").alias("n_gt"))).select("det_id", "tp_sum", F.round("precision", 6).alias("precision"))


@query("SELECT round(sum(CASE WHEN tp = 1 THEN p / n END), 6) AS ap FROM (SELECT CASE WHEN source = 'fused' THEN 1 ELSE 0 END AS tp, CAST(sum(CASE WHEN source = 'fused' THEN 1 ELSE 0 END) OVER w AS DOUBLE) / count(*) OVER w AS p, count(*) FILTER (WHERE source = 'fused') OVER () AS n FROM fx_detections WINDOW w AS (ORDER BY confidence DESC, det_id ROWS UNBOUNDED PRECEDING)) t", "fx_detections")
def w2_average_precision(dets):
    scored = _scored(dets)
    return R.average_precision(R.pr_curve(scored, scored.agg(F.sum("tp").alias("n_gt")))).select(F.round("ap", 6).alias("ap"))


@query(
    """WITH r AS (SELECT model_name, num_detections AS x, avg_confidence AS c, row_number() OVER (PARTITION BY model_name ORDER BY created_at DESC, id DESC) AS k FROM fx_executions),
    s AS (SELECT model_name, avg(x) FILTER (WHERE k <= 20) AS xr, avg(x) FILTER (WHERE k > 20) AS xp, stddev_pop(x) FILTER (WHERE k > 20) AS xs, avg(c) FILTER (WHERE k <= 20) AS cr, avg(c) FILTER (WHERE k > 20) AS cp, stddev_pop(c) FILTER (WHERE k > 20) AS cs FROM r GROUP BY model_name),
    z AS (SELECT model_name, abs(xr - xp) / xs AS zn, abs(cr - cp) / cs AS zc FROM s)
    SELECT model_name, CASE WHEN zn > 0.2 THEN 'num_detections' WHEN zc > 0.2 THEN 'avg_confidence' ELSE 'num_detections' END AS metric, round(CASE WHEN zn > 0.2 OR zc <= 0.2 THEN zn ELSE zc END, 4) AS z_score FROM z""",
    "fx_executions",
)
def w3_drift_zscore(runs):
    return R.drift_zscore(runs, 20, 0.2).select("model_name", "metric", F.round("z_score", 4).alias("z_score"))


@query(
    """WITH m AS (SELECT model_name, constraint_profile AS profile, profile_rank, avg(num_detections) AS d FROM fx_executions e JOIN fx_profiles p ON e.constraint_profile = p.profile WHERE status = 'success' GROUP BY ALL),
    k AS (SELECT *, d / first_value(d) OVER (PARTITION BY model_name ORDER BY profile_rank) AS r FROM m)
    SELECT model_name, profile, round(r, 6) AS retention, min(CASE WHEN r < 0.995 THEN profile_rank END) OVER (PARTITION BY model_name) AS inflection_rank FROM k""",
    "fx_executions", "fx_profiles",
)
def w4_profile_retention(runs, profiles):
    return R.profile_retention(runs, profiles, 0.995).select("model_name", "profile", F.round("retention", 6).alias("retention"), "inflection_rank")


@query("SELECT scene_id, det_id, k AS rn FROM (SELECT scene_id, det_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY confidence DESC, det_id) AS INT) AS k FROM fx_detections) t WHERE k <= 12", "fx_detections")
def w5_top_detections_per_run(dets):
    return R.top_per_group(dets, "scene_id", 12, F.desc("confidence"), F.col("det_id")).select("scene_id", "det_id", "rn")


@query("SELECT execution_id, det_id FROM (SELECT execution_id, det_id, row_number() OVER (PARTITION BY execution_id ORDER BY sha256(concat(CAST(det_id AS VARCHAR), 'seed')), det_id) AS q FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY confidence DESC, det_id) AS k FROM fx_detections WHERE NOT on_land AND NOT cluster_anomaly) t WHERE k <= 6) u WHERE q <= 2", "fx_detections")
def w6_sample_detections(dets):
    return R.sample_detections(dets, 2, "seed").select("execution_id", "det_id")


@query("SELECT c.id, CASE WHEN p.id IS NULL THEN c.status ELSE 'processing' END AS status, c.attempts + CASE WHEN p.id IS NULL THEN 0 ELSE 1 END AS attempts FROM fx_cues c LEFT JOIN (SELECT id FROM fx_cues WHERE status = 'pending' AND attempts < max_attempts ORDER BY priority DESC, created_at, id LIMIT 25) p ON c.id = p.id", "fx_cues")
def w7_claim_cues(cues):
    return R.claim_cues(cues, 25).select("id", "status", "attempts")


statement("w8_latest_run", "SELECT model_name, max_by(id, struct(created_at, id)) AS latest FROM fx_executions GROUP BY model_name", "SELECT model_name, arg_max(id, (created_at, id)) AS latest FROM fx_executions GROUP BY model_name")
statement(
    "w9_unnest_timeline",
    "SELECT id, pos, timestampadd(MINUTE, pos + 1, created_at) AS at, wh FROM (SELECT id, created_at, posexplode(array(t0, t1, final_battery_wh)) AS (pos, wh) FROM fx_orbit_runs) t",
    "SELECT id, CAST(pos AS INT) AS pos, created_at + to_minutes(pos + 1) AS at, wh FROM (SELECT id, created_at, generate_subscripts([t0, t1, final_battery_wh], 1) - 1 AS pos, unnest([t0, t1, final_battery_wh]) AS wh FROM fx_orbit_runs) t",
)
statement("w10_scenario_rank", "SELECT l.link, round(avg(e.image_size_mb * 8 / l.mbps), 4) AS raw_s, CAST(rank() OVER (ORDER BY avg(e.image_size_mb * 8 / l.mbps)) AS INT) AS place FROM fx_executions e CROSS JOIN fx_links l GROUP BY l.link")


@query("SELECT e.id, p.processor, inference_ms / 1000 * tdp_watts * least(cpu_usage_pct / 100, 1.0) AS joules, inference_ms / 1000 * tdp_watts * least(cpu_usage_pct / 100, 1.0) / 3600 AS wh FROM fx_executions e, fx_processors p", "fx_executions", "fx_processors")
def e1_run_energy(runs, processors):
    return R.run_energy(runs, processors).select("id", "processor", "joules", "wh")


statement("e2_inference_energy", "SELECT e.model_name, p.processor, round(avg(inference_ms) / 1000 * avg(coalesce(cpu_usage_pct, 50)) / 100 * 4 * max(tdp_watts), 3) AS joules, round(avg(inference_ms) / 1000 * avg(coalesce(cpu_usage_pct, 50)) / 100 * 4 * max(tdp_watts) / 3600 / 60 * 100, 5) AS battery_pct FROM fx_executions e CROSS JOIN fx_processors p WHERE status = 'success' GROUP BY e.model_name, p.processor")
_JOULES = "avg(inference_ms) / 1000 * avg(coalesce(cpu_usage_pct, 50)) / 100 * 4 * max(tdp_watts)"
statement(
    "e2_compare_processors",
    f"SELECT model_name, processor, round({_JOULES}, 3) AS joules, CAST(row_number() OVER (PARTITION BY model_name ORDER BY {_JOULES}, processor) AS INT) AS place FROM fx_executions e CROSS JOIN fx_processors p WHERE status = 'success' GROUP BY model_name, processor",
)
statement(
    "e2_extrapolated_energy",
    "SELECT e.model_name, t.processor AS target, round(avg(inference_ms) / 1000 * avg(coalesce(cpu_usage_pct, 50)) / 100 * 4 * max(t.tdp_watts), 3) AS joules, round(max(t.tdp_watts) / max(m.tdp_watts), 6) AS ratio_to_measured FROM fx_executions e CROSS JOIN fx_processors m CROSS JOIN fx_processors t WHERE status = 'success' AND m.processor = 'oci_arm_a1' AND t.processor <> 'oci_arm_a1' GROUP BY e.model_name, t.processor",
)
statement(
    "e2_tops_per_watt",
    "SELECT model_name, processor, round(CASE WHEN avg(inference_ms) > 0 AND max(tdp_watts) > 0 THEN max(model_size_mb) * 2.0E9 / (avg(inference_ms) / 1000) / 1.0E12 / max(tdp_watts) ELSE 0 END, 9) AS tops_per_watt FROM fx_executions e CROSS JOIN fx_processors p WHERE status = 'success' GROUP BY model_name, processor",
)


@query("SELECT model_name, satellite, round(payload_w * period_min / 60 * sunlit, 6) AS available_wh, CAST(floor(payload_w * period_min / 60 * sunlit / (j / 3600)) AS BIGINT) AS max_images, floor(payload_w * period_min / 60 * sunlit / (j / 3600)) >= 1 AS feasible FROM (SELECT model_name, avg(inference_ms) / 100000 AS j FROM fx_executions GROUP BY model_name) e, fx_satellites s", "fx_executions", "fx_satellites")
def e3_orbit_budget(runs, satellites):
    energy = runs.groupBy("model_name").agg((F.avg("inference_ms") / 100000).alias("joules"))
    return R.orbit_budget(energy, satellites).select("model_name", "satellite", F.round("available_wh", 6).alias("available_wh"), "max_images", "feasible")


statement("e4_profile_energy", "SELECT e.id, least(greatest(cpu_usage_pct / (100 * cpu_limit), 0), 1) * tdp_watts * inference_ms / 1000 AS joules FROM fx_executions e LEFT JOIN fx_profiles p ON e.constraint_profile = p.profile")


@query("SELECT e.id, l.link, round(image_size_mb / (mbps / 8), 4) AS raw_s, round((2.0 + 0.5 * num_detections + 55) / 1024 / (mbps / 8), 6) AS small_s, round(image_size_mb * 1024 / (2.0 + 0.5 * num_detections + 55), 3) AS ratio, round((1 - (2.0 + 0.5 * num_detections + 55) / (image_size_mb * 1024)) * 100, 4) AS saving_pct FROM fx_executions e, fx_links l", "fx_executions", "fx_links")
def e5_downlink(runs, links):
    out = R.downlink(runs.select("id", "image_size_mb", "num_detections"), links, 2.0 + 0.5 * F.col("num_detections"))
    return out.select("id", "link", F.round("raw_s", 4).alias("raw_s"), F.round("small_s", 6).alias("small_s"), F.round("ratio", 3).alias("ratio"), F.round("saving_pct", 4).alias("saving_pct"))


statement("e6_daily_capacity", "SELECT e.model_name, l.link, round(max(mbps) / 8 * max(window_min) * 60 * max(passes) / avg(image_size_mb), 3) AS capacity, max(mbps) / 8 * max(window_min) * 60 * max(passes) / avg(image_size_mb) >= 50 AS keeps_up, round(greatest(0, 50 - max(mbps) / 8 * max(window_min) * 60 * max(passes) / avg(image_size_mb)), 3) AS backlog FROM fx_executions e CROSS JOIN fx_links l GROUP BY e.model_name, l.link")
_LAT = "SELECT id, orbit, link, chain, period_min * 15 + image_size_mb / (mbps / 8) + (ingest_min + processing_min + dissemination_min) * 60 AS a, inference_ms / 1000 + period_min * 15 + (2.0 + 0.5 * num_detections) / 1024 / (mbps / 8) + 120 AS b FROM fx_executions, fx_orbits, fx_links, fx_chains"


@query(f"SELECT orbit, link, chain, round(avg(a), 3) AS without_s, round(avg(b), 3) AS with_s, round(avg(a / b), 4) AS speed_up FROM ({_LAT}) t GROUP BY ALL", "fx_executions", "fx_orbits", "fx_links", "fx_chains")
def e7_latency_scenarios(runs, orbits, links, chains):
    out = R.latency_scenarios(runs, orbits, links, chains, 2.0 + 0.5 * F.col("num_detections"))
    return rounded(out.groupBy("orbit", "link", "chain").agg(F.round(F.avg("without_s"), 3).alias("without_s"), F.round(F.avg("with_s"), 3).alias("with_s"), F.round(F.avg("speed_up"), 4).alias("speed_up")))


@query("SELECT id, round(inference_ms / 3600 * 20 * 1.852, 4) AS km, CASE WHEN inference_ms / 3600 * 20 * 1.852 < 10 THEN 'high' WHEN inference_ms / 3600 * 20 * 1.852 < 50 THEN 'medium' ELSE 'low' END AS action FROM fx_executions", "fx_executions")
def e8_actionability(runs):
    km = R.moved_km(F.col("inference_ms"))
    return runs.select("id", F.round(km, 4).alias("km"), R.actionability(km).alias("action"))


_REQ = "SELECT id AS req_id, peak_ram_mb / 40 AS ram_mb, cpu_usage_pct / 100000 AS energy_wh, CAST(0.004 AS DOUBLE) AS battery_wh, num_detections % 3 AS priority FROM fx_executions"


@query(
    f"""WITH r AS ({_REQ}), m AS (SELECT name, max(size_mb) AS size_mb FROM fx_models GROUP BY name),
    f AS (SELECT req_id, name, row_number() OVER (PARTITION BY req_id ORDER BY CASE WHEN priority = 2 THEN -size_mb * 5 WHEN priority = 1 THEN size_mb ELSE round(size_mb / (size_mb * 0.00005), 3) END DESC, name DESC) AS k FROM r JOIN m ON size_mb * 3 <= ram_mb AND size_mb * 0.00005 <= energy_wh WHERE energy_wh / battery_wh * 100 >= 20)
    SELECT r.req_id, CASE WHEN energy_wh / battery_wh * 100 < 20 THEN 'skip' WHEN f.name IS NOT NULL THEN 'process' WHEN energy_wh >= 0.00001 THEN 'fallback_cfar' ELSE 'skip' END AS action, CASE WHEN energy_wh / battery_wh * 100 < 20 THEN NULL WHEN f.name IS NOT NULL THEN f.name WHEN energy_wh >= 0.00001 THEN 'cfar' END AS model FROM r LEFT JOIN f ON r.req_id = f.req_id AND k = 1""",
    "fx_executions", "fx_models",
)
def e9_select_model(runs, models):
    requests = runs.select(F.col("id").alias("req_id"), (F.col("peak_ram_mb") / 40).alias("ram_mb"), (F.col("cpu_usage_pct") / 100000).alias("energy_wh"), F.lit(0.004).alias("battery_wh"), (F.col("num_detections") % 3).alias("priority"))
    return R.select_model(requests, models.groupBy("name").agg(F.max("size_mb").alias("size_mb")))


@query("SELECT p.profile, coalesce(n, 0) AS runs, CASE WHEN coalesce(n, 0) = 0 THEN 'NO DATA' WHEN ok = 0 THEN 'FAIL_RUN' WHEN ram > memory_mb THEN 'FAIL_RAM' WHEN cpu > cpu_limit * 100 THEN 'WARN_CPU' ELSE 'PASS' END AS verdict FROM fx_profiles p LEFT JOIN (SELECT constraint_profile, count(*) AS n, count(*) FILTER (WHERE status = 'success') AS ok, max(peak_ram_mb) AS ram, avg(cpu_usage_pct) AS cpu FROM fx_executions GROUP BY 1) s ON p.profile = s.constraint_profile", "fx_profiles", "fx_executions")
def e10_budget_verdict(profiles, runs):
    return R.budget_verdict(profiles, runs)


statement("e11_over_budget_note", "SELECT e.id, concat('peak RAM ', CAST(CAST(floor(peak_ram_mb) AS INT) AS STRING), ' MB over ', CAST(CAST(floor(memory_mb) AS INT) AS STRING), ' MB') AS note FROM fx_executions e JOIN fx_profiles p ON e.constraint_profile = p.profile WHERE peak_ram_mb > memory_mb")
