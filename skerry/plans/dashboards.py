"""Reports on the stored runs, detections and cues. Most are one statement that both engines run."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.operators import runs as R

from .registry import query, statement

_KB = "(2 + num_detections / 2)"

statement("d1_counts", "SELECT (SELECT count(*) FROM fx_executions) AS runs, (SELECT count(*) FROM fx_detections) AS detections, (SELECT count(*) FROM fx_detections WHERE NOT on_land AND NOT cluster_anomaly) AS clean, (SELECT count(*) FROM fx_cues) AS cues")
statement("d1_last_run_age", "SELECT model_name, max(created_at) AS last_run, CASE WHEN max(created_at) < TIMESTAMP '1998-08-01' THEN 'stale' ELSE 'fresh' END AS age FROM fx_executions GROUP BY model_name")
statement("d2_map_rows", "SELECT d.det_id, d.longitude, d.latitude, d.confidence, d.source, e.model_name FROM fx_detections d JOIN fx_executions e ON d.execution_id = e.id WHERE e.status = 'success' AND NOT d.on_land AND NOT d.cluster_anomaly AND d.confidence >= 0.3")
statement("d2_by_source", "SELECT source, count(*) AS n, count(DISTINCT execution_id) AS runs, round(avg(confidence), 6) AS avg_confidence, min(created_at) AS first_seen, max(created_at) AS last_seen FROM fx_detections GROUP BY source")
statement("d3_best_chips", "SELECT det_id, scene_id, confidence FROM fx_detections WHERE NOT on_land AND NOT cluster_anomaly AND source <> 'cfar' ORDER BY confidence DESC, det_id LIMIT 24")
statement("d3_scenes_processed", "SELECT scene_id, count(*) AS detections, max(created_at) AS last_seen FROM fx_detections GROUP BY scene_id")


@query(
    "SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS day, round(quantile_cont(inference_ms, 0.5), 5) AS p50, round(quantile_cont(inference_ms, 0.95), 5) AS p95, round(quantile_cont(inference_ms, 0.99), 5) AS p99 FROM fx_executions GROUP BY 1",
    "fx_executions",
)
def d4_daily_percentiles(runs):
    return R.daily_percentiles(runs).select("day", *[F.round(c, 5).alias(c) for c in ("p50", "p95", "p99")])


statement("d5_detections_per_run_source", "SELECT execution_id, source, count(*) AS n FROM fx_detections GROUP BY execution_id, source")
statement("d5_error_rate", "SELECT constraint_profile, round(CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0), 6) AS error_rate, concat(CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS STRING), '/', CAST(count(*) AS STRING)) AS done FROM fx_executions GROUP BY constraint_profile")
statement("d5_model_sizes", "SELECT model_name, model_version, max(model_size_mb) AS size_mb FROM fx_executions GROUP BY model_name, model_version")
statement("d5_last_runs", "SELECT id, created_at, model_name, status FROM fx_executions ORDER BY created_at DESC, id DESC LIMIT 20")
# The quality of a variant comes from its own validation runs: the key is the outer row's technique.
statement(
    "d6_variant_matrix",
    "SELECT e.model_name, e.compression_technique, e.runs, e.minutes, e.ram, e.size_mb, v.pd, v.map FROM (SELECT model_name, compression_technique, count(*) AS runs, round(avg(inference_ms) / 60000, 5) AS minutes, round(avg(peak_ram_mb), 4) AS ram, max(model_size_mb) AS size_mb FROM fx_executions WHERE status = 'success' GROUP BY model_name, compression_technique) e LEFT JOIN (SELECT model_name, compression_technique, round(avg(pd), 6) AS pd, round(avg(map), 6) AS map FROM fx_validation GROUP BY model_name, compression_technique) v ON e.model_name = v.model_name AND e.compression_technique = v.compression_technique",
)
statement("d7_by_profile", "SELECT p.profile_rank, p.profile, count(*) AS runs, round(avg(inference_ms) / 60000, 5) AS minutes, round(max(peak_ram_mb), 4) AS ram, round(avg(num_detections), 5) AS detections, round(avg(cpu_usage_pct), 5) AS cpu FROM fx_executions e JOIN fx_profiles p ON e.constraint_profile = p.profile GROUP BY p.profile_rank, p.profile")
statement("d8_provenance_totals", "SELECT count(*) AS runs, round(100 * CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 5) AS success_pct, count(DISTINCT image_id) AS images, count(DISTINCT model_name) AS models FROM fx_executions")
statement(
    "d8_hourly_status",
    "SELECT CAST(date_trunc('hour', created_at) AS TIMESTAMP_NTZ) AS hour, count(CASE WHEN status = 'success' THEN 1 END) AS success, count(CASE WHEN status = 'error' THEN 1 END) AS error FROM fx_executions GROUP BY 1",
    "SELECT CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour, count(CASE WHEN status = 'success' THEN 1 END) AS success, count(CASE WHEN status = 'error' THEN 1 END) AS error FROM fx_executions GROUP BY 1",
)
statement("d9_compression", f"SELECT model_name, count(*) AS processed, round(sum(image_size_mb) * 1024 / sum({_KB}), 4) AS ratio, round(sum(image_size_mb - {_KB} / 1024) / 1024, 5) AS saved_gb FROM fx_executions WHERE image_size_mb > 0 GROUP BY model_name")
statement("d9_links", f"SELECT l.link, round(avg(image_size_mb) * 8 / max(mbps) / 60, 5) AS raw_min, round(avg({_KB}) * 8 / 1024 / max(mbps), 6) AS small_s FROM fx_executions e CROSS JOIN fx_links l GROUP BY l.link")
statement("d9_bytes_formula", "SELECT model_name, round(avg((200 + 300 * num_detections) / CAST(1024 AS DOUBLE)), 6) AS kb FROM fx_executions GROUP BY model_name")
statement("d10_speed_up", f"SELECT o.orbit, c.chain, round(avg((period_min * 15 + image_size_mb * 8 / 100 + (ingest_min + processing_min + dissemination_min) * 60) / (inference_ms / 1000 + period_min * 15 + {_KB} * 8 / 1024 / 100 + 120)), 5) AS speed_up FROM fx_executions e CROSS JOIN fx_orbits o CROSS JOIN fx_chains c GROUP BY o.orbit, c.chain")
statement("d10_orbit_stack", "SELECT orbit, 'wait' AS part, period_min * 15 AS seconds FROM fx_orbits UNION ALL SELECT chain, 'ground' AS part, (ingest_min + processing_min + dissemination_min) * 60 AS seconds FROM fx_chains UNION ALL SELECT model_name, 'inference' AS part, round(avg(inference_ms) / 1000, 5) AS seconds FROM fx_executions GROUP BY model_name")
statement("d11_retries", "SELECT target_zone, max(attempts) AS most, round(avg(CAST(attempts AS DOUBLE)), 6) AS mean, count(CASE WHEN attempts >= max_attempts THEN 1 END) AS spent FROM fx_cues GROUP BY target_zone")
statement("d12_cues", "SELECT target_zone, count(*) AS total, count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(CASE WHEN status = 'completed' THEN 1 END) AS completed FROM fx_cues GROUP BY target_zone")
statement("d12_chain_list", "SELECT id, target_zone, priority, triggered_by, execution_id FROM fx_cues WHERE execution_id IS NOT NULL ORDER BY created_at DESC, id LIMIT 8")
statement("d13_evidence", "SELECT model_name, count(*) AS runs, round(avg(CASE WHEN status = 'error' THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS error_rate, count(DISTINCT image_id) AS scenes, max(created_at) AS last_run, max(CASE WHEN status = 'success' THEN created_at END) AS last_success FROM fx_executions GROUP BY model_name")
statement("d13_scenes", "SELECT e.image_id, count(DISTINCT e.id) AS runs, count(d.det_id) AS detections FROM fx_executions e LEFT JOIN fx_detections d ON d.execution_id = e.id GROUP BY e.image_id")
statement("d8_execution_log", "SELECT id, created_at, image_id, model_name, model_version, compression_technique, constraint_profile AS profile, num_detections AS detections, round(avg_confidence, 3) AS avg_confidence, round(inference_ms, 1) AS latency_ms, status FROM fx_executions ORDER BY created_at DESC, id LIMIT 100")
statement("d8_hash_detail", "SELECT id AS execution_id, created_at, image_id, sha2(image_id, 256) AS image_hash, model_name, sha2(concat(model_name, model_version), 256) AS model_hash, constraint_profile AS profile, status FROM fx_executions WHERE status <> 'pending' ORDER BY created_at DESC, id LIMIT 100", "SELECT id AS execution_id, created_at, image_id, sha256(image_id) AS image_hash, model_name, sha256(concat(model_name, model_version)) AS model_hash, constraint_profile AS profile, status FROM fx_executions WHERE status <> 'pending' ORDER BY created_at DESC, id LIMIT 100")
statement("d10_km_moved", "SELECT model_name, round((avg(inference_ms) / 60000 + 5) * 0.617, 3) AS with_km, round(415 * 0.617 + 0 * count(*), 3) AS without_km FROM fx_executions WHERE status = 'success' GROUP BY model_name")
statement("d10_mean_ms", "SELECT round(avg(inference_ms), 2) AS avg_inference_ms FROM fx_executions WHERE status = 'success' AND inference_ms IS NOT NULL")
statement("d10_orbit_chain_table", "SELECT orbit, chain, round(avg(image_size_mb), 4) AS image_mb, round(avg(inference_ms) / 60000 + max(period_min) / 4 + 2, 4) AS with_min, round(max(period_min) / 4 + avg(image_size_mb) * 8 / 50 / 60 + max(ingest_min + processing_min + dissemination_min), 4) AS without_min FROM fx_executions e CROSS JOIN fx_orbits o CROSS JOIN fx_chains c WHERE status = 'success' GROUP BY orbit, chain")
statement("d11_last_battery", "SELECT max_by(final_battery_wh, struct(created_at, id)) AS final_battery_wh FROM fx_orbit_runs", "SELECT arg_max(final_battery_wh, (created_at, id)) AS final_battery_wh FROM fx_orbit_runs")
statement("d11_alert_list", "SELECT id, created_at, metric, is_drifting, round(z_score, 2) AS z_score FROM fx_drift_checks ORDER BY created_at DESC, id LIMIT 50")
statement("d11_decision_mix", "SELECT date_trunc('day', created_at) AS day, CAST(sum(process_count) AS BIGINT) AS process, CAST(sum(fallback_cfar_count) AS BIGINT) AS fallback_cfar, CAST(sum(skip_count) AS BIGINT) AS skip FROM fx_orbit_runs GROUP BY date_trunc('day', created_at)", "SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS day, CAST(sum(process_count) AS BIGINT) AS process, CAST(sum(fallback_cfar_count) AS BIGINT) AS fallback_cfar, CAST(sum(skip_count) AS BIGINT) AS skip FROM fx_orbit_runs GROUP BY 1")
statement("d12_mean_trigger_size", "SELECT status, round(avg(n), 4) AS mean_size FROM (SELECT c.status, c.id, count(d.det_id) AS n FROM fx_cues c LEFT JOIN fx_detections d ON d.execution_id = c.triggered_by AND d.quality_verdict = 'valid_sea_target' GROUP BY c.status, c.id) t GROUP BY status")
statement("d13_targets", "SELECT model_name, count(*) AS targets FROM fx_detections d JOIN fx_executions e ON d.execution_id = e.id WHERE e.status = 'success' AND d.quality_verdict = 'valid_sea_target' GROUP BY model_name")
statement("d13_budget", "SELECT p.profile, count(e.id) AS runs, round(avg(inference_ms) / 60000, 5) AS avg_latency_min, round(avg(peak_ram_mb), 4) AS avg_ram_mb, max(p.memory_mb) AS ram_budget_mb, CASE WHEN count(e.id) = 0 THEN 'NO DATA' WHEN avg(peak_ram_mb) > max(p.memory_mb) THEN 'FAIL_RAM' ELSE 'PASS' END AS verdict FROM fx_profiles p LEFT JOIN fx_executions e ON e.constraint_profile = p.profile AND e.status = 'success' GROUP BY p.profile")
statement("d13_models", "SELECT e.model_name, e.model_version, e.compression_technique, round(avg(model_size_mb), 1) AS size_mb, count(CASE WHEN status = 'success' THEN 1 END) AS success_runs, round(avg(CASE WHEN status = 'success' THEN inference_ms END) / 60000, 5) AS avg_latency_min, max(v.map) AS validation_map FROM fx_executions e LEFT JOIN (SELECT model_name, compression_technique, round(avg(map), 4) AS map FROM fx_validation GROUP BY model_name, compression_technique) v ON v.model_name = e.model_name AND v.compression_technique = e.compression_technique GROUP BY e.model_name, e.model_version, e.compression_technique")
statement("d13_last_ten", "SELECT created_at AS run_at, id, model_name, constraint_profile AS profile, num_detections, round(inference_ms / 60000, 4) AS inference_min FROM fx_executions WHERE status = 'success' ORDER BY created_at DESC, id LIMIT 10")
