"""Inputs for the operators in the shape of a detection archive, as views over the test tables.

The SQL runs alike in Spark and in the oracle engine; see FIXTURES.md."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    "fx_executions": """
SELECT o_orderkey AS id, o_orderdate AS created_at,
       concat('scene-', CAST(o_custkey % 100 AS STRING)) AS image_id,
       CASE o_custkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'cfar-default' END AS model_name,
       CASE o_custkey % 2 WHEN 0 THEN 'v1.0' ELSE 'int8-dynamic' END AS model_version,
       CASE o_custkey % 2 WHEN 0 THEN 'none' ELSE 'dynamic_int8' END AS compression_technique,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'ground' WHEN '2-HIGH' THEN 'sat-high'
            WHEN '3-MEDIUM' THEN 'sat-mid' WHEN '4-NOT SPECIFIED' THEN 'sat-low' ELSE 'sat-extreme' END AS constraint_profile,
       CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'error' ELSE 'pending' END AS status,
       CASE o_custkey % 2 WHEN 0 THEN CAST(50 AS DOUBLE) ELSE CAST(25 AS DOUBLE) END AS model_size_mb,
       o_totalprice AS inference_ms,
       CAST(500 + o_custkey % 1000 AS DOUBLE) AS image_size_mb,
       CAST(o_orderkey % 6000 AS DOUBLE) AS peak_ram_mb,
       CAST(o_orderkey % 400 AS DOUBLE) AS cpu_usage_pct,
       CAST(o_orderkey % 50 AS INT) AS num_detections,
       CAST(o_custkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS avg_confidence
FROM orders""",
    "fx_detections": """
SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS det_id,
       l_orderkey AS execution_id, l_suppkey AS scene_id, l_shipdate AS created_at,
       CAST(l_partkey % 16 AS INT) AS tile_index,
       CAST((l_partkey * 37) % 600 AS DOUBLE) AS x_min,
       CAST((l_orderkey * 53 + l_linenumber * 11) % 600 AS DOUBLE) AS y_min,
       CAST((l_partkey * 37) % 600 AS DOUBLE) + CAST(4 AS DOUBLE) + floor(l_quantity) AS x_max,
       CAST((l_orderkey * 53 + l_linenumber * 11) % 600 AS DOUBLE) + CAST(4 AS DOUBLE) + CAST(l_partkey % 30 AS DOUBLE) AS y_max,
       CAST(-6 AS DOUBLE) + CAST(l_partkey % 500 AS DOUBLE) * CAST(0.002 AS DOUBLE) AS longitude,
       CAST(35.5 AS DOUBLE) + CAST(l_orderkey % 400 AS DOUBLE) * CAST(0.002 AS DOUBLE) AS latitude,
       (floor(l_extendedprice) % 1000) / CAST(1000 AS DOUBLE) AS confidence,
       CASE l_returnflag WHEN 'A' THEN 'yolo' WHEN 'R' THEN 'fused' ELSE 'cfar' END AS source,
       (floor(l_extendedprice) % 1000) / CAST(100 AS DOUBLE) AS snr,
       CASE WHEN l_partkey % 11 = 0 THEN 'land_artifact' WHEN l_partkey % 13 = 0 THEN 'cluster_artifact'
            WHEN l_returnflag IN ('A', 'R') THEN 'valid_sea_target' ELSE 'candidate' END AS quality_verdict,
       CASE WHEN l_partkey % 11 = 0 THEN TRUE ELSE FALSE END AS on_land,
       CASE WHEN l_partkey % 13 = 0 THEN TRUE ELSE FALSE END AS cluster_anomaly
FROM lineitem""",
    "fx_ground_truth": """
SELECT det_id AS gt_id, scene_id,
       x_min + CAST(det_id % 3 AS DOUBLE) AS x_min, y_min + CAST(det_id % 2 AS DOUBLE) AS y_min,
       x_max + CAST(det_id % 3 AS DOUBLE) AS x_max, y_max + CAST(det_id % 2 AS DOUBLE) AS y_max
FROM fx_detections WHERE tile_index = 3""",
    "fx_cues": """
SELECT event_id AS id, ts AS created_at, concat('zone-', CAST(user_id % 5 AS STRING)) AS target_zone,
       CAST(event_id % 3 AS INT) AS priority,
       CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed'
            WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
       CAST(user_id % 4 AS INT) AS attempts, 3 AS max_attempts,
       event_id AS triggered_by, CASE WHEN event_type = 'purchase' THEN event_id + 1 ELSE NULL END AS execution_id
FROM events""",
    "fx_pixels": """
SELECT CAST(0 AS BIGINT) AS scene_id, CAST(floor(event_id / 100) AS INT) AS px_row, CAST(event_id % 100 AS INT) AS px_col, value
FROM events""",
    "fx_two_scenes": """
SELECT CAST(event_id % 2 AS BIGINT) AS scene_id, CAST(floor(floor(event_id / 2) / 100) AS INT) AS px_row, CAST(floor(event_id / 2) % 100 AS INT) AS px_col, value
FROM events""",
    "fx_transforms": """
SELECT DISTINCT scene_id, CAST(640 * 4 AS BIGINT) AS n_rows, CAST(640 * 4 AS BIGINT) AS n_cols,
       CAST(-6 AS DOUBLE) AS c0, CAST(0.0002 AS DOUBLE) AS c1, CAST(scene_id % 5 AS DOUBLE) * CAST(0.00001 AS DOUBLE) AS c2,
       CAST(36.2 AS DOUBLE) AS f0, CAST(scene_id % 3 AS DOUBLE) * CAST(0.00001 AS DOUBLE) AS f1, CAST(-0.0002 AS DOUBLE) AS f2
FROM fx_detections""",
    "fx_bitflips": """
SELECT event_id AS id, ts AS created_at, event_type AS model_variant, CAST(user_id % 8 AS INT) AS num_flips,
       value AS avg_detections, value / CAST(100 AS DOUBLE) AS avg_confidence, value / CAST(80 AS DOUBLE) AS degradation_pct
FROM events""",
    "fx_orbit_runs": """
SELECT event_id AS id, ts AS created_at, event_id % 7 AS process_count, event_id % 5 AS fallback_cfar_count, event_id % 3 AS skip_count,
       value AS t0, value * CAST(0.75 AS DOUBLE) AS t1, value * CAST(0.5 AS DOUBLE) AS final_battery_wh
FROM events""",
    "fx_drift_checks": """
SELECT event_id AS id, ts AS created_at, value > 70 AS is_drifting, value / CAST(20 AS DOUBLE) AS z_score,
       CASE WHEN user_id % 2 = 0 THEN 'num_detections' ELSE 'avg_confidence' END AS metric
FROM events""",
    "fx_samples": """
SELECT user_id AS run_id, ts, value AS ram_mb, CAST(event_id % 400 AS DOUBLE) AS cpu_pct FROM events""",
    "fx_gcps": """
SELECT p_partkey % 20 AS scene_id, CAST(p_size * 100 AS DOUBLE) AS line, CAST((p_partkey * 7) % 2500 AS DOUBLE) AS pixel,
       CAST(-6 AS DOUBLE) + CAST((p_partkey * 7) % 2500 AS DOUBLE) * CAST(0.0001 AS DOUBLE) + CAST(p_size * 100 AS DOUBLE) * CAST(0.00002 AS DOUBLE) AS lon,
       CAST(37 AS DOUBLE) + CAST((p_partkey * 7) % 2500 AS DOUBLE) * CAST(0.00002 AS DOUBLE) - CAST(p_size * 100 AS DOUBLE) * CAST(0.0001 AS DOUBLE) AS lat
FROM part""",
    "fx_land": """
SELECT DISTINCT CAST(floor(longitude / CAST(0.05 AS DOUBLE)) AS INT) AS cell_x,
       CAST(floor(latitude / CAST(0.05 AS DOUBLE)) AS INT) AS cell_y
FROM fx_detections WHERE scene_id % 7 = 0 AND tile_index = 1""",
    "fx_zones": """
SELECT * FROM (VALUES ('strait', CAST(-5.6 AS DOUBLE), CAST(35.8 AS DOUBLE), CAST(-5.3 AS DOUBLE), CAST(36.1 AS DOUBLE), 1, 'west'),
                      ('port',   CAST(-5.5 AS DOUBLE), CAST(36.05 AS DOUBLE), CAST(-5.35 AS DOUBLE), CAST(36.15 AS DOUBLE), 1, 'west'),
                      ('patrol', CAST(10 AS DOUBLE), CAST(33 AS DOUBLE), CAST(16 AS DOUBLE), CAST(38 AS DOUBLE), 0, 'central'))
     AS z(zone_id, lon_min, lat_min, lon_max, lat_max, priority, search_zone)""",
    "fx_lut": """
SELECT * FROM (VALUES (CAST(0 AS BIGINT), 0, CAST(400 AS DOUBLE)), (CAST(0 AS BIGINT), 30, CAST(420 AS DOUBLE)),
                      (CAST(0 AS BIGINT), 60, CAST(410 AS DOUBLE)), (CAST(0 AS BIGINT), 90, CAST(450 AS DOUBLE)))
     AS l(scene_id, line, sigma)""",
    "fx_processors": """
SELECT * FROM (VALUES ('oci_arm_a1', 3.0D0), ('xilinx_zynq_ultrascale', 5.0D0), ('intel_myriad_x', 1.5D0), ('google_coral_tpu', 2.0D0),
                      ('nvidia_jetson_nano', 5.0D0), ('raspberry_pi4_arm', 3.5D0), ('leon3_gr740', 1.5D0), ('unibap_ix10', 15.0D0))
     AS p(processor, tdp_watts)""",
    "fx_satellites": """
SELECT * FROM (VALUES ('cubesat_3u', 2.0D0, 30.0D0, 95.0D0, 0.6D0), ('cubesat_6u', 5.0D0, 60.0D0, 95.0D0, 0.6D0),
                      ('small_sat', 30.0D0, 300.0D0, 100.0D0, 0.6D0), ('medium_sat', 100.0D0, 2000.0D0, 100.0D0, 0.6D0))
     AS s(satellite, payload_w, battery_wh, period_min, sunlit)""",
    "fx_links": """
SELECT * FROM (VALUES ('cubesat_uhf', 0.009D0, 8.0D0, 4.0D0), ('cubesat_sband', 2.0D0, 8.0D0, 4.0D0), ('smallsat_xband', 100.0D0, 10.0D0, 6.0D0), ('highcap_ka', 800.0D0, 10.0D0, 8.0D0))
     AS d(link, mbps, window_min, passes)""",
    "fx_orbits": """
SELECT * FROM (VALUES ('leo_500', 94.6D0), ('sso_700', 98.8D0), ('leo_350_isstyle', 91.4D0)) AS o(orbit, period_min)""",
    "fx_chains": """
SELECT * FROM (VALUES ('fast_automated', 5.0D0, 10.0D0, 2.0D0), ('standard_nrt', 15.0D0, 30.0D0, 10.0D0), ('manual_analysis', 30.0D0, 120.0D0, 30.0D0))
     AS c(chain, ingest_min, processing_min, dissemination_min)""",
    "fx_profiles": """
SELECT * FROM (VALUES ('ground', 1, 4.0D0, 24576.0D0, 65.0D0), ('sat-high', 2, 2.0D0, 4096.0D0, 10.0D0), ('sat-mid', 3, 1.0D0, 2048.0D0, 5.0D0),
                      ('sat-low', 4, 0.5D0, 1024.0D0, 2.5D0), ('sat-extreme', 5, 0.25D0, 512.0D0, 1.5D0))
     AS f(profile, profile_rank, cpu_limit, memory_mb, tdp_watts)""",
    "fx_models": """
SELECT p_partkey AS model_id, concat('m-', CAST(p_partkey % 400 AS STRING)) AS name, concat('v', CAST(p_size AS STRING)) AS version,
       CAST(p_size AS DOUBLE) + CAST(0.5 AS DOUBLE) AS size_mb, concat(p_type, ' ', p_name) AS file_name
FROM part""",
    "fx_validation": """
SELECT c_custkey AS run_id, CASE c_custkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'cfar-default' END AS model_name,
       CASE c_custkey % 2 WHEN 0 THEN 'none' ELSE 'dynamic_int8' END AS compression_technique, c_mktsegment AS dataset,
       CAST(c_custkey % 97 AS DOUBLE) / CAST(97 AS DOUBLE) AS pd, CAST(c_custkey % 89 AS DOUBLE) / CAST(89 AS DOUBLE) AS map
FROM customer""",
}
for _name in VIEWS:  # a literal that both engines read as DOUBLE
    VIEWS[_name] = re.sub(r"\b(\d+(?:\.\d+)?)D0", r"CAST(\1 AS DOUBLE)", VIEWS[_name])


def needed(sql: str) -> list[str]:
    """The views that a statement reads, those they read first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+\b", text)):
            if name not in out and name in VIEWS:
                visit(VIEWS[name])
                out.append(name)

    visit(sql)
    return out


def register(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views for all tables and fixture views that the statement reads."""
    names = needed(sql)
    text = " ".join([sql, *[VIEWS[n] for n in names]])
    for name in BASE:
        if re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name in names:
        spark.sql(VIEWS[name]).createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir, f"SELECT * FROM {name}")
    return spark.table(name)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    register(spark, sf_dir, sql)
    return spark.sql(sql)


def oracle(sql: str) -> str:
    """The statement with the fixture views that it reads put in front, as one statement for the oracle engine."""
    head, recursive = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I), ""
    own = ""
    if head:
        recursive, own = ("RECURSIVE " if head[1] else ""), sql[head.end() :]
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed(sql))
    if not views:
        return sql
    return f"WITH {recursive}{views}, {own}" if head else f"WITH {views} {sql}"
