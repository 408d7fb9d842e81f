"""Registered queries against the oracle engine, over the whole tables of the smallest scale with unique keys."""

import math

import duckdb
import pytest

from skerry import plans
from skerry.sources import fixtures

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = plans.load()
#: One or two of each kind; the driver compares all of them.
CHOSEN = [
    "f1_search_detections", "f1_search_page", "f3_search_executions", "f6_catalogue_search", "p6_reset_mapping_failures", "f10_prev_next_offsets", "p2_point_in_convex_polygon", "p5_quality_verdict", "p9_column_density_filter", "j5_full_outer", "j7_points_in_zones", "j9_interpolated_lut",
    "a1_benchmarks", "a9_resource_summary", "a13_gcp_affine_fit", "w1_pr_curve", "w2_average_precision", "w3_drift_zscore", "w6_sample_detections", "w11_box_sum", "e5_downlink", "e9_select_model", "e10_budget_verdict",
    "d4_daily_percentiles", "d6_variant_matrix", "b4_nms", "b6_geo_dedup", "b7_greedy_match", "b8_fuse", "b9_cluster_anomaly", "b11_evaluate", "r3_lee_filter", "r6_ca_cfar", "r7_os_cfar", "r13_score_tiles", "b2_pixel_to_geo", "b10_reproducibility_diff", "r4_flush_tiles", "r5_tile_bounds", "r8_dbscan", "r9_cfar_clusters", "s1_executions_round_trip", "s4_manifest_round_trip", "s7_provenance_properties",
    "h1_result_hash", "h7_cards_for_models", "t1_tips", "t2_cooldown", "t6_replay_chain", "s6_geojson_features", "c1_parse_bbox", "c2_parse_interval", "k1_runs_per_status", "k4_cooled_tips", "k7_rolling_drift", "k8_sessions", "a10_latency_summary", "a12_scene_summary", "a12_area_histogram", "a16_bright_footprint", "b13_chip_pixels", "b14_postprocess",
]


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v if v is None or isinstance(v, (int, float, bool, str)) else str(v)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in fixtures.BASE:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_equals_oracle(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(map(plain, r)) for r in df.select(*columns).collect()], key=repr)
    rel = oracle.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert got == sorted([tuple(plain(r[i]) for i in order) for r in rel.fetchall()], key=repr)


def test_every_query_is_lazy_and_named():
    assert len(QUERIES) > 150
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) / len(QUERIES) > 0.9


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    from skerry.operators.relations import search_detections

    dets = fixtures.view(spark, SF, "fx_detections")
    runs = fixtures.view(spark, SF, "fx_executions")
    plan = physical(search_detections(dets, runs, execution_id=5).select("det_id"))
    assert "EqualTo(l_orderkey,5)" in plan
    assert "l_comment" not in plan


def test_neighbours_are_found_by_equi_join(spark):
    from skerry.operators.boxes import cluster_anomaly

    plan = physical(cluster_anomaly(fixtures.view(spark, SF, "fx_detections")))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_running_sum_numbers_every_row_once_whatever_is_read_of_it(spark):
    from pyspark.sql import functions as F

    from skerry.operators.runs import running_sum

    df = spark.range(200_000).select(F.xxhash64("id").alias("det_id"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("confidence"), F.pmod("id", F.lit(3)).alias("source"))
    out = running_sum(df, [F.desc("confidence"), F.col("det_id")], {"n": F.lit(1)}, 64)
    assert "SinglePartition" not in physical(out)
    # more columns are read than the sums need: both must see the same partitions
    got = out.agg(F.max("n"), F.count_distinct("n"), F.max("source")).first()
    assert tuple(got) == (200_000, 200_000, 2)
    inside = running_sum(df, [F.desc("confidence"), F.col("det_id")], {"n": F.lit(1)}, 16, by=["source"])
    per = {r["source"]: (r["n"], r["different"]) for r in inside.groupBy("source").agg(F.max("n").alias("n"), F.count_distinct("n").alias("different")).collect()}
    assert per == {0: (66667, 66667), 1: (66667, 66667), 2: (66666, 66666)}


def test_drift_sorts_no_group_in_one_task(spark):
    from skerry.operators.runs import drift_zscore

    plan = physical(drift_zscore(fixtures.view(spark, SF, "fx_executions")))
    assert "Window" not in plan
