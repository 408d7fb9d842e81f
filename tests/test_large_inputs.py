"""Queries on inputs that grow: against their SQL where small tables hide a difference, and by what their plans deal out."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from skerry import plans
from skerry.operators import tasking
from skerry.sources import fixtures

QUERIES, ORACLES = plans.load()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def against_oracle(spark, name, folder):
    con = duckdb.connect()
    for t in fixtures.BASE:
        if fixtures.re.search(rf"\b{t}\b", ORACLES[name]):
            con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(*columns).collect())
    assert got and got == sorted(con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("seed", [1, 2])
def test_cues_are_admitted_as_by_a_loop(spark, seed):
    draw, start = random.Random(seed), datetime(2024, 1, 1)
    row = lambda k: (k, draw.choice(["a", "b", None]), draw.choice(["pending", "processing", "failed"]), draw.choice([None, *[start + timedelta(seconds=30 * draw.randrange(400))] * 9]))
    new, queue = [row(k) for k in range(150)], [row(k) for k in range(40)]
    barred = lambda n, q: None not in (n[1], n[3], q[3]) and n[1] == q[1] and q[2] != "failed" and q[3] < n[3] < q[3] + timedelta(minutes=10)
    want = sorted(n[0] for n in new if not any(barred(n, q) for q in queue))
    for kind in ("timestamp_ntz", "timestamp"):
        a, b = (spark.createDataFrame(r, "id long, target_zone string, status string, created_at timestamp_ntz").withColumn("created_at", F.col("created_at").cast(kind)) for r in (new, queue))
        out = tasking.admit_cues(a, b, 10)
        assert out.columns == a.columns and sorted(r.id for r in out.collect()) == want


def test_cues_meet_by_zone_and_time(spark):
    cues = fixtures.view(spark, "/root/testdata/sf0.001", "fx_cues")
    join = next(x for x in physical(tasking.admit_cues(cues, cues)).splitlines() if "Join" in x)
    assert "_slot" in join.split("LeftAnti")[0]  # a zone alone has all cues of the archive


def test_areas_are_moved_by_whole_tenths(spark):
    against_oracle(spark, "b3_aoi_window", "/root/testdata/sf0.1")


@pytest.mark.parametrize("name, last", [("r4_assign_tiles", 3_000_000), ("r4_flush_tiles", 12_000_000)])
def test_tiles_of_tall_scenes(spark, tmp_path, name, last):
    duckdb.connect().execute(f"copy (select event_id, cast(event_id % 7 as double) as value from range(0, {last}, 9973) r(event_id)) to '{tmp_path}/events.parquet' (format parquet)")
    against_oracle(spark, name, tmp_path)


def test_clusters_send_no_table_through_the_driver(spark, monkeypatch):
    from skerry.operators import fixpoint, raster

    plain, seen = fixpoint.cut, []
    for module in (fixpoint, raster):
        monkeypatch.setattr(module, "cut", lambda df: seen.append(physical(df)) or plain(df))
    rows = [(s, (r << 32) + c, float(c), float(r)) for s in range(2) for r in range(0, 40, 2) for c in range(30) if c % 10 < 7]
    points = spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double")
    out = raster.dbscan(points, 1.0, 2)
    assert {(r.scene_id, r.point_id): r.cluster for r in out.collect()} == {(s, p): p - p % 10 if p < 1 << 32 else (p >> 32 << 32) + (p % (1 << 32)) // 10 * 10 for s, p, _, _ in rows}
    joins = [x for plan in [*seen, physical(out)] for x in plan.splitlines() if "Join" in x and "_cx" not in x]
    assert len(joins) > 6 and not [x for x in joins if "Broadcast" in x]


def test_a_ring_is_read_once(spark):
    dets = fixtures.view(spark, "/root/testdata/sf0.001", "fx_detections")
    from skerry.plans.archive import c3_geojson_ring

    assert physical(c3_geojson_ring(dets)).count("from_json") == 1


def test_unanswered_cues_are_not_in_one_task(spark, monkeypatch):
    cues = spark.range(2000).selectExpr("id", "timestamp_ntz'2024-01-01' as created_at", "if(id % 10 = 0, id, cast(null as bigint)) as triggered_by", "if(id % 10 = 0, id, cast(null as bigint)) as execution_id", "array(id) as triggering")
    runs = spark.range(2000).selectExpr("id", "timestamp_ntz'2024-01-01' as created_at")
    dets = spark.range(2000).selectExpr("id as det_id", "id as execution_id", "0.5D as confidence")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = tasking.replay_record(cues, runs, dets).withColumn("task", F.spark_partition_id())
        rows = out.groupBy("task").agg(F.count("*").alias("n"), F.count("t1_at").alias("known")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in rows) == 2000 and sum(r.known for r in rows) == 200 and max(r.n for r in rows) < 1000


def odd_boxes(seed):
    """Scenes with copies, ties, missing values, NaN and no key."""
    draw = random.Random(seed)
    rows = []
    for k in range(260):
        x, y = float(draw.randrange(60)), float(draw.randrange(40))
        scene = draw.choice([0, 1, 2, 3, None])
        edge = draw.choice([None, float("nan")]) if scene == 3 and draw.random() < 0.2 else x
        rows.append((k, scene, draw.randrange(2), draw.choice(["cfar", "yolo", "fused"]), draw.choice([None, 0.5, draw.random()]), 3.0 * draw.random(), edge, y, x + draw.choice([0.0, 6.0, 9.0]), y + 8.0, draw.choice([edge, x]) / 10 if edge else None, y / 10))
    return rows


ODD = "det_id long, scene_id long, tile_index int, source string, confidence double, snr double, x_min double, y_min double, x_max double, y_max double, longitude double, latitude double"
STEPS = {
    "nms": lambda B, d: B.nms(d), "merge": lambda B, d: B.merge_tiles(d), "dedup": lambda B, d: B.geo_dedup(d, 0.3), "cluster": lambda B, d: B.cluster_anomaly(d, 0.5, 4).drop("neighbours"), "fuse": lambda B, d: B.fuse(d),
    "iou": lambda B, d: B.matches(d, d.withColumnRenamed("det_id", "gt_id"), threshold=0.4), "centre": lambda B, d: B.matches(d.where("det_id % 2 = 0"), d.where("det_id % 2 = 1").withColumnRenamed("det_id", "gt_id"), threshold=4.0, mode="center"),
}


@pytest.mark.parametrize("step", STEPS)
def test_scenes_as_a_whole_equal_joins(spark, monkeypatch, step):
    from skerry.operators import boxes, scenes

    df = spark.createDataFrame(odd_boxes(7), ODD)
    plain, seen = scenes.solved, []
    for limit in (50_000, 60, -1):  # all whole, some left to joins, all left to joins
        monkeypatch.setattr(scenes, "solved", lambda *a, limit=limit: plain(*a, limit=limit))
        out = STEPS[step](boxes, df)
        seen.append(sorted((tuple(r[c] for c in sorted(out.columns)) for r in out.collect()), key=repr))
    assert repr(seen[0]) == repr(seen[1]) == repr(seen[2]) and seen[0]


def test_pairs_come_in_bounded_parts(monkeypatch):
    import numpy as np

    from skerry.operators import scenes

    monkeypatch.setattr(scenes, "PAIRS", 50)
    draw = random.Random(5)
    group, low = np.array([draw.randrange(3) for _ in range(60)]), np.array([float(draw.randrange(20)) for _ in range(60)])
    parts = list(scenes.reaching(group, low, low + 3))
    got = sorted((min(i, j), max(i, j)) for a, b in parts for i, j in zip(a.tolist(), b.tolist(), strict=True))
    assert got == [(i, j) for i in range(60) for j in range(i + 1, 60) if group[i] == group[j] and abs(low[i] - low[j]) <= 3]
    assert max(len(a) for a, _ in parts) <= 60


@pytest.mark.parametrize("name", ["b4_nms", "b5_merge_tiles", "b6_geo_dedup", "b9_cluster_anomaly", "b10_reproducibility_diff"])
def test_rows_of_a_scene_are_dealt_once(spark, name):
    plan = physical(QUERIES[name](spark, "/root/testdata/sf0.001")).split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_NUM") == 1 and "Generate" not in plan and "_cx" not in plan
