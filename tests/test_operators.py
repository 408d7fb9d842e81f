"""Operators against small loops, and their edge cases."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skerry.functions import exprs as X
from skerry.operators import boxes, fixpoint, provenance, raster, runs, tasking
from skerry.sources import files
from skerry.streaming import streams


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    either = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / either if either > 0 else 0.0


def cases(seed, scenes=30, n=12):
    rnd, out = random.Random(seed), []
    for s in range(scenes):
        for k in range(rnd.randint(0, n)):
            x, y = rnd.randint(0, 20), rnd.randint(0, 20)
            out.append((s * 100 + k, s, rnd.choice([0.2, 0.5, 0.5, 0.9]), float(x), float(y), float(x + rnd.randint(1, 12)), float(y + rnd.randint(1, 12))))
    return out


SCHEMA = "det_id long, scene_id long, confidence double, x_min double, y_min double, x_max double, y_max double"


def test_nms_equals_the_loop(spark):
    rows = cases(1)
    want = set()
    for s in {r[1] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (-r[2], r[0])):
            if all(overlap(r[3:], k[3:]) < 0.3 for k in kept):
                kept.append(r)
        want |= {r[0] for r in kept}
    got = {r.det_id for r in boxes.nms(spark.createDataFrame(rows, SCHEMA), 0.3, cell=5.0).collect()}
    assert got == want


def test_nms_threshold_is_inclusive_and_touching_boxes_stay(spark):
    rows = [(1, 0, 0.9, 0.0, 0.0, 2.0, 1.0), (2, 0, 0.8, 1.0, 0.0, 3.0, 1.0), (3, 0, 0.7, 3.0, 0.0, 4.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.det_id for r in boxes.nms(df, 1 / 3).collect()} == {1, 3}
    assert boxes.nms(df.where("false")).count() == 0


def test_suppression_of_boxes_in_one_place_equals_the_loop(spark):
    rnd = random.Random(8)
    places = [(0.0, 0.0, 4.0, 4.0), (1.0, 0.0, 5.0, 4.0), (2.0, 2.0, 2.0, 6.0), (3.0, 0.0, 7.0, 4.0)]  # the third has no area
    rows = [(i, i % 2, rnd.choice([0.4, 0.5, 0.6]), *rnd.choice(places)) for i in range(120)]
    want = set()
    for s in (0, 1):
        kept = []
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (-r[2], r[0])):
            if all(overlap(r[3:], k[3:]) < 0.5 for k in kept):
                kept.append(r)
        want |= {r[0] for r in kept}
    more = [(900, None, 0.5, 0.0, 0.0, 4.0, 4.0), (901, None, 0.4, 0.0, 0.0, 4.0, 4.0), (902, 0, 0.4, None, 0.0, 4.0, 4.0), (903, 0, 0.4, None, 0.0, 4.0, 4.0)]
    got = {r.det_id for r in boxes.nms(spark.createDataFrame(rows + more, SCHEMA), 0.5, cell=3.0).collect()}
    assert got == want | {900, 901, 902, 903}  # rows without a scene or a place pass


def test_crowded_places_make_no_pairs(spark):
    many = spark.range(20_000).select(F.col("id").alias("det_id"), F.lit(1).alias("scene_id"), F.rand(1).alias("confidence"), *[F.lit(float(v)).alias(c) for c, v in zip(boxes.BOX, (0, 0, 9, 9), strict=True)], F.lit(1.0).alias("longitude"), F.lit(2.0).alias("latitude"))
    best = many.orderBy(F.desc("confidence")).first()["det_id"]
    assert [r.det_id for r in boxes.nms(many).collect()] == [best]
    assert [r.det_id for r in boxes.geo_dedup(many).collect()] == [best]


def test_matching_equals_the_loop(spark):
    preds, truths = cases(2), [(r[0], r[1], *r[3:]) for r in cases(3)]
    want = set()
    for s in {r[1] for r in preds}:
        free = [t for t in truths if t[1] == s]
        for p in sorted((r for r in preds if r[1] == s), key=lambda r: (-r[2], r[0])):
            best = max((t for t in free if overlap(p[3:], t[2:]) >= 0.3), key=lambda t: (overlap(p[3:], t[2:]), -t[0]), default=None)
            if best:
                free.remove(best)
                want.add((p[0], best[0]))
    g = spark.createDataFrame(truths, "gt_id long, scene_id long, x_min double, y_min double, x_max double, y_max double")
    got = {(r.det_id, r.gt_id) for r in boxes.matches(spark.createDataFrame(preds, SCHEMA), g, threshold=0.3, cell=7.0).collect()}
    assert got == want


def test_evaluation_counts_scenes_without_truth_or_predictions(spark):
    p = spark.createDataFrame([(1, 0, 0.9, 0.0, 0.0, 2.0, 2.0)], SCHEMA)
    g = spark.createDataFrame([(7, 1, 0.0, 0.0, 2.0, 2.0)], "gt_id long, scene_id long, x_min double, y_min double, x_max double, y_max double")
    areas = spark.createDataFrame([(0, 10.0), (1, 10.0), (2, 0.0)], "scene_id long, km2 double")
    got = {r.scene_id: (r.tp, r.fp, r.fn, r.far_km2) for r in boxes.evaluate(p, g, areas).collect()}
    assert got == {0: (0, 1, 0, 0.1), 1: (0, 0, 1, 0.0), 2: (0, 0, 0, 0.0)}


def test_reproducibility_of_equal_runs(spark):
    df = spark.createDataFrame([(r[0], r[1], r[2], *r[3:]) for r in cases(4, 5)], SCHEMA)
    apart = boxes.nms(df, 0.01)
    assert {r.verdict for r in boxes.reproducibility(apart, apart).collect()} == {"REPRODUCIBLE"}


def test_dbscan_equals_the_loop_in_each_scene(spark):
    """Scenes hold the same point ids; none of them may melt with another."""
    rnd, points, want = random.Random(5), [], {}
    for scene in range(3):
        own = list({(p[2], p[3]): p for p in [(scene, k, float(rnd.randint(0, 12)), float(rnd.randint(0, 12))) for k in range(50)]}.values())
        near = {p[1]: [q[1] for q in own if (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 2.25] for p in own}
        core = {i for i, n in near.items() if len(n) >= 3}
        label = {i: i for i in core}
        for _ in own:
            for i in core:
                label[i] = min([label[j] for j in near[i] if j in core] + [label[i]])
        want |= {(scene, i): label.get(i, min((label[j] for j in near[i] if j in core), default=None)) for i in near}
        points += own
    got = {(r.scene_id, r.point_id): r.cluster for r in raster.dbscan(spark.createDataFrame(points, "scene_id long, point_id long, x double, y double"), 1.5, 3).collect()}
    assert got == want
    hits = spark.createDataFrame([(s, 1, c, 5.0, 9.0) for s in (0, 1) for c in (2, 3)], "scene_id long, px_row int, px_col int, value double, snr double")
    assert raster.hit_clusters(hits, least=3).count() == 0 and raster.hit_clusters(hits, least=2).count() == 2


def test_cooldown_by_pointers_equals_the_fold(spark):
    rnd = random.Random(8)
    rows = [(k, f"z{k % 3}" if k % 7 else "rare", 1_700_000_000 + rnd.randint(0, 3_000 if k % 2 else 3_000_000)) for k in range(800)]
    df = spark.createDataFrame(rows, "id long, z string, s long").selectExpr("id", "z", "timestamp_seconds(s) as created_at")
    for minutes in (1, 10, 600):
        folded = sorted(map(tuple, tasking.cooldown(df, "z", minutes).collect()))
        assert folded == sorted(map(tuple, tasking.cooldown(df, "z", minutes, fold_rows=5).collect()))
        last, want = {}, []
        for at, i, z in sorted((s, i, z) for i, z, s in rows):
            if z not in last or at - last[z] >= 60 * minutes:
                last[z] = at
                want.append((i, z))
        assert folded == sorted(want)


def test_cooldown_without_a_key_is_a_key(spark):
    rows = [(k, None if k % 2 else "z", 60 * k) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, z string, s long").selectExpr("id", "z", "timestamp_seconds(s) as created_at")
    want = sorted([(i, "z") for i in range(0, 40, 10)] + [(i, "") for i in range(1, 40, 10)])
    for held in (5_000_000, 3):
        assert sorted((r.id, r.z or "") for r in tasking.cooldown(df, "z", 10, fold_rows=held).collect()) == want
    assert tasking.cooldown(df.where("false"), "z", 10).count() == 0


def test_scene_summary_and_areas(spark):
    rows = [(1, 10.0, 50.0, True), (1, 12.0, 52.0, False), (1, 14.0, 51.0, None), (2, None, None, True), (3, 30.0, 10.0, True), (3, 31.0, 10.0, True)]
    df = spark.createDataFrame(rows, "scene_id long, longitude double, latitude double, is_vessel boolean")
    areas = [("first", (12.0, 51.0, 13.0, 60.0)), ("second", (0.0, 0.0, 40.0, 60.0))]
    for held in (1_000_000, 1):
        out = runs.scene_summary(df, areas, (12.0, 40.0, 20.0, 51.0), held)
        got = {r.scene_id: (r.n, r.n_vessels, r.lon, r.lat, r.lon_min, r.lat_max, r.area, r.in_frame) for r in out.collect()}
        assert got == {1: (3, 2, 12.0, 51.0, 10.0, 52.0, "first", True), 2: (1, 1, None, None, None, None, "other", False), 3: (2, 2, 30.5, 10.0, 30.0, 10.0, "second", False)}
    assert sorted(map(tuple, runs.area_histogram(out).collect())) == [("first", 1, 3, 1, 3), ("other", 1, 1, 0, 0), ("second", 1, 2, 0, 0)]


def test_chips_of_any_size_have_exact_percentiles(spark):
    pixels = spark.range(900).selectExpr("id % 2 as scene_id", "cast(floor(id / 60) as int) as px_row", "cast(floor(id / 2) % 30 as int) as px_col", "cast(id * 37 % 101 as double) as value")
    chips = spark.createDataFrame([(0, 1, 0, 0, 15, 30), (1, 1, 2, 3, 9, 20)], "scene_id long, chip_id long, r0 int, c0 int, r1 int, c1 int")
    by_sums, by_group = (sorted(map(tuple, raster.chip_pixels(pixels, chips, 8, most).collect())) for most in (10, 1_000_000))
    assert len(by_sums) == 450 + 7 * 17 and [r[:4] for r in by_sums] == [r[:4] for r in by_group]
    assert max(abs(a[4] - b[4]) for a, b in zip(by_sums, by_group, strict=True)) < 1e-9


def test_settings_are_broadcast_behind_a_count(spark):
    few = spark.range(5).select(F.col("id").alias("k"))
    plans = [spark.range(10).crossJoin(runs.dimension(few, n))._jdf.queryExecution().optimizedPlan().toString() for n in (5, 4)]
    assert ["strategy=broadcast" in p for p in plans] == [True, False]


def test_postprocess_equals_the_loop(spark):
    """Fusion aside, which has an oracle: place, swath edge, doubles, stripes, clusters, land, footprint."""
    rnd = random.Random(3)
    dets = [(k, k % 2, k % 4, "yolo", rnd.randint(1, 99) / 100, 5.0, float(x := rnd.randint(0, 600)), float(y := rnd.randint(0, 600)), x + 10.0, y + 10.0) for k in range(60)]
    df = spark.createDataFrame(dets, "det_id long, scene_id long, tile_index int, source string, confidence double, snr double, x_min double, y_min double, x_max double, y_max double")
    scenes = spark.createDataFrame([(s, 640, 2560, 1.0, 0.001, 0.0001 * s, 40.0, 0.0, -0.001) for s in (0, 1)], "scene_id long, n_rows long, n_cols long, c0 double, c1 double, c2 double, f0 double, f1 double, f2 double")
    mask = spark.createDataFrame([(30, 795)], "cell_x int, cell_y int")
    ring = [(1.2, 39.3), (3.4, 39.3), (3.4, 39.95), (1.2, 39.95)]
    got = {r.det_id: (round(r.longitude, 9), round(r.latitude, 9), r.verdict) for r in boxes.postprocess(df, scenes, mask, ring, buffer_px=30).collect()}
    kept = []
    for d in sorted(dets, key=lambda d: (-d[4], d[0])):
        cx, cy = d[6] + 5 + 640 * (d[2] % 4), d[7] + 5
        place = (1.0 + 0.001 * cx + 0.0001 * d[1] * cy, 40.0 - 0.001 * cy)
        edge = d[6] + 5 < 30 or d[7] + 5 < 30 or d[6] + 5 > 2530 or d[7] + 5 > 610
        if not edge and not any(s == d[1] and abs(p[0] - place[0]) <= 5e-4 and abs(p[1] - place[1]) <= 5e-4 for _, s, p in kept):
            kept.append((d[0], d[1], place))
    stripes = Counter((s, round(p[0] + 1e-12, 3)) for _, s, p in kept)
    kept = [k for k in kept if stripes[(k[1], round(k[2][0] + 1e-12, 3))] < 8]
    want = {}
    for i, s, p in kept:
        crowd = sum(s == t and math.dist(p, q) <= 0.01 for _, t, q in kept) >= 8
        outside = not (1.2 <= p[0] <= 3.4 and 39.3 <= p[1] <= 39.95)
        land = (math.floor(p[0] / 0.05), math.floor(p[1] / 0.05)) == (30, 795)
        want[i] = (round(p[0], 9), round(p[1], 9), "outside_footprint" if outside else "land_artifact" if land else "cluster_artifact" if crowd else "valid_sea_target")
    assert got == want and len({v[2] for v in want.values()}) > 1


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 4), (5, 5)], "a long, b long")
    assert {r.id: r.comp for r in fixpoint.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 7: 4, 8: 4, 9: 4, 5: 5}


def test_convex_footprint(spark):
    pixels = [(0, r, c, 1.0) for r in range(12) for c in range(12)] + [(1, 0, 0, 1.0)]
    df = spark.createDataFrame(pixels, "scene_id long, px_row int, px_col int, value double")
    ring = {(r.col, r.row) for r in raster.convex_footprint(df).collect()}
    assert ring == {(0, 0), (11, 0), (11, 11), (0, 11)}


def test_tiles_reject_an_overlap_as_wide_as_the_tile(spark):
    with pytest.raises(ValueError):
        raster.assign_tiles(spark.range(1).selectExpr("1 px_row", "1 px_col"), 8, 8)


def test_drift_without_variance(spark):
    rows = [(k, "m", 5.0, 0.5, k) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, model_name string, num_detections double, avg_confidence double, created_at long")
    got = runs.drift_zscore(df, 10).first()
    assert not got.is_drifting and got.z_score == 0.0
    assert runs.drift_zscore(df.limit(12), 10).count() == 0


def test_percentiles_by_running_sums_equal_the_aggregate(spark):
    rnd = random.Random(5)
    rows = [(g, rnd.choice([None, round(rnd.gauss(0, 9), 1), 3.0])) for g in ("a", "b", None) for _ in range(400)] + [("one", 2.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for by in (["g"], []):
        plain, dealt = ({tuple(r) for r in runs.quantiles(df, "v", by, held, **shares).collect()} for held in (10_000, 0))
        key = lambda rows: sorted([tuple(None if x is None else x if isinstance(x, str) else round(x, 9) for x in r) for r in rows], key=repr)
        assert key(plain) == key(dealt)
        assert len(plain) == (4 if by else 1)


def test_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "confidence double, source string, longitude double, latitude double")
    got = runs.detection_stats(empty).first()
    assert (got.n, got.avg_confidence, got.lon_min) == (0, 0.0, None)


def test_finite_or_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(X.finite_or_null("x")).collect()] == [None, None, 1.0, None]


def test_zone_edge_is_inside(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.1)], "longitude double, latitude double")
    assert [r[0] for r in df.select(X.point_in_bbox("longitude", "latitude", (0, 0, 1, 1))).collect()] == [True, False]


def test_cooldown_counts_from_the_last_kept(spark):
    df = spark.createDataFrame([(k, "z", f"2024-01-01 00:{m:02d}:00") for k, m in enumerate((0, 5, 9, 11, 20, 25))], "id long, z string, t string").withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    assert sorted(r.id for r in tasking.cooldown(df, "z", 10).collect()) == [0, 3, 5]


def test_result_hash_ignores_order(spark):
    df = spark.range(100).selectExpr("id % 3 as g", "id", "cast(id as string) as s")
    a = {r.g: r.output_hash for r in provenance.result_hash(df, "g", "id", "s").collect()}
    b = {r.g: r.output_hash for r in provenance.result_hash(df.orderBy(F.desc("id")), "g", "id", "s").collect()}
    assert a == b and len(set(a.values())) == 3


def test_deep_hashes_ignore_order_and_match_shallow_ones(spark):
    df = spark.range(3000).selectExpr("if(id < 2900, 0, id % 3) as g", "id")
    shallow = {r.g: r.output_hash for r in provenance.result_hash(df, "g", "id").collect()}
    deep = {r.g: r.output_hash for r in provenance.result_hash(df, "g", "id", most=5).collect()}
    again = {r.g: r.output_hash for r in provenance.result_hash(df.orderBy(F.desc("id")).repartition(3), "g", "id", most=5).collect()}
    assert deep == again and len(set(deep.values())) == 3
    assert {g for g in deep if deep[g] == shallow[g]} == {1, 2}  # the others have no more rows than one bucket may
    other = provenance.result_hash(df.withColumn("id", F.when(F.col("id") == 77, -1).otherwise(F.col("id"))), "g", "id", most=5)
    assert {r.g for r in other.collect() if r.output_hash != deep[r.g]} == {0}


def test_csv_round_trip_and_inventory(spark, tmp_path):
    df = spark.sql("select 1L id, timestamp_ntz'2024-01-02 03:04:05' created_at, 'i' image_id, 'm' model_name, 'v' model_version, 'success' status, 1.5D inference_ms, 3 num_detections, '{\"type\":\"Point\",\"coordinates\":[1,2]}' footprint union all select 2L, null, null, 'm', 'v', 'error', null, null, null")
    files.write_csv(df, f"{tmp_path}/out")
    schema = "id long, created_at timestamp_ntz, image_id string, model_name string, model_version string, status string, inference_ms double, num_detections int, footprint string"
    back = files.read_executions_csv(spark, f"{tmp_path}/out", schema).orderBy("id").collect()
    assert json.loads(back[0].footprint)["coordinates"] == [1, 2]
    assert back[1].image_id is None and back[1].inference_ms is None
    listed = files.file_inventory(spark, f"{tmp_path}/out").collect()
    assert any(r.path.startswith("part-") and r.length > 0 and len(r.sha256) == 64 for r in listed)
    assert files.expired_files(spark, f"{tmp_path}/out", "2999-01-01").count() == len(listed)
    assert files.expired_files(spark, f"{tmp_path}/out", "2000-01-01").count() == 0


def test_labels_and_manifest(spark, tmp_path):
    (tmp_path / "l.csv").write_text("scene_id,lat,lon,row,col,is_vessel,confidence\na,1,2,3,4,True,HIGH\na,1,2,3,4,False,HIGH\nb,1,2,3,4,True,LOW\n")
    assert [r.scene_id for r in files.read_labels_csv(spark, str(tmp_path / "l.csv")).collect()] == ["a"]
    box = {"bbox": [1, 2, 3, 4], "is_vessel": True, "confidence": "HIGH"}
    scenes = [{"image_path": "p", "scene_area_km2": 5.0, "ground_truth": [box, box]}, {"image_path": "e", "scene_area_km2": 2.0, "ground_truth": []}, {"scene_area_km2": 1.0, "ground_truth": []}, {"image_path": "q", "scene_area_km2": 1.0}]
    (tmp_path / "m.json").write_text(json.dumps(scenes))
    good, bad = files.read_manifest(spark, str(tmp_path / "m.json"))
    assert sorted((r.image_path, r.x_max or 0) for r in good.collect()) == [("e", 0), ("p", 3.0), ("p", 3.0)]
    assert bad.count() == 2
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "none.json"))
    labels = spark.createDataFrame([(k % 5, 1.0 * k, 2.0, 3.0, 4.0, True, "HIGH") for k in range(12)], "scene_id long, x_min double, y_min double, x_max double, y_max double, is_vessel boolean, confidence string")
    archive = spark.createDataFrame([(k, f"/s/{k}", 1.5) for k in range(7)], "scene_id long, image_path string, scene_area_km2 double")
    files.write_manifest(labels, archive, f"{tmp_path}/out", 2)
    good, bad = files.read_manifest(spark, f"{tmp_path}/out")
    assert sorted((r.image_path, r.x_min) for r in good.collect()) == sorted((f"/s/{k % 5}", float(k)) for k in range(12)) and bad.count() == 0


def test_snapshot_keeps_the_old_version(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = files.write_snapshot(old, spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), ["id"], f"{tmp_path}/v2")
    assert sorted((r.id, r.v) for r in new.collect()) == [(1, "a"), (2, "c"), (3, "d")] and old.count() == 2


def event_files(folder, batches):
    """One file for each batch of (event_id, hour, user_id, event_type), read in this order."""
    import os
    from datetime import datetime, timedelta

    import pyarrow as pa
    import pyarrow.parquet as pq

    for k, rows in enumerate(batches):
        table = pa.table({
            "event_id": pa.array([r[0] for r in rows], pa.int64()), "ts": pa.array([datetime(2024, 1, 1) + timedelta(hours=r[1]) for r in rows], pa.timestamp("us")),
            "user_id": pa.array([r[2] for r in rows], pa.int64()), "event_type": [r[3] for r in rows], "value": [1.0] * len(rows),
        })
        pq.write_table(table, f"{folder}/{k}.parquet")
        os.utime(f"{folder}/{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    return str(folder)


def test_orphans_are_reaped_and_recover(spark, tmp_path):
    path = event_files(tmp_path, [
        [(1, 0.0, 1, "view"), (2, 0.0, 2, "view"), (3, 0.5, 2, "purchase"), (4, 0.2, 3, "click"), (5, 0.1, 4, "view")],
        [(6, 5.0, 9, "purchase")],
        [(7, 5.1, 8, "purchase")],
        [(8, 5.2, 1, "purchase"), (9, 5.2, 7, "view")],
    ])
    got = streams.finished(streams.orphans(streams.read_events(spark, path, 1), 60))
    # 1 and 4 start and do not end in time, 1 ends after all, 7 is still within its time, 2 ended in time
    assert sorted(map(tuple, got.collect())) == [(1, "reaped"), (1, "recovered"), (4, "reaped")]


def test_cooled_forgets_keys_without_changing_the_result(spark, tmp_path):
    batches = [[(1, 0.0, 1, "view"), (2, 0.5, 1, "view"), (3, 0.1, 2, "view")], [(4, 1.0, 1, "view")], [(5, 9.0, 3, "view")], [(6, 9.1, 3, "view"), (7, 9.5, 1, "view")], [(8, 9.8, 1, "view"), (9, 10.6, 2, "view")]]
    got = streams.finished(streams.cooled(streams.read_events(spark, event_files(tmp_path, batches), 1), "user_id", 60, "1 hour"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 4), (1, 7), (2, 3), (2, 9), (3, 5)]


def test_late_rows_are_counted(spark, tmp_path):
    # rows are late by the watermark of the batch before
    batches = [[(1, 0.0, 1, "view")], [(2, 20.0, 2, "view")], [(7, 20.1, 9, "purchase")], [(3, 1.0, 3, "view"), (4, 1.5, 3, "view"), (5, 19.95, 4, "view")], [(6, 40.0, 5, "purchase")]]
    report = {}
    got = streams.finished(streams.orphans(streams.read_events(spark, event_files(tmp_path, batches), 1), 60), report=report)
    assert report["late_rows"] == 2 and report["batches"] >= 5
    assert sorted(map(tuple, got.collect())) == [(1, "reaped"), (2, "reaped"), (4, "reaped")]


def test_entry_registers_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_extent_by_boxes_and_features_by_geometry(spark):
    rows = [("cfar", 0.5, 1.0, 2.0, [0.0, 1.5, 3.0, 2.5]), ("yolo", 0.7, 9.0, -2.0, None), ("fused", 0.9, 4.0, 5.0, [1.0]), ("fused", None, None, None, None)]
    dets = spark.createDataFrame(rows, "source string, confidence double, longitude double, latitude double, bbox_geo array<double>")
    got = runs.detection_stats(dets).first()
    assert (got.lon_min, got.lat_min, got.lon_max, got.lat_max) == (0.0, -2.0, 9.0, 5.0)
    got = runs.detection_stats(dets.where("false")).first()
    assert got.n == 0 and got.lon_min is None
    rows = [(1, '{"type":"Point","coordinates":[7,8]}', 1, 2), (2, "", 1, 2), (3, None, None, 2)]
    found = files.features(spark.createDataFrame(rows, "det_id int, geometry string, longitude long, latitude long").selectExpr("*", "0L x_min", "0L y_min", "4L x_max", "5L y_max"))
    got = {r.det_id: json.loads(r.feature) for r in found.collect()}
    assert got[1]["geometry"]["coordinates"] == [7, 8] and got[2]["geometry"]["coordinates"] == [1, 2] and got[3]["geometry"]["type"] == "Polygon"
    assert all("geometry" not in f["properties"] for f in got.values())


def test_gaps_of_samples_dealt_or_held(spark):
    rows = [(r, f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}", float(k % 7), float(k % 5)) for r in ("a", "b", None) for k in range(0, 900, 3 if r else 7)] + [("one", "2024-01-01 00:00:00", 1.0, 2.0)]
    samples = spark.createDataFrame(rows, "run_id string, ts string, ram_mb double, cpu_pct double").withColumn("ts", F.to_timestamp_ntz("ts"))
    held, dealt = ({r.run_id: r for r in runs.resource_summary(samples, n).collect()} for n in (10_000, 0))
    assert held == dealt and len(held) == 4
    assert held["a"].p95_gap_s == 3.0 and held[None].p95_gap_s == 7.0 and held["one"].p95_gap_s is None and held["a"].n == 300
