"""Bundles that are tampered with, crops of turned scenes, rings as text, stage ledgers, replay records and raster windows."""

import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import exprs as X
from skerry.operators import boxes, bundle, raster, relations, runs, tasking
from skerry.sources import fixtures

SF = "/root/testdata/sf0.01"


@pytest.fixture
def written(spark, tmp_path):
    made = spark.createDataFrame([(1, "2024-01-01", "alpha", "h" * 64), (2, "2024-02-01", "beta", "0" * 64), (3, "2024-03-01", "alpha", None)], "id long, created_at string, model_name string, model_hash string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    dets = spark.createDataFrame([(k, 1 + k % 3, 1.0 * k, 2.0, 0.0, 0.0, 1.0, 1.0) for k in range(30)], "det_id long, execution_id long, longitude double, latitude double, x_min double, y_min double, x_max double, y_max double")
    settings = spark.createDataFrame([("DB_PASSWORD", "x"), ("DB_URL", "pg://u:secret@h")], "key string, value string")
    cards = spark.createDataFrame([("alpha", "by name"), ("other", "quotes " + "0" * 64), ("unused", "no")], "card_name string, card_text string")
    folder = f"{tmp_path}/bundle"
    root = bundle.write_bundle(spark, made, dets, settings, cards, folder, "2024-06-01T00:00:00Z", since="2024-01-15").first()
    return folder, root


def put(path, text):
    """New content, without the checksum that the local file system keeps beside a file."""
    path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    path.write_text(text)


def test_bundle_holds_what_the_filters_pass(spark, written):
    folder, root = written
    assert (root.counts["executions"], root.counts["detections"], root.counts["models"]) == (2, 20, 2) and root.filters == {"since": "2024-01-15"}
    assert sorted(r.card_name for r in spark.read.json(f"{folder}/models").collect()) == ["alpha", "other"]
    assert {r.value for r in spark.read.json(f"{folder}/settings").collect()} == {"***", "pg://u:***@h"}
    feature = json.loads(spark.read.text(f"{folder}/features").first()[0])
    assert feature["geometry"]["type"] == "Point" and feature["properties"]["execution_id"] in (2, 3)
    got = bundle.verify_bundle(spark, folder)[1].first()
    assert (got.n_ok, got.n_mismatch, got.n_missing, got.n_extra, got.root_ok, got.verdict) == (root.counts["files"], 0, 0, 0, True, "PASS")


def test_verifier_names_each_fault(spark, written, tmp_path):
    folder, _ = written
    names = sorted(r.path for r in bundle.listing(spark, folder).collect())
    changed, gone = next(n for n in names if n.startswith("detections/")), next(n for n in names if n.startswith("settings/"))
    put(tmp_path / "bundle" / changed, "det_id\n1\n")
    (tmp_path / "bundle" / gone).unlink()
    put(tmp_path / "bundle" / "extra.txt", "x")
    verdicts, summary = bundle.verify_bundle(spark, folder)
    assert {r.path: r.verdict for r in verdicts.where("verdict <> 'OK'").collect()} == {changed: "MISMATCH", gone: "MISSING", "extra.txt": "EXTRA"}
    assert summary.first().verdict == "FAIL" and summary.first().root_ok


def test_a_manifest_made_to_fit_has_another_root(spark, written, tmp_path):
    folder, _ = written
    changed = next(r.path for r in bundle.listing(spark, folder).collect() if r.path.startswith("executions/"))
    put(tmp_path / "bundle" / changed, "id\n9\n")
    bundle.listing(spark, folder).write.json(f"{tmp_path}/new")
    shutil.rmtree(tmp_path / "bundle" / "manifest")
    shutil.move(tmp_path / "new", tmp_path / "bundle" / "manifest")
    got = bundle.verify_bundle(spark, folder)[1].first()
    assert (got.n_mismatch, got.root_ok, got.verdict) == (0, False, "FAIL")


def test_crops_of_turned_flat_and_disjoint_scenes(spark):
    scenes = spark.createDataFrame([(1, 100, 200, 10.0, 0.1, 0.0, 50.0, 0.0, -0.1), (2, 100, 100, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0), (3, 10, 10, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "scene_id long, n_rows long, n_cols long, c0 double, c1 double, c2 double, f0 double, f1 double, f2 double")
    areas = spark.createDataFrame([(1, 9.0, 44.95, 12.05, 49.05, "a"), (1, 90.0, 45.0, 91.0, 49.0, "b"), (2, 20.5, 10.5, 30.5, 12.5, "c"), (3, 1.0, 1.0, 2.0, 2.0, "d")], "scene_id long, lon_min double, lat_min double, lon_max double, lat_max double, name string")
    got = {r.name: (r.crops, r.col_start, r.col_end, r.row_start, r.row_end) for r in boxes.aoi_window(scenes, areas).collect()}
    # columns and rows change places in scene 2; scene 3 has no scale, so all corners are at its first pixel
    assert got == {"a": (True, 0, 21, 9, 51), "b": (False, 0, 200, 0, 100), "c": (True, 10, 13, 20, 31), "d": (True, 0, 1, 0, 1)}
    moved = boxes.aoi_window(scenes, areas).where("name = 'c'").first()
    assert (moved.new_c0, moved.new_f0) == (20.0, 10.0)


def test_boxes_beyond_a_tile_are_moved(spark):
    rows = [(1, 5, 650.0, 700.0, 700.0, 1000.0), (2, 5, 10.0, 20.0, 30.0, 960.0), (3, 0, 700.0, 0.0, 2000.0, 5.0)]
    got = boxes.tile_local(spark.createDataFrame(rows, "det_id long, tile_index long, x_min double, y_min double, x_max double, y_max double")).collect()
    assert {r.det_id: (r.x_min, r.y_min, r.x_max, r.y_max) for r in got} == {1: (10.0, 60.0, 60.0, 360.0), 2: (10.0, 20.0, 30.0, 960.0), 3: (700.0, 0.0, 2000.0, 5.0)}


def test_rings_of_odd_texts(spark):
    ring = "[[0,0],[2,0],[2,3],[0,0]]"
    texts = {
        f'{{"type":"Polygon","coordinates":[{ring}]}}': None, f'{{"coordinates":[{ring},[[9,9]]],"type":"Polygon"}}': None, '{"type":"Polygon","coordinates":[[[0,0],[1,1]]]}': "open", "{": "not JSON", "": "not JSON",
        '{"type":"Point","coordinates":[1,2]}': "not a polygon", '{"type":"Polygon"}': "empty", '{"type":"Polygon","coordinates":[[]]}': "empty", '{"type":"Polygon","coordinates":[[[1],[2,3]]]}': "point without two numbers",
    }
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", X.geojson_to_ring("t").alias("r"))
    got = {r.t: r.r for r in df.collect()}
    assert got.pop(None) == (None, None)
    problems = {t: r.problem for t, r in got.items()}
    # text of another shape is either no polygon or no JSON for the schema
    assert problems.pop('{"type":"Point","coordinates":[1,2]}') in ("not JSON", "not a polygon")
    assert problems == {t: p for t, p in texts.items() if "Point" not in t}
    assert [tuple(p) for p in got[next(iter(texts))].ring] == [(0, 0), (2, 0), (2, 3), (0, 0)]
    assert spark.range(1).select(X.ring_to_geojson(F.lit(None).cast("array<struct<lon:double,lat:double>>"))).first()[0] is None


def test_shares_of_a_run_add_up(spark):
    made = spark.createDataFrame([(1, 100.0, 300.0, None, 50.0), (2, 0.0, 0.0, 0.0, 10.0), (3, 10.0, 20.0, 30.0, None), (4, 10.0, 20.0, 30.0, 900.0)], "id long, a_ms double, b_ms double, c_ms double, cpu_usage_pct double")
    parts = spark.createDataFrame([("p", 2.0), ("q", 4.0)], "processor string, tdp_watts double")
    got = runs.stage_energy(made, parts, {"a": "a_ms", "b": "b_ms", "c": "c_ms"}).where("processor = 'p'").collect()
    joules = {(r.id, r.stage): r.joules for r in got}
    assert len(got) == 12 and joules[1, "b"] == pytest.approx(0.3) and joules[1, "c"] == 0 and joules[3, "a"] == joules[4, "a"] == pytest.approx(0.02)
    for i, want in ((1, 100), (2, 0), (3, 100), (4, 100)):
        assert sum(r.share_pct for r in got if r.id == i) == pytest.approx(want)


def test_replay_of_open_and_answered_cues(spark):
    made = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 06:00:00")], "id long, t string").select("id", F.col("t").cast("timestamp_ntz").alias("created_at"))
    dets = spark.createDataFrame([(k, 1 + k // 10, 0.1 * (k % 10)) for k in range(20)], "det_id long, execution_id long, confidence double")
    cues = spark.createDataFrame([(7, 1, [3, 5, 99], 2, "2024-01-01 01:00:00"), (8, 1, None, None, "2024-01-01 02:00:00"), (9, 5, [3], 6, None)], "id long, triggered_by long, triggering array<long>, execution_id long, t string")
    got = {r.id: r for r in tasking.replay_record(cues.withColumn("created_at", F.col("t").cast("timestamp_ntz")).drop("t"), made, dets, 3).collect()}
    assert [d.det_id for d in got[7].triggering_detections] == [5, 3] and [d.det_id for d in got[7].confirming_detections] == [19, 18, 17]
    assert (got[7].t0_to_cue_s, got[7].t0_to_t1_s, got[7].confidence_uplift) == (3600.0, 21600.0, 0.4)
    assert got[8].triggering_detections == got[8].confirming_detections == [] and got[8].confidence_uplift is None and got[8].t0_to_cue_s == 7200.0
    assert [d.det_id for d in got[9].triggering_detections] == [3] and got[9].t0_at is None


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.split("\n"))


def test_window_sums_deal_pixels_twice(spark):
    pixels = fixtures.view(spark, SF, "fx_two_scenes")
    assert exchanges(raster.ca_cfar(pixels)) == 2
    assert exchanges(raster.ca_cfar(pixels, deviations=1.5)) == 2
    assert exchanges(raster.os_cfar(pixels)) == 1


@pytest.mark.parametrize("size", [256, 7])
def test_ordered_statistic_equals_plain_windows(spark, size):
    draw = np.random.default_rng(8)
    rows = [(s, r, c, float(draw.integers(1, 40))) for s in (1, 2) for r in range(20 + s) for c in range(18) if draw.random() > 0.05]
    value = {(s, r, c): x for s, r, c, x in rows}
    want = set()
    for (s, r, c), x in value.items():
        h, w = (max(k[i] for k in value if k[0] == s) for i in (1, 2))
        if 3 <= r <= h - 3 and 3 <= c <= w - 3:
            near = sorted(value[s, r + i, c + j] for i in range(-3, 4) for j in range(-3, 4) if max(abs(i), abs(j)) > 1 and (s, r + i, c + j) in value)
            if x > 1.2 * near[int(0.75 * (len(near) - 1))]:
                want.add((s, r, c, x))
    df = spark.createDataFrame([*rows, (3, 0, 0, None)], "scene_id long, px_row int, px_col int, value double")
    got = raster.os_cfar(df, k=1.2, size=size).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20
    assert raster.tiled(df, size, 3).count() <= df.count() * (4 if size == 7 else 1.1)


def test_edges_by_stated_and_inferred_sizes(spark):
    dets = spark.createDataFrame([(1, 1, 0, 5.0), (2, 1, 0, 50.0), (3, 1, 1, 95.0), (4, 1, 1, 50.0), (5, 2, 0, 50.0), (6, 2, 9, 1.0), (7, 3, 0, 1.0)], "det_id long, scene_id long, tile_index long, m double")
    dets = dets.select("det_id", "scene_id", "tile_index", *[F.col("m").alias(c) for c in ("x_min", "x_max")], *[F.lit(50.0).alias(c) for c in ("y_min", "y_max")])
    tiles = spark.createDataFrame([(1, 0, 0, 0, 100, 100), (1, 1, 0, 100, 100, 100), (2, 0, 0, 0, 100, 100), (3, 0, 0, 0, 0, 0)], "scene_id long, tile_index long, row_off int, col_off int, tile_rows int, tile_cols int")
    stated = spark.createDataFrame([(2, 100, 55), (1, None, 9)], "scene_id long, n_rows int, n_cols int")
    kept = lambda buffer: sorted(r.det_id for r in relations.edge_swath_by_tiles(dets, tiles, stated, buffer).collect())
    # 1 and 3 are near the ends of the tiles of scene 1, 5 near the stated end of 2; 6 has no tile, 7's scene no size
    assert kept(10) == [2, 4, 6, 7] and kept(0) == [1, 2, 3, 4, 5, 6, 7]


def test_decibels_come_back(spark):
    df = spark.createDataFrame([(-1000.0,), (-9999.0,), (-80.0,), (0.0,), (10.0,), (99.0,), (None,)], "db double")
    assert [r[0] for r in df.select(raster.from_db(F.col("db"))).collect()] == pytest.approx([0.0, 0.0, 1e-5, 1.0, 10.0, 1000.0, None])
