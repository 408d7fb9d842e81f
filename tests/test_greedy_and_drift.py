"""Greedy rules by group, component and round against plain loops; the drift test from state against that over all history."""

import json
import os
import random

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skerry.operators import boxes, fixpoint, runs
from skerry.streaming import streams


def chain(n, scenes=1):
    """Boxes of 10 pixels, each over half of the one before."""
    return [(s * 10_000 + k, s, 1 - k / n, 5.0 * k, 0.0, 5.0 * k + 10, 10.0) for s in range(scenes) for k in range(n)]


BOXES = "det_id long, scene_id long, confidence double, x_min double, y_min double, x_max double, y_max double"


def loop_nms(rows, threshold):
    kept = []
    for r in sorted(rows, key=lambda r: (r[2] is not None, -(r[2] or 0), r[0])):
        clear = True
        for k in kept:
            if k[1] == r[1]:
                w, h = min(r[5], k[5]) - max(r[3], k[3]), min(r[6], k[6]) - max(r[4], k[4])
                both = max(w, 0) * max(h, 0)
                area = lambda b: (b[5] - b[3]) * (b[6] - b[4])
                clear = clear and not both / (area(r) + area(k) - both) >= threshold
        if clear:
            kept.append(r)
    return sorted(r[0] for r in kept)


@pytest.fixture
def tables(monkeypatch):
    written = []
    plain = fixpoint.cut
    for module in (fixpoint, boxes):
        monkeypatch.setattr(module, "cut", lambda df: written.append(1) or plain(df))
    return written


def test_written_tables_do_not_grow_with_the_chain(spark, tables):
    counts = []
    for n in (5, 500):
        rows = chain(n, 2)
        tables.clear()
        got = boxes.nms(spark.createDataFrame(rows, BOXES), 0.3)
        assert sorted(r.det_id for r in got.collect()) == loop_nms(rows, 0.3)
        counts.append(len(tables))
    assert counts[0] == counts[1] <= 4


@pytest.mark.parametrize("limit", [1_000_000, 60, 10])
def test_suppression_equals_the_loop_at_any_limit(spark, limit):
    draw = random.Random(3)
    rows = [(k, k % 3, draw.choice([None, 0.5, 0.7, draw.random()]), float(x := draw.randrange(300)), float(y := draw.randrange(40)), x + draw.choice([8.0, 12.0]), y + 10.0) for k in range(240)]
    rows = [*rows, *[(1000 + r[0], 9, *r[2:]) for r in chain(30)]]
    df = spark.createDataFrame(rows, BOXES)
    pairs = boxes.box_pairs(df, df, ["scene_id"], 64.0, boxes._stronger() & (boxes.X.iou("a", "b") >= 0.3))
    edges = pairs.select(F.xxhash64("scene_id").alias("grp"), fixpoint.ranked(F.col("a.confidence"), F.col("a.det_id")).alias("rank"), F.col("a.det_id").alias("strong"), F.col("b.det_id").alias("weak"))
    kept = fixpoint.greedy_keep(df.select(F.col("det_id").alias("id")), edges, limit)
    assert sorted(r.id for r in kept.collect()) == loop_nms(rows, 0.3)


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_matching_equals_the_loop_at_any_limit(spark, limit):
    draw = random.Random(4)
    rows = [(s, 100 * s + p, draw.random(), 100 * s + 50 + draw.randrange(12), draw.choice([0.5, 0.6, draw.random()])) for s in range(3) for p in range(15) for _ in range(4)]
    rows = list({(r[1], r[3]): r for r in rows}.values())
    rank = {p: c for _, p, c, _, _ in rows}
    want, taken = {}, set()
    for p in sorted(rank, key=lambda p: (-rank[p], p)):
        for _, g in sorted((-r[4], r[3]) for r in rows if r[1] == p):
            if g not in taken:
                want[p] = g
                taken.add(g)
                break
    df = spark.createDataFrame([(s, p, rank[p], g, x) for s, p, _, g, x in rows], "grp long, p long, conf double, g long, score double")
    got = fixpoint.greedy_match(df.withColumn("rank", fixpoint.ranked(F.col("conf"), F.col("p"))), limit)
    assert {r.p: r.g for r in got.collect()} == want


def test_nothing_to_decide(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.0, 0.0, 1.0, 1.0), (2, 1, 0.5, 5.0, 5.0, 6.0, 6.0)], BOXES)
    assert boxes.nms(df).count() == 2 and boxes.nms(df.where("false")).count() == 0
    none = spark.createDataFrame([], "grp long, p long, g long, score double, conf double").withColumn("rank", fixpoint.ranked(F.col("conf"), F.col("p")))
    assert fixpoint.greedy_match(none).collect() == []


# --- drift


RUNS = "model_name string, created_at timestamp_ntz, id long, num_detections double, avg_confidence double"


def batches_of(draw, n):
    """Ten batches, rows out of order, equal times, a hot model, missing values and a model that is too new."""
    start = pd.Timestamp("2024-01-01")
    for b in range(n):
        rows = [("hot", start + pd.Timedelta(hours=draw.randrange(100 + 30 * b)), b * 1000 + k, float(draw.randrange(50) + 9 * (b > 6)), draw.choice([None, draw.random()])) for k in range(60)]
        rows += [("rare", start + pd.Timedelta(hours=10 * b + k), b * 1000 + 500 + k, 5.0, 0.5 + b / 50) for k in range(b % 3)]
        rows += [("same", start, 7, 1.0 * b, None)] + ([("new", start, 1, 1.0, 1.0)] if b == 9 else [])
        yield rows


def test_drift_from_state_equals_drift_over_history(spark, tmp_path):
    n, draw, history, seen = 10, random.Random(6), [], {}
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches_of(draw, 10)):
        frame = pd.DataFrame(rows, columns=["model_name", "created_at", "id", "num_detections", "avg_confidence"])
        schema = pa.schema([("model_name", pa.string()), ("created_at", pa.timestamp("us")), ("id", pa.int64()), ("num_detections", pa.float64()), ("avg_confidence", pa.float64())])
        pq.write_table(pa.Table.from_pandas(frame, schema=schema, preserve_index=False), tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
        history += rows
        df = spark.createDataFrame([(r[0], r[1].to_pydatetime(), *r[2:]) for r in history], RUNS)
        seen[k] = {r.model_name: tuple(r) for r in runs.drift_zscore(df, n, 0.5).collect()}
    stream = spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {}

    def batch(rows, number):
        out[number] = {r.model_name: tuple(r) for r in rows.collect()}

    before = spark.conf.get(streams._PROVIDER)
    spark.conf.set(streams._PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = streams.rolling_drift(stream, n, 0.5).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).outputMode("update").foreachBatch(batch).start()
        query.awaitTermination()
    finally:
        spark.conf.set(streams._PROVIDER, before)
    size = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in (json.loads(p.json) for p in query.recentProgress) if p["numInputRows"]]
    assert len(out) == 10 and set(out[9]) == {"hot", "rare", "same"} & set(seen[9])
    for k, rows in out.items():
        for name, got in rows.items():
            want = seen[k][name]
            assert got[0] == want[0] and got[1] == want[1] and got[3:] == want[3:], (k, got, want)
            assert got[2] == pytest.approx(want[2], rel=1e-9, abs=1e-9)
    assert max(size) - min(size[3:]) <= 2 * (n + 4), size
