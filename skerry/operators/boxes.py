"""Box and point algorithms over whole archives: suppression, merging, matching, fusion and flags."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.functions import exprs as X

from . import scenes as S
from .fixpoint import cut, greedy_keep, greedy_match, ranked
from .pairs import box_pairs, point_pairs

BOX = ["x_min", "y_min", "x_max", "y_max"]


def pixel_to_geo(dets: DataFrame, scenes: DataFrame, tile: int = 640, per_row: int = 4) -> DataFrame:
    """Tile pixels to degrees by the scene's affine (c0, c1, c2 for lon; f0, f1, f2 for lat): the centre, and the box of the
    four turned corners."""
    row, col = F.floor(F.col("tile_index") / per_row) * tile, (F.col("tile_index") % per_row) * tile
    lon = lambda x, y: F.col("c0") + F.col("c1") * x + F.col("c2") * y
    lat = lambda x, y: F.col("f0") + F.col("f1") * x + F.col("f2") * y
    xs, ys = [F.col("x_min") + col, F.col("x_max") + col], [F.col("y_min") + row, F.col("y_max") + row]
    corners = [(x, y) for x in xs for y in ys]
    cx, cy = (xs[0] + xs[1]) / 2, (ys[0] + ys[1]) / 2
    out = dets.join(scenes, "scene_id")
    return out.select(
        *dets.columns, lon(cx, cy).alias("geo_lon"), lat(cx, cy).alias("geo_lat"), F.least(*[lon(*p) for p in corners]).alias("geo_lon_min"), F.greatest(*[lon(*p) for p in corners]).alias("geo_lon_max"),
        F.least(*[lat(*p) for p in corners]).alias("geo_lat_min"), F.greatest(*[lat(*p) for p in corners]).alias("geo_lat_max"),
    )


def geo_to_pixel(points: DataFrame, scenes: DataFrame) -> DataFrame:
    """The inverse affine; null where the transform is degenerate."""
    det = F.nullif(F.col("c1") * F.col("f2") - F.col("c2") * F.col("f1"), F.lit(0.0))
    u, v = F.col("longitude") - F.col("c0"), F.col("latitude") - F.col("f0")
    out = points.join(scenes, "scene_id")
    return out.select(*points.columns, F.floor((u * F.col("f2") - v * F.col("c2")) / det).alias("px"), F.floor((v * F.col("c1") - u * F.col("f1")) / det).alias("py"))


def aoi_window(scenes: DataFrame, areas: DataFrame) -> DataFrame:
    """The pixel window of an area of interest (lon_min, lat_min, lon_max, lat_max) in each of its scenes, and the transform of
    the crop. The four corners go through the inverse of the affine, which may be turned, and the box around them is clamped
    to the scene. Where it misses the scene (`crops` false), or a corner has no place, the whole scene stays.

    A degenerate transform is inverted along its axes; an axis without a scale has all corners at 0."""
    c1, c2, f1, f2 = (F.col(k) for k in ("c1", "c2", "f1", "f2"))
    det = c1 * f2 - c2 * f1
    flat = F.abs(det) < 1e-20
    corners = [(F.col(x) - F.col("c0"), F.col(y) - F.col("f0")) for x in ("lon_min", "lon_max") for y in ("lat_min", "lat_max")]
    along = lambda v, scale: F.coalesce(F.try_divide(v, scale), F.lit(0.0))
    cols = [F.when(flat, along(u, c1)).otherwise(F.try_divide(f2 * u - c2 * v, det)) for u, v in corners]
    rows = [F.when(flat, along(v, f2)).otherwise(F.try_divide(c1 * v - f1 * u, det)) for u, v in corners]
    whole = lambda x: x.cast("long")  # noqa: E731  towards zero
    ends = {
        "col_start": F.greatest(F.lit(0), whole(F.least(*cols))), "col_end": F.least(F.col("n_cols"), whole(F.greatest(*cols)) + 1),
        "row_start": F.greatest(F.lit(0), whole(F.least(*rows))), "row_end": F.least(F.col("n_rows"), whole(F.greatest(*rows)) + 1),
    }
    out = areas.join(scenes, "scene_id").withColumns({f"_{k}": v for k, v in ends.items()})
    crops = F.coalesce((F.col("_col_start") < F.col("_col_end")) & (F.col("_row_start") < F.col("_row_end")), F.lit(False))
    last = {"col_start": F.lit(0), "col_end": F.col("n_cols"), "row_start": F.lit(0), "row_end": F.col("n_rows")}
    out = out.withColumns({k: F.when(crops, F.col(f"_{k}")).otherwise(v).cast("long") for k, v in last.items()} | {"crops": crops})
    origin = [(F.col("c0") + F.col("col_start") * c1 + F.col("row_start") * c2).alias("new_c0"), (F.col("f0") + F.col("col_start") * f1 + F.col("row_start") * f2).alias("new_f0")]
    return out.select(*areas.columns, "crops", *last, *origin)


def tile_local(dets: DataFrame, size: int = 640, per_row: int = 4, slack: float = 1.5) -> DataFrame:
    """Boxes in tile coordinates: one that ends beyond `slack` tiles is taken for a box in scene coordinates and moved by its
    tile's place."""
    beyond = (F.col("x_max") > size * slack) | (F.col("y_max") > size * slack)
    col, row = (F.col("tile_index") % per_row) * size, F.floor(F.col("tile_index") / per_row) * size
    moved = {"x_min": col, "x_max": col, "y_min": row, "y_max": row}
    return dets.withColumns({k: F.when(beyond, F.col(k) - by).otherwise(F.col(k)) for k, by in moved.items()})


def _stronger() -> Column:
    return ranked(F.col("a.confidence"), F.col("a.det_id")) < ranked(F.col("b.confidence"), F.col("b.det_id"))


def _strongest(slim: DataFrame, on: list[str], able: Column) -> DataFrame:
    """Of able rows with equal keys and place the strongest, and all other rows. Rows in one place are in conflict with each
    other and with the same others, so the loop keeps no more than that one, and pairs of equal rows are never built."""
    able = F.coalesce(able, F.lit(False))
    for k in on:
        able = able & F.col(k).isNotNull()
    first = F.min(F.struct(ranked(F.col("confidence"), F.col("det_id")).alias("rank"), "det_id", "confidence")).alias("first")
    one = slim.where(able).groupBy(*on).agg(first).select(*on, "first.det_id", "first.confidence")
    return cut(one.unionByName(slim.where(~able)))


def _kept(dets: DataFrame, slim: DataFrame, pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    edges = pairs.select(F.xxhash64(*keys).alias("grp"), ranked(F.col("a.confidence"), F.col("a.det_id")).alias("rank"), F.col("a.det_id").alias("strong"), F.col("b.det_id").alias("weak"))
    keep = greedy_keep(slim.select(F.col("det_id").alias("id")), edges)
    return dets.join(keep.withColumnRenamed("id", "det_id"), "det_id", "left_semi")


def nms(dets: DataFrame, threshold: float = 0.3, keys: tuple[str, ...] = ("scene_id",), cell: float = 64.0) -> DataFrame:
    """Greedy non-maximum suppression by confidence inside each key; an overlap of the threshold itself suppresses."""
    if threshold <= 0:
        return _nms_by_joins(dets, threshold, keys, cell)

    def solve(t: pa.Table, group: np.ndarray) -> pa.Table:
        boxes, valid = S.floats(t, *BOX)
        at = np.flatnonzero(valid & (group >= 0))
        boxes, place = [x[at] for x in boxes], S.strength(t, "confidence", "det_id")[at]

        def pairs():
            for a, b in S.reaching(group[at], boxes[0], boxes[2]):
                a, b, iou = S.overlaps(boxes, a, b)
                yield a[iou >= threshold], b[iou >= threshold]

        return _only(t, at, S.kept(place, pairs()))

    done, rest = S.solved(dets, list(keys), BOX, solve, dets.schema)
    return done if rest is None else done.unionByName(_nms_by_joins(rest, threshold, keys, cell))


def _only(t: pa.Table, at: np.ndarray, keep: np.ndarray) -> pa.Table:
    """The rows at these places that are kept, and all others."""
    mask = np.ones(t.num_rows, bool)
    mask[at] = keep
    return t.filter(pa.array(mask))


def _nms_by_joins(dets: DataFrame, threshold: float, keys: tuple[str, ...], cell: float) -> DataFrame:
    slim = dets.select(*keys, "det_id", "confidence", *BOX)
    if threshold <= 1:
        slim = _strongest(slim, [*keys, *BOX], X.area(*[F.col(c) for c in BOX]) > 0)
    return _kept(dets, slim, box_pairs(slim, slim, list(keys), cell, _stronger() & (X.iou("a", "b") >= threshold)), keys)


def merge_tiles(dets: DataFrame, tile: int = 640, per_row: int = 4, threshold: float = 0.3) -> DataFrame:
    """Tile boxes in scene coordinates, then suppression over the whole scene."""
    row, col = F.floor(F.col("tile_index") / per_row) * tile, (F.col("tile_index") % per_row) * tile
    shifted = dets.withColumns({"x_min": F.col("x_min") + col, "x_max": F.col("x_max") + col, "y_min": F.col("y_min") + row, "y_max": F.col("y_max") + row})
    return nms(shifted, threshold)


def geo_dedup(dets: DataFrame, degrees: float = 5e-4, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Greedy by confidence: a detection goes if a kept one is within `degrees` along both axes. Rows without a place pass."""

    def solve(t: pa.Table, group: np.ndarray) -> pa.Table:
        (lon, lat), valid = S.floats(t, "longitude", "latitude")
        at = np.flatnonzero(valid & (group >= 0))
        lon, lat, place = lon[at], lat[at], S.strength(t, "confidence", "det_id")[at]

        def pairs():
            for a, b in S.reaching(group[at], lon, lon + degrees * 1.01):
                near = (np.abs(lon[a] - lon[b]) <= degrees) & (np.abs(lat[a] - lat[b]) <= degrees)
                yield a[near], b[near]

        return _only(t, at, S.kept(place, pairs()))

    done, rest = S.solved(dets, list(keys), ["longitude", "latitude"], solve, dets.schema)
    return done if rest is None else done.unionByName(_dedup_by_joins(rest, degrees, keys))


def _dedup_by_joins(dets: DataFrame, degrees: float, keys: tuple[str, ...]) -> DataFrame:
    placed = dets.where("longitude is not null and latitude is not null")
    slim = placed.select(*keys, "det_id", "confidence", "longitude", "latitude")
    near = (F.abs(F.col("a.longitude") - F.col("b.longitude")) <= degrees) & (F.abs(F.col("a.latitude") - F.col("b.latitude")) <= degrees)
    slim = _strongest(slim, [*keys, "longitude", "latitude"], ~F.isnan("longitude") & ~F.isnan("latitude"))
    return _kept(placed, slim, point_pairs(slim, slim, list(keys), degrees * 1.01, _stronger() & near), keys).unionByName(dets.where("longitude is null or latitude is null"))


def matches(preds: DataFrame, truths: DataFrame, keys: tuple[str, ...] = ("scene_id",), threshold: float = 0.5, mode: str = "iou", cell: float = 64.0) -> DataFrame:
    """(det_id, gt_id), one to one: predictions by confidence take their best free truth, of overlap at least the threshold or
    with centres at most `threshold` pixels apart."""
    return _matched(preds, truths.withColumn("confidence", F.lit(None).cast("double")), keys, threshold, mode, cell).select("det_id", "gt_id")


def _matched(preds: DataFrame, truths: DataFrame, keys: tuple[str, ...], threshold: float, mode: str = "iou", cell: float = 64.0) -> DataFrame:
    """The matches with their keys and both confidences, `ca` and `cb`."""
    out = [*keys, "det_id", "gt_id", "ca", "cb"]
    if threshold <= 0:
        return _matched_by_joins(preds, truths, keys, threshold, mode, cell).select(*out)
    slim = lambda df, id_, side: df.select(*keys, F.col(id_).alias("_id"), F.col("confidence").cast("double").alias("_conf"), *BOX, F.lit(side).alias("_side"))
    rows = slim(preds, "det_id", True).unionByName(slim(truths, "gt_id", False))

    def solve(t: pa.Table, group: np.ndarray) -> pa.Table:
        boxes, valid = S.floats(t, *BOX)
        side = t.column("_side").combine_chunks().to_numpy(zero_copy_only=False)
        p, g = _pick(t, np.flatnonzero(valid & (group >= 0)), group, side, boxes, S.strength(t, "_conf", "_id"), "_id", threshold, mode)
        one, two = t.take(pa.array(p)), t.take(pa.array(g))
        return pa.table([*[one.column(k) for k in keys], one.column("_id"), two.column("_id"), one.column("_conf"), two.column("_conf")], names=out)

    kinds = rows.schema
    schema = T.StructType([*[kinds[k] for k in keys], T.StructField("det_id", kinds["_id"].dataType), T.StructField("gt_id", kinds["_id"].dataType), T.StructField("ca", T.DoubleType()), T.StructField("cb", T.DoubleType())])
    done, rest = S.solved(rows, list(keys), BOX, solve, schema)
    if rest is None:
        return done
    ends = [rest.where(test).drop("_side").withColumnsRenamed({"_id": id_, "_conf": "confidence"}) for test, id_ in (("_side", "det_id"), ("not _side", "gt_id"))]
    return done.unionByName(_matched_by_joins(*ends, keys, threshold, mode, cell).select(*out))


def _pick(t: pa.Table, at: np.ndarray, group: np.ndarray, side: np.ndarray, boxes: list[np.ndarray], place: np.ndarray, name: str, threshold: float, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """The matched rows of both sides among the rows at these places."""
    ids = t.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)[at]
    boxes, place, none = [x[at] for x in boxes], place[at], np.array([], np.int64)
    found = [(none, none, none.astype(float))]
    if mode == "iou":
        for a, b in S.across(side[at], S.reaching(group[at], boxes[0], boxes[2])):
            a, b, score = S.overlaps(boxes, a, b)
            found.append((a[score >= threshold], b[score >= threshold], score[score >= threshold]))
    else:
        x, y = (boxes[0] + boxes[2]) / 2, (boxes[1] + boxes[3]) / 2
        for a, b in S.across(side[at], S.reaching(group[at], x, x + threshold * 1.01)):
            apart = np.sqrt((x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2)
            found.append((a[apart <= threshold], b[apart <= threshold], -apart[apart <= threshold]))
    p, g = S.taken(place, ids, *(np.concatenate(x) for x in zip(*found, strict=True)))
    return at[p], at[g]


def _matched_by_joins(preds: DataFrame, truths: DataFrame, keys: tuple[str, ...], threshold: float, mode: str, cell: float) -> DataFrame:
    p = preds.select(*keys, "det_id", "confidence", *BOX)
    g = truths.select(*keys, "gt_id", *BOX)
    if mode == "iou":
        pairs, score = box_pairs(p, g, list(keys), cell, X.iou("a", "b") >= threshold), X.iou("a", "b")
    else:
        mid = lambda df: df.withColumn("longitude", (F.col("x_min") + F.col("x_max")) / 2).withColumn("latitude", (F.col("y_min") + F.col("y_max")) / 2)
        pairs, score = point_pairs(mid(p), mid(g), list(keys), threshold, X.center_distance("a", "b") <= threshold), -X.center_distance("a", "b")
    found = pairs.select(F.xxhash64(*keys).alias("grp"), F.col("a.det_id").alias("p"), ranked(F.col("a.confidence"), F.col("a.det_id")).alias("rank"), F.col("b.gt_id").alias("g"), score.alias("score"))
    m = greedy_match(found).select(F.col("p").alias("det_id"), F.col("g").alias("gt_id"))
    return m.join(preds.select(*keys, "det_id", F.col("confidence").alias("ca")), "det_id").join(truths.select("gt_id", F.col("confidence").alias("cb")), "gt_id")


def fuse(dets: DataFrame, threshold: float = 0.3, keys: tuple[str, ...] = ("scene_id", "tile_index")) -> DataFrame:
    """Threshold detections (source cfar, with their mean ratio to the background in `snr`), in id order, take the best free
    learned one (yolo) of their tile. Fused confidence is min(1, y/2 + (1 - exp(-snr/10))/2); learned ones left over keep
    their score, threshold ones get 0.6 of theirs."""
    slim = dets.select("det_id", *keys, *BOX, "source", "confidence", "snr")
    return _fused(slim, threshold, keys).select("det_id", "source", "confidence")


def _fused(dets: DataFrame, threshold: float = 0.3, keys: tuple[str, ...] = ("scene_id", "tile_index")) -> DataFrame:
    """The rows that `fuse` leaves, with all columns."""
    both = dets.where("source in ('cfar', 'yolo')")
    schema = T.StructType([*both.schema, T.StructField("_met", T.BooleanType()), T.StructField("_score", both.schema["confidence"].dataType)])

    def solve(t: pa.Table, group: np.ndarray) -> pa.Table:
        boxes, valid = S.floats(t, *BOX)
        side = np.array([s == "cfar" for s in t.column("source").to_pylist()], bool)
        p, g = _pick(t, np.flatnonzero(valid & (group >= 0)), group, side, boxes, S.strength(t, None, "det_id"), "det_id", threshold, "iou")
        met, of, gone = np.zeros(t.num_rows, bool), np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, bool)
        met[p], of[p], gone[g] = True, g, True
        score = t.column("confidence").combine_chunks().take(pa.array(of, mask=~met))
        return t.append_column("_met", pa.array(met)).append_column("_score", score).filter(pa.array(~gone))

    if threshold > 0:
        done, rest = S.solved(both, list(keys), BOX, solve, schema)
    else:
        done, rest = both.limit(0).withColumns({"_met": F.lit(False), "_score": F.col("confidence")}), both
    out = done if rest is None else done.unionByName(_fused_by_joins(rest, threshold, keys))
    own = X.snr_to_confidence(F.col("snr"))
    learned = F.col("source") == "yolo"
    confidence = F.when(F.col("_met"), F.least(F.lit(1.0), F.col("_score") / 2 + own / 2)).when(learned, F.col("confidence")).otherwise(own * 0.6)
    return out.withColumns({"source": F.when(F.col("_met"), "fused").otherwise(F.col("source")), "confidence": confidence}).drop("_met", "_score")


def _fused_by_joins(dets: DataFrame, threshold: float, keys: tuple[str, ...]) -> DataFrame:
    c, y = dets.where("source = 'cfar'"), dets.where("source = 'yolo'")
    slim = ["det_id", *keys, *BOX]
    pairs = box_pairs(c.select(*slim), y.select(*slim), list(keys), 64.0, X.iou("a", "b") >= threshold)
    m = cut(greedy_match(pairs.select(F.xxhash64(*keys).alias("grp"), F.col("a.det_id").alias("p"), ranked(F.lit(0.0), F.col("a.det_id")).alias("rank"), F.col("b.det_id").alias("g"), X.iou("a", "b").alias("score"))))
    scores = m.join(y.select(F.col("det_id").alias("g"), F.col("confidence").alias("_score")), "g").select(F.col("p").alias("det_id"), "_score", F.lit(True).alias("_met"))
    met = c.join(scores, "det_id", "left").withColumn("_met", F.coalesce("_met", F.lit(False)))
    alone = y.join(m.select(F.col("g").alias("det_id")), "det_id", "left_anti").withColumns({"_met": F.lit(False), "_score": F.lit(None).cast("double")})
    return met.unionByName(alone)


def cluster_anomaly(dets: DataFrame, radius: float = 0.01, least: int = 8, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Flags detections with at least `least` neighbours, themselves included, within the radius in degrees. Points of one
    cell are counted as one row with their number before pairs are built, so a crowded port stays small."""

    def solve(t: pa.Table, group: np.ndarray) -> pa.Table:
        (lon, lat), valid = S.floats(t, "longitude", "latitude")
        at = np.flatnonzero(valid & (group >= 0))
        # points in one place are one row with their number
        places, where, k = np.unique(np.stack([group[at].astype(float), lon[at], lat[at]]), axis=1, return_inverse=True, return_counts=True)
        scene, x, y = places
        n = k.copy()
        for a, b in S.reaching(scene, x, x + radius * 1.01):
            near = np.sqrt((x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2) <= radius
            a, b = a[near], b[near]
            n += (np.bincount(a, k[b], len(n)) + np.bincount(b, k[a], len(n))).astype(n.dtype)
        neighbours, met = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, bool)
        neighbours[at], met[at] = n[where.ravel()], True
        return t.append_column("neighbours", pa.array(neighbours, mask=~met)).append_column("is_cluster", pa.array(met & (neighbours >= least)))

    schema = T.StructType([*dets.schema, T.StructField("neighbours", T.LongType()), T.StructField("is_cluster", T.BooleanType())])
    done, rest = S.solved(dets, list(keys), ["longitude", "latitude"], solve, schema)
    return done if rest is None else done.unionByName(_clusters_by_joins(rest, radius, least, keys))


def _clusters_by_joins(dets: DataFrame, radius: float, least: int, keys: tuple[str, ...]) -> DataFrame:
    slim = dets.select(*keys, "longitude", "latitude").where("longitude is not null").groupBy(*keys, "longitude", "latitude").agg(F.count("*").alias("k"))
    apart = F.sqrt(F.pow(F.col("a.longitude") - F.col("b.longitude"), F.lit(2)) + F.pow(F.col("a.latitude") - F.col("b.latitude"), F.lit(2)))
    near = point_pairs(slim, slim, list(keys), radius * 1.01, apart <= radius)
    counts = near.groupBy(*keys, F.col("a.longitude").alias("longitude"), F.col("a.latitude").alias("latitude")).agg(F.sum("b.k").alias("neighbours"))
    return dets.join(counts, [*keys, "longitude", "latitude"], "left").withColumn("is_cluster", F.coalesce(F.col("neighbours") >= least, F.lit(False)))


def chip_window(dets: DataFrame, pad: int = 32, least: int = 64, size: int = 640) -> DataFrame:
    """The crop around each box: padded, at least `least` pixels a side, clamped to the tile; null below 4 pixels."""
    def side(lo: str, hi: str) -> tuple[Column, Column]:
        middle, half = (F.col(lo) + F.col(hi)) / 2, F.greatest((F.col(hi) - F.col(lo)) / 2 + pad, F.lit(least / 2))
        return F.greatest(F.lit(0.0), F.floor(middle - half)), F.least(F.lit(float(size)), F.ceil(middle + half))

    (x0, x1), (y0, y1) = side("x_min", "x_max"), side("y_min", "y_max")
    fits = (x1 - x0 >= 4) & (y1 - y0 >= 4)
    return dets.select("det_id", *[F.when(fits, v).alias(k) for k, v in (("chip_x0", x0), ("chip_y0", y0), ("chip_x1", x1), ("chip_y1", y1))])


def reproducibility(a: DataFrame, b: DataFrame, threshold: float = 0.9, tolerance: float = 0.01) -> DataFrame:
    """One row for each scene: counts, matched pairs, mean difference of confidence, and the verdict."""
    m = _matched(a, b.withColumnRenamed("det_id", "gt_id"), ("scene_id",), threshold)
    paired = m.groupBy("scene_id").agg(F.count("*").alias("matched"), F.avg(F.abs(F.col("ca") - F.col("cb"))).alias("mean_diff"))
    counts = a.groupBy("scene_id").agg(F.count("*").alias("n_a")).join(b.groupBy("scene_id").agg(F.count("*").alias("n_b")), "scene_id", "full_outer").join(paired, "scene_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    same = (n("n_a") == n("n_b")) & (n("matched") == n("n_a")) & (F.coalesce("mean_diff", F.lit(0.0)) <= tolerance)
    return counts.select("scene_id", n("n_a").alias("n_a"), n("n_b").alias("n_b"), n("matched").alias("matched"), F.coalesce("mean_diff", F.lit(0.0)).alias("mean_diff"), F.when(same, "REPRODUCIBLE").when(n("matched") > 0, "PARTIAL").otherwise("DIFFERENT").alias("verdict"))


def evaluate(preds: DataFrame, truths: DataFrame, areas: DataFrame, threshold: float = 0.5) -> DataFrame:
    """TP, FP, FN, precision, detection rate and false alarms per km2 of each scene, scenes without predictions included."""
    m = matches(preds, truths, threshold=threshold)
    tp = m.join(preds.select("det_id", "scene_id"), "det_id").groupBy("scene_id").agg(F.count("*").alias("tp"))
    n_p, n_g = preds.groupBy("scene_id").agg(F.count("*").alias("n_p")), truths.groupBy("scene_id").agg(F.count("*").alias("n_g"))
    out = areas.join(n_p, "scene_id", "left").join(n_g, "scene_id", "left").join(tp, "scene_id", "left").na.fill(0, ["n_p", "n_g", "tp"])
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    fp = F.col("n_p") - F.col("tp")
    return out.select("scene_id", "tp", fp.alias("fp"), (F.col("n_g") - F.col("tp")).alias("fn"), zero(F.col("tp"), F.col("n_p")).alias("precision"), zero(F.col("tp"), F.col("n_g")).alias("pd"), zero(fp, F.col("km2")).alias("far_km2"))


def postprocess(dets: DataFrame, scenes: DataFrame, mask: DataFrame, footprint: list[tuple[float, float]], buffer_px: float = 0.0) -> DataFrame:
    """The batch job over all scenes: fuse, place on the map, drop the swath's edge, doubles and stripes, flag clusters and
    land, and give each detection its verdict.

    dets: (det_id, scene_id, tile_index, source, confidence, snr, box); scenes: (scene_id, n_rows, n_cols, affine c0, c1, c2,
    f0, f1, f2). `A3` (runs.detection_stats) sums the result up."""
    from .relations import column_density_filter, edge_swath_filter, land_lookup

    slim = dets.select("det_id", "scene_id", "tile_index", "source", "confidence", "snr", *BOX)
    placed = pixel_to_geo(_fused(slim), scenes.drop("n_rows", "n_cols")).withColumnsRenamed({"geo_lon": "longitude", "geo_lat": "latitude"})
    placed = placed.select("det_id", "scene_id", "source", "confidence", "longitude", "latitude", *BOX)
    # each of the next steps reads its input twice or more: it is written once instead
    inner = cut(edge_swath_filter(placed, scenes.select("scene_id", "n_rows", "n_cols"), buffer_px))
    flagged = cluster_anomaly(cut(column_density_filter(cut(geo_dedup(inner)))))
    marked = land_lookup(flagged, mask)
    verdict = X.quality_verdict(~X.point_in_convex_polygon("longitude", "latitude", footprint), "mask_on_land", "is_cluster", "source")
    return marked.select("det_id", "scene_id", "source", F.round(X.finite_or_null("confidence"), 6).alias("confidence"), "longitude", "latitude", *BOX, verdict.alias("verdict"))
