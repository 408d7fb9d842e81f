"""Aggregates, windows and cost columns over runs, detections and samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.functions.exprs import labelled_box, point_in_bbox

from .fixpoint import cut

#: Rows of a group up to which its different values are held in one task while a percentile is taken.
HELD = 1_000_000


def _p(x: str, q: float) -> Column:
    return F.percentile(x, F.lit(q))


def same(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Both tables by equal keys, nulls included; the keys of the left one stay. Without keys the right table is one row of
    totals."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    named = right.withColumnsRenamed({k: f"_key_{k}" for k in by})
    test = reduce(and_, [left[k].eqNullSafe(named[f"_key_{k}"]) for k in by])
    return left.join(named, test, how).drop(*[f"_key_{k}" for k in by])


def small(df: DataFrame, rows: int = 300_000) -> DataFrame:
    """The table written once, marked for broadcast if it has no more than `rows` rows; else a join shuffles."""
    out = cut(df)
    return F.broadcast(out) if out.count() <= rows else out


def dimension(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A table of settings, marked for broadcast if it has no more than `rows` rows; it is counted as it stands."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def quantiles(df: DataFrame, value: str, by: Sequence[str] = (), held: int = HELD, **shares: float) -> DataFrame:
    """Exact percentiles of each group, with linear interpolation; nulls do not count, a group without values has none.

    Groups of up to `held` rows take the aggregate, which gathers the different values of a group in one task. Where a group
    has more, different values are counted, numbered by a running sum over a range partitioning, and each rank is the least
    value that reaches it: every step is dealt evenly however large a group is."""
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    most = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= held:
        return rows.groupBy(*by).agg(*[_p("_v", q).alias(k) for k, q in shares.items()])
    counted = running_sum(rows.groupBy(*by, "_v").agg(F.count("*").alias("_n")), [F.col("_v")], {"_upto": F.col("_n")}, by=by)
    total = counted.groupBy(*by).agg(F.max("_upto").alias("_total"))
    at = {k: (F.col("_total") - 1) * F.lit(q) for k, q in shares.items()}
    ends = {f"_{end}_{k}": F.min(F.when(F.col("_upto") > rank(x), F.col("_v"))) for k, x in at.items() for end, rank in (("low", F.floor), ("high", F.ceil))}
    found = same(counted, small(total), by).groupBy(*by).agg(F.max("_total").alias("_total"), *[x.alias(k) for k, x in ends.items()])
    low, high = (lambda k: F.col(f"_low_{k}")), (lambda k: F.col(f"_high_{k}"))
    between = lambda k, x: (F.ceil(x) - x) * low(k) + (x - F.floor(x)) * high(k)
    return found.select(*by, *[F.when(low(k) == high(k), low(k)).otherwise(between(k, x)).alias(k) for k, x in at.items()])


def benchmarks(runs: DataFrame, model: str | None = None, profile: str | None = None) -> DataFrame:
    """Successful runs by model and profile; exact percentiles."""
    df = runs.where("status = 'success'")
    if model is not None:
        df = df.where(F.col("model_name") == model)
    if profile is not None:
        df = df.where(F.col("constraint_profile") == profile)
    by = ["model_name", "model_version", "model_size_mb", "compression_technique", "constraint_profile"]
    means = df.groupBy(*by).agg(
        F.count("*").alias("runs"), F.avg("inference_ms").alias("avg_inference_ms"),
        F.avg("peak_ram_mb").alias("avg_peak_ram_mb"), F.avg("cpu_usage_pct").alias("avg_cpu_pct"), F.avg("num_detections").alias("avg_detections"), F.avg("avg_confidence").alias("avg_confidence"),
    )
    return same(means, quantiles(df, "inference_ms", by, p50_inference_ms=0.5, p95_inference_ms=0.95), by, "left")


def profile_comparison(runs: DataFrame, by: tuple[str, ...] = ("image_id", "model_name")) -> DataFrame:
    return runs.groupBy(*by, "constraint_profile", "model_version").agg(
        F.avg("inference_ms").alias("avg_latency_ms"), F.avg("peak_ram_mb").alias("avg_ram_mb"), F.avg("num_detections").alias("avg_detections"),
        F.count_if(F.col("status") == "success").alias("successes"), F.count_if(F.col("status") != "success").alias("failures"),
    )


def detection_stats(dets: DataFrame) -> DataFrame:
    """One row, of zeros when there are no detections. The extent is that of the boxes `bbox_geo` (west, south, east, north)
    where the table has this column and it holds four values, else that of the centres; null without any."""
    n = lambda test: F.count_if(test)

    def side(k: int, centre: str):
        if "bbox_geo" not in dets.columns:
            return F.col(centre)
        return F.when(F.size("bbox_geo") == 4, F.get("bbox_geo", F.lit(k))).otherwise(F.col(centre))

    return dets.agg(
        F.count("*").alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), F.coalesce(F.min("confidence"), F.lit(0.0)).alias("min_confidence"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("max_confidence"),
        n(F.col("source") == "cfar").alias("n_cfar"), n(F.col("source") == "yolo").alias("n_yolo"), n(F.col("source") == "fused").alias("n_fused"),
        F.min(side(0, "longitude")).alias("lon_min"), F.min(side(1, "latitude")).alias("lat_min"), F.max(side(2, "longitude")).alias("lon_max"), F.max(side(3, "latitude")).alias("lat_max"),
    )


def scene_summary(dets: DataFrame, areas: Sequence[tuple[str, tuple[float, float, float, float]]], frame: tuple[float, float, float, float], held: int = HELD) -> DataFrame:
    """A row for each scene: detections, vessels (`is_vessel`, where null counts as one), the median of latitude and longitude,
    the extent, the first of the areas (name, (west, south, east, north)) that holds the medians, else 'other', and whether
    the frame does. Edges are inside; a scene without places has null extents, area 'other' and is outside."""
    counts = dets.groupBy("scene_id").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("is_vessel", F.lit(True))).alias("n_vessels"),
        F.min("longitude").alias("lon_min"), F.min("latitude").alias("lat_min"), F.max("longitude").alias("lon_max"), F.max("latitude").alias("lat_max"),
    )
    lat, lon = quantiles(dets, "latitude", ["scene_id"], held, lat=0.5), quantiles(dets, "longitude", ["scene_id"], held, lon=0.5)
    out = same(same(counts, lat, ["scene_id"], "left"), lon, ["scene_id"], "left")
    area = F.coalesce(labelled_box("lon", "lat", list(areas)), F.lit("other"))
    return out.withColumn("area", area).withColumn("in_frame", F.coalesce(point_in_bbox("lon", "lat", frame), F.lit(False)))


def area_histogram(summary: DataFrame) -> DataFrame:
    """Scenes and detections of each area, all and those whose middle is in the frame. summary: rows of `scene_summary`."""
    inside = F.when(F.col("in_frame"), F.col("n")).otherwise(0)
    return summary.groupBy("area").agg(F.count("*").alias("scenes"), F.sum("n").alias("detections"), F.count_if("in_frame").alias("scenes_in_frame"), F.sum(inside).alias("detections_in_frame"))


def operational_metrics(dets: DataFrame) -> DataFrame:
    land, odd = F.col("on_land"), F.col("cluster_anomaly")
    return dets.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(land).alias("on_land"), F.count_if(odd).alias("anomaly"), F.count_if(land & odd).alias("both"), F.count_if(~land & ~odd).alias("clean"),
        F.avg("confidence").alias("avg_conf"), F.min("confidence").alias("min_conf"), F.max("confidence").alias("max_conf"),
    )


def detector_agreement(dets: DataFrame) -> DataFrame:
    """Share of detections that both detectors found, and the share of clean ones that only the threshold detector gave."""
    clean = ~F.col("on_land") & ~F.col("cluster_anomaly")
    return dets.agg(F.count("*").alias("total"), F.count_if(F.col("source") == "fused").alias("fused"), F.count_if(clean).alias("clean"), F.count_if(clean & (F.col("source") == "cfar")).alias("clean_cfar")).select(
        "total", "fused", (F.col("fused") / F.nullif("total", F.lit(0))).alias("agreement"), (F.col("clean_cfar") / F.nullif("clean", F.lit(0))).alias("far_proxy")
    )


def reconcile_run_stats(runs: DataFrame, dets: DataFrame) -> DataFrame:
    """Runs whose stored count differs from their detections, with the right one."""
    counted = dets.groupBy(F.col("execution_id").alias("id")).agg(F.count("*").cast("int").alias("actual"))
    joined = runs.join(counted, "id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.where(~F.col("num_detections").eqNullSafe(F.col("actual")))


def suspect_runs(dets: DataFrame, most: int = 100) -> DataFrame:
    """Scenes with more than `most` detections of which none was confirmed."""
    return dets.groupBy("scene_id", "tile_index").agg(F.count("*").alias("n"), F.count_if(F.col("source").isin("yolo", "fused")).alias("confirmed")).where((F.col("n") > most) & (F.col("confirmed") == 0))


def resource_summary(samples: DataFrame, held: int = HELD) -> DataFrame:
    """Peaks and means of each run, and the 95th percentile of the seconds between its samples; gaps are written once."""
    order = Window.partitionBy("run_id").orderBy("ts")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    gaps = cut(samples.select("run_id", (gap / 1e6).alias("gap_s")))
    stats = samples.groupBy("run_id").agg(F.count("*").alias("n"), F.max("ram_mb").alias("peak_ram"), F.avg("ram_mb").alias("avg_ram"), F.max("cpu_pct").alias("peak_cpu"), F.avg("cpu_pct").alias("avg_cpu"))
    return same(stats, quantiles(gaps, "gap_s", ["run_id"], held, p95_gap_s=0.95), ["run_id"], "left")


def latency_summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    moments = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return same(moments, quantiles(df, value, by, p50=0.5, p95=0.95, p99=0.99), by, "left")


def daily_percentiles(runs: DataFrame, value: str = "inference_ms") -> DataFrame:
    days = runs.select(F.date_trunc("day", F.col("created_at").cast("timestamp")).cast("timestamp_ntz").alias("day"), value)
    return quantiles(days, value, ["day"], p50=0.5, p95=0.95, p99=0.99)


def gcp_affine_fit(gcps: DataFrame, least: int = 4) -> DataFrame:
    """Least squares of lon and lat on (pixel, line, 1) per scene from centred sums, and the root mean square error."""
    means = gcps.groupBy("scene_id").agg(F.count("*").alias("n"), *[F.avg(k).alias(f"m_{k}") for k in ("pixel", "line", "lon", "lat")]).where(F.col("n") >= least)
    centred = gcps.join(means, "scene_id")
    p, q = F.col("pixel") - F.col("m_pixel"), F.col("line") - F.col("m_line")
    x, y = F.col("lon") - F.col("m_lon"), F.col("lat") - F.col("m_lat")
    sums = centred.groupBy("scene_id").agg(F.sum(p * p).alias("pp"), F.sum(p * q).alias("pq"), F.sum(q * q).alias("qq"), F.sum(p * x).alias("px"), F.sum(q * x).alias("qx"), F.sum(p * y).alias("py"), F.sum(q * y).alias("qy"))
    det = F.nullif(F.col("pp") * F.col("qq") - F.col("pq") * F.col("pq"), F.lit(0.0))
    solve = lambda a, b: (((F.col(a) * F.col("qq") - F.col(b) * F.col("pq")) / det), ((F.col(b) * F.col("pp") - F.col(a) * F.col("pq")) / det))
    (lon_p, lon_l), (lat_p, lat_l) = solve("px", "qx"), solve("py", "qy")
    fit = means.join(sums, "scene_id").select("scene_id", "n", "m_pixel", "m_line", "m_lon", "m_lat", lon_p.alias("lon_per_pixel"), lon_l.alias("lon_per_line"), lat_p.alias("lat_per_pixel"), lat_l.alias("lat_per_line"))
    fit = fit.withColumn("lon0", F.col("m_lon") - F.col("lon_per_pixel") * F.col("m_pixel") - F.col("lon_per_line") * F.col("m_line")).withColumn("lat0", F.col("m_lat") - F.col("lat_per_pixel") * F.col("m_pixel") - F.col("lat_per_line") * F.col("m_line"))
    off = lambda k: F.pow(F.col(f"{k}0") + F.col(f"{k}_per_pixel") * F.col("pixel") + F.col(f"{k}_per_line") * F.col("line") - F.col(k), F.lit(2))
    rmse = gcps.join(fit.drop("m_pixel", "m_line", "m_lon", "m_lat"), "scene_id").groupBy("scene_id").agg(F.sqrt(F.avg(off("lon") + off("lat"))).alias("rmse_deg"))
    return fit.drop("m_pixel", "m_line", "m_lon", "m_lat").join(rmse, "scene_id")


def running_sum(df: DataFrame, order: list[Column], values: dict[str, Column], partitions: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative sums over one order (of each group, with `by`) without a window over all rows or over a group: rows are
    range-partitioned by the order, summed inside each partition, and moved up by what the partitions before hold (one row
    for each partition and group in it). The partitioned rows are written once: range bounds come from a sample, so a
    second reading of the plan could draw other bounds."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = cut(parts.select("*", *[F.sum(v).over(inside).alias(k) for k, v in values.items()]))
    totals = sums.groupBy("_part", *by).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in values.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *by, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in values])
    out = same(sums, small(offsets), ["_part", *by])
    return out.select(*df.columns, *[(F.col(k) + F.col(f"_o_{k}")).alias(k) for k in values])


def pr_curve(scored: DataFrame, total_gt: DataFrame, by: str | None = None) -> DataFrame:
    """Cumulative precision and recall over all scenes by confidence; scored: (det_id, confidence, tp 0/1[, by]); total_gt has
    one row (per `by`) with n_gt. With `by` the sums run inside each group."""
    order = [F.desc("confidence"), F.col("det_id")]
    values = {"tp_sum": F.col("tp").cast("long"), "seen": F.lit(1).cast("long")}
    cumulative = running_sum(scored, order, values, by=[by] if by else [])
    cumulative = same(cumulative, small(total_gt), [by]) if by else cumulative.crossJoin(F.broadcast(total_gt))
    return cumulative.withColumn("precision", F.col("tp_sum") / F.col("seen")).withColumn("recall", F.coalesce(F.try_divide("tp_sum", "n_gt"), F.lit(0.0)))


def average_precision(curve: DataFrame) -> DataFrame:
    """Sum of precision times the growth of recall: recall grows by one truth at each true positive."""
    return curve.agg(F.coalesce(F.sum(F.when(F.col("tp") == 1, F.try_divide(F.col("precision"), F.col("n_gt")))), F.lit(0.0)).alias("ap"))


def drift_zscore(runs: DataFrame, n: int = 20, threshold: float = 2.5, by: str = "model_name") -> DataFrame:
    """The last n runs against all before: detections first, then confidence; population standard deviation. Runs of one
    time and id count as one place: if they are the n-th, all are among the last.

    The n-th last run of each group is found by a limit that each task applies before the shuffle; all rows are then held
    against it and summed, so no group is sorted in one task."""
    place = F.struct("created_at", "id")
    recent = top_per_group(runs.select(by, place.alias("_place")), by, n, F.desc("_place"))
    ranked = same(runs, small(recent.groupBy(by).agg(F.min("_place").alias("_nth"))), [by])
    last = place >= F.col("_nth")
    past = ~last

    def test(x: str) -> list[Column]:
        return [F.avg(F.when(last, F.col(x))).alias(f"{x}_recent"), F.avg(F.when(past, F.col(x))).alias(f"{x}_past"), F.stddev_pop(F.when(past, F.col(x))).alias(f"{x}_std"), F.count(F.when(past, F.col(x))).alias(f"{x}_n")]

    stats = ranked.groupBy(by).agg(F.count("*").alias("rows"), *test("num_detections"), *test("avg_confidence")).where(F.col("rows") >= n + 5)
    z = lambda x: F.when(F.col(f"{x}_std") == 0, F.when(F.col(f"{x}_recent") == F.col(f"{x}_past"), 0.0).otherwise(float("inf"))).otherwise(F.abs(F.col(f"{x}_recent") - F.col(f"{x}_past")) / F.col(f"{x}_std"))
    out = stats.withColumn("z_n", z("num_detections")).withColumn("z_c", F.when(F.col("avg_confidence_n") >= 3, z("avg_confidence")).otherwise(0.0))
    metric = F.when(F.col("z_n") > threshold, "num_detections").when(F.col("z_c") > threshold, "avg_confidence").otherwise("num_detections")
    score = F.when(metric == "num_detections", F.col("z_n")).otherwise(F.col("z_c"))
    advice = F.when(score > threshold * 2, "alert_ground").when(score > threshold * 1.5, "switch_model").when(score > threshold, "recalibrate").otherwise("continue")
    return out.select(by, metric.alias("metric"), score.alias("z_score"), (score > threshold).alias("is_drifting"), advice.alias("recommendation"))


def profile_retention(runs: DataFrame, profiles: DataFrame, least: float = 0.8) -> DataFrame:
    """Mean detections of each profile against the ground profile's, and the first profile that falls below `least`."""
    mean = runs.where("status = 'success'").groupBy("model_name", F.col("constraint_profile").alias("profile")).agg(F.avg("num_detections").alias("detections")).join(dimension(profiles.select("profile", "profile_rank")), "profile")
    by = Window.partitionBy("model_name")
    ground = F.first_value("detections").over(by.orderBy("profile_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = mean.withColumn("retention", F.try_divide(F.col("detections"), ground))
    return kept.withColumn("inflection_rank", F.min(F.when(F.col("retention") < least, F.col("profile_rank"))).over(by))


def top_per_group(df: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rn") <= k)


def sample_detections(dets: DataFrame, n: int, seed: str) -> DataFrame:
    """n detections of each run out of its 3n most confident clean ones, drawn by hash so that every plan draws alike."""
    clean = dets.where("not on_land and not cluster_anomaly")
    best = top_per_group(clean, "execution_id", 3 * n, F.desc("confidence"), F.col("det_id")).drop("rn")
    return top_per_group(best, "execution_id", n, F.sha2(F.concat(F.col("det_id").cast("string"), F.lit(seed)).cast("binary"), 256), F.col("det_id"))


def claim_cues(cues: DataFrame, n: int) -> DataFrame:
    """The queue after its n most urgent eligible cues are taken: a new snapshot."""
    picked = cues.where("status = 'pending' and attempts < max_attempts").orderBy(F.desc("priority"), "created_at", "id").limit(n).select("id", F.lit(True).alias("_picked"))
    out = cues.join(F.broadcast(picked), "id", "left")
    return out.withColumn("attempts", F.col("attempts") + F.when(F.col("_picked"), 1).otherwise(0)).withColumn("status", F.when(F.col("_picked"), "processing").otherwise(F.col("status"))).drop("_picked")


def run_energy(runs: DataFrame, processors: DataFrame) -> DataFrame:
    joules = F.col("inference_ms") / 1000 * F.col("tdp_watts") * F.least(F.col("cpu_usage_pct") / 100, F.lit(1.0))
    return runs.crossJoin(dimension(processors)).withColumn("joules", joules).withColumn("wh", joules / 3600)


def stage_energy(runs: DataFrame, processors: DataFrame, stages: dict[str, str]) -> DataFrame:
    """A row for each run, processor and stage: joules, and the stage's share of the run's total in percent.

    stages: name and column of milliseconds. A missing time is none, a missing load is full, loads end at one. Of a run without
    joules every share is 0."""
    load = F.least(F.coalesce(F.col("cpu_usage_pct") / 100, F.lit(1.0)), F.lit(1.0))
    joules = {k: F.coalesce(F.col(c), F.lit(0.0)) / 1000 * F.col("tdp_watts") * load for k, c in stages.items()}
    both = runs.crossJoin(dimension(processors.select("processor", "tdp_watts")))
    ledger = both.select("id", "processor", *[v.alias(f"_{k}") for k, v in joules.items()])
    total = sum((F.col(f"_{k}") for k in stages), F.lit(0.0))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), F.col(f"_{k}").alias("joules")) for k in stages])).alias("s")
    out = ledger.select("id", "processor", total.alias("total_joules"), rows)
    share = F.coalesce(F.try_divide(F.col("s.joules") * 100, F.col("total_joules")), F.lit(0.0))
    return out.select("id", "processor", "s.stage", "s.joules", share.alias("share_pct"), "total_joules", (F.col("total_joules") / 3600).alias("total_wh"))


def orbit_budget(energy: DataFrame, satellites: DataFrame, images: int = 10) -> DataFrame:
    """energy: groups with joules for each image."""
    available, each = F.col("payload_w") * F.col("period_min") / 60 * F.col("sunlit"), F.col("joules") / 3600
    out = energy.crossJoin(dimension(satellites)).withColumn("available_wh", available).withColumn("max_images", F.coalesce(F.floor(F.try_divide(available, each)), F.lit(0)))
    return out.withColumn("utilisation_pct", F.coalesce(F.try_divide(images * each, available) * 100, F.lit(0.0))).withColumn("feasible", F.col("max_images") >= 1)


def downlink(runs: DataFrame, links: DataFrame, result_kb: Column, extra_kb: float = 55.0) -> DataFrame:
    per_s, window_s = F.col("mbps") / 8, F.col("window_min") * 60
    total_kb = result_kb + extra_kb
    raw, small = F.col("image_size_mb") / per_s, total_kb / 1024 / per_s
    out = runs.crossJoin(dimension(links))
    return out.select(
        *runs.columns, "link", raw.alias("raw_s"), (window_s / raw).alias("raw_per_window"), (window_s / raw * F.col("passes")).alias("raw_per_day"), small.alias("small_s"), (window_s / small * F.col("passes")).alias("small_per_day"),
        (F.col("image_size_mb") * 1024 / total_kb).alias("ratio"), ((1 - total_kb / (F.col("image_size_mb") * 1024)) * 100).alias("saving_pct"), (raw / small).alias("multiplier"),
    )


def latency_scenarios(runs: DataFrame, orbits: DataFrame, links: DataFrame, chains: DataFrame, result_kb: Column) -> DataFrame:
    """Seconds from capture to user with and without processing on board."""
    wait = F.col("period_min") * 60 / 4
    per_s = F.col("mbps") / 8
    without = wait + F.col("image_size_mb") / per_s + (F.col("ingest_min") + F.col("processing_min") + F.col("dissemination_min")) * 60
    with_ = F.col("inference_ms") / 1000 + wait + result_kb / 1024 / per_s + 120
    out = runs.crossJoin(dimension(orbits)).crossJoin(dimension(links)).crossJoin(dimension(chains))
    return out.withColumn("without_s", without).withColumn("with_s", with_).withColumn("speed_up", without / with_).withColumn("saved_s", without - with_)


def actionability(km: Column) -> Column:
    return F.when(km < 10, "high").when(km < 50, "medium").otherwise("low")


def moved_km(latency_s: Column, knots: float = 20.0) -> Column:
    return latency_s / 3600 * knots * 1.852


def select_model(requests: DataFrame, models: DataFrame, reserve_pct: float = 20.0) -> DataFrame:
    """For each request (req_id, ram_mb, energy_wh, battery_wh, priority) the best model (name, size_mb) that fits: the
    fastest if urgent, the largest if high, else the best size for its energy; a signal-processing fallback; or none."""
    m = models.select("name", "size_mb", (F.col("size_mb") * 0.00005).alias("model_wh"), (F.col("size_mb") * 5.0).alias("model_ms"))
    able = requests.where(F.col("energy_wh") / F.col("battery_wh") * 100 >= reserve_pct)
    fits = able.join(dimension(m), (F.col("size_mb") * 3 <= F.col("ram_mb")) & (F.col("model_wh") <= F.col("energy_wh")))
    key = F.when(F.col("priority") >= 2, -F.col("model_ms")).when(F.col("priority") == 1, F.col("size_mb")).otherwise(F.round(F.col("size_mb") / F.col("model_wh"), 3))
    best = fits.groupBy("req_id").agg(F.max_by(F.struct("name", "model_wh"), F.struct(key, F.col("name"))).alias("best"))
    out = requests.join(best, "req_id", "left")
    reserve = F.col("energy_wh") / F.col("battery_wh") * 100 >= reserve_pct
    action = F.when(~reserve, "skip").when(F.col("best").isNotNull(), "process").when(F.col("energy_wh") >= 0.00001, "fallback_cfar").otherwise("skip")
    return out.select("req_id", action.alias("action"), F.when(action == "process", F.col("best.name")).when(action == "fallback_cfar", "cfar").alias("model"))


def budget_verdict(profiles: DataFrame, runs: DataFrame) -> DataFrame:
    stats = runs.groupBy(F.col("constraint_profile").alias("profile")).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("ok"), F.max("peak_ram_mb").alias("ram"), F.avg("cpu_usage_pct").alias("cpu"))
    text = F.when(F.coalesce("runs", F.lit(0)) == 0, "NO DATA").when(F.col("ok") == 0, "FAIL_RUN").when(F.col("ram") > F.col("memory_mb"), "FAIL_RAM").when(F.col("cpu") > F.col("cpu_limit") * 100, "WARN_CPU").otherwise("PASS")
    return profiles.join(stats, "profile", "left").select("profile", F.coalesce("runs", F.lit(0)).alias("runs"), text.alias("verdict"))


def normalize_technique(runs: DataFrame) -> DataFrame:
    """One spelling for dynamic quantisation."""
    return runs.withColumn("compression_technique", F.when(F.col("compression_technique") == "int8_dynamic", "dynamic_int8").otherwise(F.col("compression_technique")))


def clear_reaped_errors(runs: DataFrame) -> DataFrame:
    """A run that succeeded after it was reaped keeps no note of that."""
    reaped = (F.col("status") == "success") & F.coalesce(F.col("error_message").ilike("reaped:%"), F.lit(False))
    return runs.withColumn("error_message", F.when(~reaped, F.col("error_message")))


def scene_modes(observations: DataFrame) -> DataFrame:
    """Mean incidence angle of each scene, and its different polarisations in order, joined by a plus sign."""
    modes = F.array_join(F.array_sort(F.collect_set("polarisation")), "+").alias("polarisations")
    return observations.groupBy("scene_id").agg(F.avg("incidence").alias("incidence_mean"), modes)
