"""Zone tips, cooldown and the queue of cues. States are snapshots: old tables in, new tables out; `now` is a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fixpoint import cut
from .relations import points_in_zones


def eligible(dets: DataFrame, min_conf: float = 0.7) -> DataFrame:
    return dets.where(~F.col("on_land") & ~F.col("cluster_anomaly") & F.coalesce(F.col("source").isin("yolo", "fused"), F.lit(True)) & (F.col("confidence") >= min_conf))


def tips(dets: DataFrame, zones: DataFrame, min_conf: float = 0.7, least: int = 2, margin: float = 0.05) -> DataFrame:
    """A tip for each run and zone with enough eligible detections; `tip_detections` has their ids."""
    held = points_in_zones(eligible(dets, min_conf), zones)
    out = held.groupBy("execution_id", "zone_id").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("conf"), F.max("priority").alias("zone_priority"), F.min("created_at").alias("created_at"),
        (F.min("longitude") - margin).alias("lon_min"), (F.min("latitude") - margin).alias("lat_min"), (F.max("longitude") + margin).alias("lon_max"), (F.max("latitude") + margin).alias("lat_max"),
    ).where(F.col("n") >= least)
    raised = F.when((F.col("n") >= 5) & (F.col("conf") >= 0.85), 2).when((F.col("n") >= 3) | (F.col("conf") >= 0.8), 1).otherwise(0)
    name = F.concat(F.when(F.col("conf") >= 0.85, "high_confidence").otherwise("moderate_confidence"), F.lit("_in_"), F.col("zone_id"), F.when(F.col("n") >= 5, "_cluster_detected").otherwise(""))
    return out.withColumn("priority", F.least(F.lit(2), F.greatest("zone_priority", raised))).withColumn("reason", name)


def tip_detections(dets: DataFrame, zones: DataFrame, min_conf: float = 0.7, least: int = 2) -> DataFrame:
    """(execution_id, zone_id, det_id): the detections behind each tip, as rows, however many a crowded zone has."""
    held = points_in_zones(eligible(dets, min_conf), zones).select("execution_id", "zone_id", "det_id")
    enough = held.groupBy("execution_id", "zone_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    return held.join(enough, ["execution_id", "zone_id"], "left_semi")


def cooldown(events: DataFrame, key: str, minutes: int, id_: str = "id", at: str = "created_at", fold_rows: int = 5_000_000) -> DataFrame:
    """Of each key's events in order of time those at least `minutes` after the last one kept; of one instant the least id.
    Events without a key are a key of their own.

    Keys with up to `fold_rows` instants are read in order of time by one task each, which keeps one instant in memory. Where
    a key has more, which would take one task long, every event points to the first one that is late enough after it, and the
    pointers are followed from each key's first event in rounds that double the steps, so no task reads a key."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    firsts = cut(events.groupBy(F.col(key).alias("_key"), micros.alias("_t")).agg(F.min(id_).alias("_id")))
    most = firsts.groupBy("_key").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    kept = (_folded if most <= fold_rows else _followed)(firsts, minutes * 60_000_000)
    return kept.select(F.col("_id").alias(id_), F.col("_key").alias(key))


def _folded(firsts: DataFrame, gap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, due = None, None  # the key being read, and the first instant that it may keep
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            t, kept = batch.column(1).to_numpy(), []
            edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                name = batch.column(0)[a].as_py()
                if due is None or name != now:
                    now, due = name, t[a]
                i = a + int(np.searchsorted(t[a:b], due))
                while i < b:
                    kept.append(i)
                    due = t[i] + gap
                    i += int(np.searchsorted(t[i:b], due))
            yield batch.select(["_key", "_id"]).take(pa.array(kept, pa.int64()))

    return firsts.repartition("_key").sortWithinPartitions("_key", "_t").select("_key", "_t", "_id").mapInArrow(run, firsts.select("_key", "_id").schema)


def _followed(firsts: DataFrame, gap: int) -> DataFrame:
    firsts = firsts.withColumn("_key", F.struct("_key"))  # in a struct, a key that is null meets itself in joins
    # the first event at or after t + gap is in the slice of time of t + gap, or the first of the next slice that has any
    cell = lambda t: F.floor(t / gap)
    slices = firsts.groupBy("_key", cell(F.col("_t")).alias("_slice")).agg(F.min("_t").alias("_first"))
    later = slices.withColumn("_later", F.lead("_first").over(Window.partitionBy("_key").orderBy("_slice"))).select("_key", "_slice", "_later")
    asked = firsts.select("_key", cell(F.col("_t") + gap).alias("_slice"), (F.col("_t") + gap).alias("_x"), F.col("_t").alias("_from"), F.lit(None).cast("long").alias("_to"))
    given = firsts.select("_key", cell(F.col("_t")).alias("_slice"), F.col("_t").alias("_x"), F.lit(None).cast("long").alias("_from"), F.col("_t").alias("_to"))
    ahead = Window.partitionBy("_key", "_slice").orderBy(F.col("_x").desc(), F.col("_from").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    inside = asked.unionByName(given).withColumn("_next", F.min("_to").over(ahead)).where("_from is not null").select("_key", "_slice", "_from", "_next")
    # of an empty slice the next one that is not: the last slice before it knows
    open_ = inside.where("_next is null").select("_key", "_slice").distinct().withColumn("_asked", F.lit(True))
    known = later.withColumn("_asked", F.lit(False)).unionByName(open_.withColumn("_later", F.lit(None).cast("long")).select("_key", "_slice", "_later", "_asked"))
    order = Window.partitionBy("_key").orderBy("_slice", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    filled = known.withColumn("_fill", F.last(F.when(~F.col("_asked"), F.struct("_later")), ignorenulls=True).over(order)["_later"]).where("_asked").select("_key", "_slice", "_fill")
    jumps = inside.join(filled, ["_key", "_slice"], "left").select("_key", F.col("_from").alias("_t"), F.coalesce("_next", "_fill").alias("_next")).where("_next is not null")
    jumps = cut(jumps)
    reached = cut(firsts.groupBy("_key").agg(F.min("_t").alias("_t")))
    while not jumps.isEmpty():
        reached = cut(reached.unionByName(reached.join(jumps, ["_key", "_t"]).select("_key", F.col("_next").alias("_t"))).distinct())
        hop = jumps.select("_key", F.col("_t").alias("_next"), F.col("_next").alias("_far"))
        jumps = cut(jumps.join(hop, ["_key", "_next"]).select("_key", "_t", F.col("_far").alias("_next")))
    return firsts.join(reached, ["_key", "_t"], "left_semi").select("_key._key", "_id")


def resolve_search_zone(cues: DataFrame, zones: DataFrame, default: str = "gibraltar") -> DataFrame:
    """Adds the search zone of each cue's target zone: the zone's own, the default where it has none or the cue names no
    zone, and the name itself where no zone has it. zones: (zone_id, search_zone)."""
    named = zones.select(F.col("zone_id").alias("_zone"), F.coalesce("search_zone", F.lit(default)).alias("_search"))
    no_name = F.coalesce("target_zone", F.lit("")) == ""
    out = cues.join(named, cues["target_zone"] == named["_zone"], "left")
    return out.withColumn("search_zone", F.when(no_name, default).otherwise(F.coalesce("_search", "target_zone"))).drop("_zone", "_search")


def replays(cues: DataFrame, limit: int = 50) -> DataFrame:
    """The latest cues with how many detections raised each (triggering_detections: an array of ids)."""
    out = cues.select("id", "created_at", "status", "target_zone", "priority", "triggered_by", "execution_id", F.size("triggering_detections").alias("triggering_count"))
    return out.orderBy(F.desc("created_at"), "id").limit(limit)


def reset_mapping_failures(cues: DataFrame, zones: tuple[str, ...]) -> DataFrame:
    """Failed and pending cues of these zones whose last error says that the search zone was unknown start afresh."""
    again = F.col("status").isin("failed", "pending") & F.col("target_zone").isin(*zones) & F.coalesce(F.col("last_error").ilike("Unknown search zone%"), F.lit(False))
    fresh = {"status": F.lit("pending"), "attempts": F.lit(0), **{c: F.lit(None) for c in ("execution_id", "cooldown_until", "last_error")}}
    kinds = dict(cues.dtypes)
    return cues.withColumns({c: F.when(again, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in fresh.items() if c in kinds})


def admit_cues(new: DataFrame, queue: DataFrame, minutes: int = 60) -> DataFrame:
    """New cues whose zone has no open cue within the cooldown before them.

    Time is cut into slots as long as the cooldown: an open cue that bars a new one is in the new one's slot, where any
    earlier one does, so the first decides, or in the slot before, where the last one decides. Each zone and slot has one row."""
    if minutes <= 0:
        return new
    width, at = minutes * 60_000_000, F.col("created_at")

    def slot(df: DataFrame) -> Column:
        # a time without a zone as it stands on the clock, whatever the session's zone
        instant = F.concat(at.cast("string"), F.lit("Z")) if dict(df.dtypes)["created_at"] == "timestamp_ntz" else at
        micros = F.unix_micros(instant.cast("timestamp"))
        return micros - F.pmod(micros, F.lit(width))

    open_ = queue.where("status in ('pending', 'processing')").select(F.col("target_zone").alias("_zone"), slot(queue).alias("_slot"), at.alias("_at"))
    ends = open_.groupBy("_zone", "_slot").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    # a slot's first serves the slot itself, its last the next one
    both = ends.select("_zone", "_slot", "_first").unionByName(ends.select("_zone", (F.col("_slot") + width).alias("_slot"), F.col("_last").alias("_before")), allowMissingColumns=True)
    ends = both.groupBy("_zone", "_slot").agg(F.max("_first").alias("_first"), F.max("_before").alias("_before"))
    barred = (at > F.col("_first")) | (at < F.col("_before") + F.make_dt_interval(mins=F.lit(minutes)))
    same = (F.col("target_zone") == F.col("_zone")) & (F.col("_new_slot") == F.col("_slot"))
    return new.withColumn("_new_slot", slot(new)).join(ends, same & barred, "left_anti").drop("_new_slot")


def finish_cues(queue: DataFrame, outcomes: DataFrame, now: str, retry_minutes: int = 15) -> DataFrame:
    """outcomes: (id, ok). Done cues are completed; failed ones wait and try again until their attempts are spent."""
    out = queue.join(outcomes.select("id", "ok"), "id", "left")
    spent = F.col("attempts") >= F.col("max_attempts")
    status = F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "completed").when(spent, "failed").otherwise("pending")
    later = F.lit(now).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(retry_minutes))
    return out.withColumn("status", status).withColumn("cooldown_until", F.when(~F.col("ok") & ~spent, later)).drop("ok")


def reap_orphans(runs: DataFrame, now: str, minutes: int) -> DataFrame:
    """Runs that have been pending or running for more than `minutes` fail, with a note."""
    stuck = F.col("status").isin("pending", "running") & (F.col("created_at") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(minutes)))
    note = F.concat(F.lit("reaped: stuck in "), F.col("status"), F.lit(f" for >{minutes} minutes"))
    old = F.nullif(F.col("error_message"), F.lit(""))
    return runs.withColumn("error_message", F.when(stuck, F.concat_ws(" | ", old, note)).otherwise(F.col("error_message"))).withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def replay_chain(cues: DataFrame, runs: DataFrame, dets: DataFrame, k: int = 12) -> DataFrame:
    """Each answered cue with the run before and after it, the gap in seconds, and the uplift of the mean confidence of the
    best k detections."""
    from .runs import top_per_group

    best = top_per_group(dets.select("execution_id", "det_id", "confidence"), "execution_id", k, F.desc("confidence"), F.col("det_id"))
    mean = best.groupBy(F.col("execution_id").alias("run")).agg(F.avg("confidence").alias("conf"))
    r = runs.select(F.col("id").alias("run"), F.col("created_at").alias("at")).join(mean, "run", "left")
    t0 = r.select(F.col("run").alias("triggered_by"), F.col("at").alias("at0"), F.col("conf").alias("conf0"))
    t1 = r.select(F.col("run").alias("execution_id"), F.col("at").alias("at1"), F.col("conf").alias("conf1"))
    out = cues.where("execution_id is not null").select("id", "target_zone", "triggered_by", "execution_id").join(t0, "triggered_by").join(t1, "execution_id")
    seconds = (F.unix_micros(F.col("at1").cast("timestamp")) - F.unix_micros(F.col("at0").cast("timestamp"))) / 1e6
    return out.withColumn("gap_s", seconds).withColumn("uplift", F.col("conf1") - F.col("conf0"))


def replay_record(cues: DataFrame, runs: DataFrame, dets: DataFrame, k: int = 12) -> DataFrame:
    """The whole record of each cue (id, triggered_by, triggering, execution_id, ...): both runs' times, its triggering
    detections (the ids in the array `triggering`) and the best k of the run that answered it, as arrays of (confidence, det_id)
    with higher confidence, then lower id first, their mean confidences to four decimals and the uplift; what is missing is
    null, a list empty.

    Only detections that a cue names or whose run a cue names are ranked. Arrays hold what the cue lists, or k. Cues without an
    answer, which most may be, have no key to meet by and are dealt by their ids."""
    from .runs import top_per_group

    both = lambda conf, det: F.struct((-F.col(conf)).alias("c"), F.col(det).alias("i"))
    listed = lambda found: F.transform(F.sort_array(found), lambda s: F.struct((-s["c"]).alias("confidence"), s["i"].alias("det_id")))
    slim = dets.select("det_id", "execution_id", "confidence")
    named = cues.select("id", F.explode("triggering").alias("det_id")).distinct()
    first = named.join(slim, "det_id").groupBy("id").agg(listed(F.collect_list(both("confidence", "det_id"))).alias("triggering_detections"), F.avg("confidence").alias("_t0"))
    answered = cues.where("execution_id is not null").select("execution_id").distinct()
    best = top_per_group(slim.join(answered, "execution_id", "left_semi"), "execution_id", k, F.desc("confidence"), F.col("det_id"))
    last = best.groupBy("execution_id").agg(listed(F.collect_list(both("confidence", "det_id"))).alias("confirming_detections"), F.avg("confidence").alias("_t1"))
    at = lambda run, name: runs.select(F.col("id").alias(run), F.col("created_at").alias(name))
    out = cues.join(first, "id", "left")
    for key, found in (("triggered_by", at("triggered_by", "t0_at")), ("execution_id", last.join(at("execution_id", "t1_at"), "execution_id", "full_outer"))):
        deal = F.when(F.col(key).isNull(), F.xxhash64("id")).otherwise(F.xxhash64(key))
        out = out.withColumn("_deal", deal).join(found.withColumn("_deal", F.xxhash64(key)), [key, "_deal"], "left").drop("_deal")
    none = F.expr("cast(array() as array<struct<confidence: double, det_id: bigint>>)")
    gap = lambda a, b: (F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp"))) / 1e6
    known = F.col("_t0").isNotNull() & F.col("_t1").isNotNull()
    return out.select(
        *cues.columns, "t0_at", "t1_at", gap("created_at", "t0_at").alias("t0_to_cue_s"), gap("t1_at", "t0_at").alias("t0_to_t1_s"),
        *[F.coalesce(c, none).alias(c) for c in ("triggering_detections", "confirming_detections")],
        *[F.when(known, F.round(x, 4)).alias(n) for n, x in (("avg_confidence_t0", F.col("_t0")), ("avg_confidence_t1", F.col("_t1")), ("confidence_uplift", F.col("_t1") - F.col("_t0")))],
    )
