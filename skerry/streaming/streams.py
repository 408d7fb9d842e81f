"""Structured Streaming forms of counters, gauges, cooldown, orphan detection and sessions.

A transformation takes a streaming (or, where Spark allows it, a batch) DataFrame of events (event_id, ts, user_id,
event_type, value) and returns one. `finished` runs a stream over all files there are and returns its result as a table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skerry.operators.fixpoint import folder

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return timed(reader.parquet(f"{path[:-1]}[{path[-1]}]"))  # as a pattern it may be a folder or one file


def timed(events: DataFrame) -> DataFrame:
    """Event time as an instant, for watermarks."""
    return events.withColumn("at", F.col("ts").cast("timestamp"))


def finished(df: DataFrame, mode: str = "append", report: dict[str, int] | None = None) -> DataFrame:
    """The result after all files: appended rows, or the last full state. `report` gets the number of batches, and of rows
    that came behind the watermark and were dropped (`late_rows`), from the query's progress."""
    spark = df.sparkSession
    path = folder(spark)
    writer = df.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/out").start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")).start()
    query.awaitTermination()
    if report is not None:
        steps = [json.loads(p.json) for p in query.recentProgress]
        report |= {"batches": len(steps), "late_rows": sum(s["numRowsDroppedByWatermark"] for p in steps for s in p["stateOperators"])}
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def runs_per_status(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    w = F.window("at", width, slide) if slide else F.window("at", width)
    counts = events.withWatermark("at", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def value_histogram(events: DataFrame, edges: tuple[float, ...] = (1, 5, 10, 50), late: str = "2 hours") -> DataFrame:
    bucket = F.lit(float("inf"))
    for e in reversed(edges):
        bucket = F.when(F.col("value") <= e, F.lit(float(e))).otherwise(bucket)
    counts = events.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), bucket.alias("le")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "le", "n")


def last_value(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))


def cooled(events: DataFrame, key: str, minutes: int, late: str = "1 day") -> DataFrame:
    """The events that come at least `minutes` after the last one kept of their key; events later than `late` are dropped.

    The state is one time for each key. It goes once the watermark is `minutes` past it, as any event to come is then kept."""
    gap = pd.Timedelta(minutes=minutes)

    def step(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        times, ids = rows["ts"], rows["event_id"].tolist()
        kept, k = [], 0 if last is None else int(times.searchsorted(last + gap))
        while k < len(ids):  # from one kept event to the next, whatever lies between
            last = times.iloc[k]
            kept.append(ids[k])
            k = max(k + 1, int(times.searchsorted(last + gap)))
        state.update((int(last.value // 1000),))
        over = -(-int((last + gap).value) // 1_000_000)
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key_[0]] * len(kept), "event_id": kept})

    keyed = events.withWatermark("at", late).withColumn("key", F.col(key))
    return keyed.groupBy("key").applyInPandasWithState(step, "key long, event_id long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def orphans(events: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """(run, verdict): `reaped` once event time is `minutes` past a start (`view`) without an end (`purchase`), and
    `recovered` if the end comes after all."""
    wait = minutes * 60_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            started, reaped = state.get
            if not reaped:
                out.append("reaped")
                state.update((started, True))
        else:
            rows = pd.concat(list(batches)).sort_values("ts")
            started, reaped = state.get if state.exists else (None, False)
            for at, kind in zip(rows["ts"], rows["event_type"], strict=True):
                if kind == "view":
                    started, reaped = int(at.value // 1_000_000), False
                elif kind == "purchase" and started is not None:
                    if reaped:
                        out.append("recovered")
                    started, reaped = None, False
            if started is None:
                if state.exists:
                    state.remove()
            else:
                state.update((started, reaped))
                if not reaped:
                    state.setTimeoutTimestamp(max(started + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"run": [key[0]] * len(out), "verdict": out})

    timed_ = events.where("event_type in ('view', 'purchase')").withWatermark("at", late).withColumn("run", F.col("user_id"))
    return timed_.groupBy("run").applyInPandasWithState(step, "run long, verdict string", "started long, reaped boolean", "append", GroupStateTimeout.EventTimeTimeout)


def once(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Events without the doubles that a second replica sends within the lateness."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    out = events.withWatermark("at", late).groupBy(F.col(key), F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


#: A part of a group: rows k_n and k_c with a count and a confidence, their means and sums of squared deviations. A part with
#: a time is one row that may still be among the last ones.
_PART = "model_name string, created_at timestamp_ntz, id long, k_n long, mean_n double, m2_n double, k_c long, mean_c double, m2_c double"
_VERDICT = "model_name string, metric string, z_score double, is_drifting boolean, recommendation string"


def merged(parts: pd.DataFrame, x: str) -> tuple[int, float, float]:
    """Count, mean and sum of squared deviations of parts together."""
    k = parts[f"k_{x}"].to_numpy()
    n = int(k.sum())
    if not n:
        return 0, 0.0, 0.0
    of = k > 0
    k, mean = k[of], parts[f"mean_{x}"].to_numpy()[of]
    middle = float((k * mean).sum() / n)
    return n, middle, float(parts[f"m2_{x}"].to_numpy()[of].sum() + (k * (mean - middle) ** 2).sum())


def condensed(parts: pd.DataFrame, n: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The last n timed rows of one group, by time and id, and one part for all others. Rows that share the n-th place all
    stay, as in `runs.drift_zscore`."""
    timed_ = parts[parts["created_at"].notna()].sort_values(["created_at", "id"])
    if len(timed_) > n:
        nth = timed_.iloc[-n]
        late = (timed_["created_at"] > nth["created_at"]) | (timed_["created_at"] == nth["created_at"]) & (timed_["id"] >= nth["id"])
        last, past = timed_[late], timed_[~late]
    else:
        last, past = timed_, timed_.iloc[:0]
    past = pd.concat([parts[parts["created_at"].isna()], past])
    whole = {"model_name": parts["model_name"].iloc[0], "created_at": pd.NaT, "id": 0}
    for x in ("n", "c"):
        whole[f"k_{x}"], whole[f"mean_{x}"], whole[f"m2_{x}"] = merged(past, x)
    return last, pd.DataFrame([whole | {"id": len(past[past["created_at"].notna()]) + int(past[past["created_at"].isna()]["id"].sum())}])


def drift_parts(runs: DataFrame, n: int) -> DataFrame:
    """Each batch of rows of a task as parts, so that no more than n rows and one part of it are shuffled for each group."""

    def condense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for _, own in rows.groupby("model_name", sort=False):
                last, past = condensed(own, n)
                yield last
                if past["id"].iloc[0]:
                    yield past

    number = lambda c: (F.col(c).isNotNull().cast("long"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    cells = [F.col("model_name"), F.col("created_at"), F.col("id"), *number("num_detections"), *number("avg_confidence")]
    names = [f.split()[0] for f in _PART.split(", ")]
    # a row without a time or group has no place in the order
    rows = runs.where("model_name is not null and created_at is not null and id is not null").select(*[c.alias(k) for c, k in zip(cells, names, strict=True)])
    return rows.mapInPandas(condense, _PART)


class Drift(StatefulProcessor):
    """The state of a group: the last n rows, and one mergeable part for all rows before them. Its size does not depend on how
    many rows or batches there were."""

    def __init__(self, n: int, threshold: float):
        self.n, self.threshold = n, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = _PART.removeprefix("model_name string, ")
        self.last, self.past = handle.getListState("last", row), handle.getValueState("past", row)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [f.split()[0] for f in _PART.split(", ")]
        held = [tuple(r) for r in self.last.get()]
        if self.past.exists():
            held.append(tuple(self.past.get()))
        parts = pd.DataFrame([(key[0], *r) for r in held], columns=names) if held else None
        for batch in rows:
            parts = pd.concat(condensed(batch if parts is None else pd.concat([parts, batch]), self.n))
        last, past = condensed(parts, self.n)
        rest = names[1:]
        plain = lambda r: tuple(None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v for v in r)
        self.last.put([plain(r) for r in last[rest].itertuples(index=False)])
        self.past.update(plain(next(past[rest].itertuples(index=False))))
        if len(last) + past["id"].iloc[0] >= self.n + 5:
            yield self.verdict(key[0], last, past)

    def verdict(self, name: str, last: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        def z(x: str) -> float | None:
            (k, recent, _), (m, before, m2) = merged(last, x), merged(past, x)
            if not k or not m:
                return None
            apart, deviation = abs(recent - before), (m2 / m) ** 0.5
            return apart / deviation if deviation else 0.0 if not apart else float("inf")

        z_n, z_c = z("n"), z("c") if past["k_c"].iloc[0] >= 3 else 0.0
        by_confidence = not (z_n is not None and z_n > self.threshold) and z_c is not None and z_c > self.threshold
        score = z_c if by_confidence else z_n
        over = None if score is None else score / self.threshold
        advice = "continue" if over is None or over <= 1 else "recalibrate" if over <= 1.5 else "switch_model" if over <= 2 else "alert_ground"
        return pd.DataFrame({"model_name": [name], "metric": ["avg_confidence" if by_confidence else "num_detections"], "z_score": [score], "is_drifting": [None if over is None else over > 1], "recommendation": [advice]})


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def rolling_drift(runs: DataFrame, n: int = 20, threshold: float = 2.5) -> DataFrame:
    """The drift test after each batch, for the groups that got rows: `runs.drift_zscore` over all rows so far, from state
    alone. runs: (model_name, created_at, id, num_detections, avg_confidence), in any order."""
    parts = drift_parts(runs, n)
    return parts.groupBy("model_name").transformWithStateInPandas(Drift(n, threshold), T.StructType.fromDDL(_VERDICT), "Update", "None")


def as_runs(events: DataFrame) -> DataFrame:
    """Events as runs of a model."""
    return events.select(F.col("event_type").alias("model_name"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"), F.col("value").alias("num_detections"), (F.col("value") / 100).alias("avg_confidence"))


def latest(df: DataFrame, key: str) -> DataFrame:
    """The last row of each key of a stream in update mode, with the RocksDB store that arbitrary state needs."""
    spark = df.sparkSession
    path = folder(spark)
    before = spark.conf.get(_PROVIDER)

    def batch(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/part={number}")

    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = df.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("update").foreachBatch(batch).start()
    finally:
        spark.conf.set(_PROVIDER, before)
    query.awaitTermination()
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{path}/out/part=*")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), "batch").alias("_r")).select(key, "_r.*")
