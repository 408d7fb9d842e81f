"""Streams over the events table, each against the statement for its final state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.sources import fixtures
from skerry.streaming import streams as S

from .registry import ORACLES, QUERIES


def stream(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(S.read_events(spark, f"{sf_dir}/events.parquet"))
        if oracle:
            ORACLES[f.__name__] = fixtures.oracle(oracle)
        return f

    return add


@stream("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def k1_runs_per_status(events: DataFrame) -> DataFrame:
    return S.finished(S.runs_per_status(events), "complete")


@stream("SELECT time_bucket(INTERVAL 15 MINUTE, ts) - o * INTERVAL 15 MINUTE AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1, 2, 3]) AS o) GROUP BY ALL")
def k1_sliding_runs_per_status(events: DataFrame) -> DataFrame:
    return S.finished(S.runs_per_status(events, "1 hour", "15 minutes"), "complete")


@stream("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CASE WHEN value <= 1 THEN 1 WHEN value <= 5 THEN 5 WHEN value <= 10 THEN 10 WHEN value <= 50 THEN 50 ELSE CAST('Infinity' AS DOUBLE) END AS le, count(*) AS n FROM events GROUP BY ALL")
def k2_value_histogram(events: DataFrame) -> DataFrame:
    return S.finished(S.value_histogram(events), "complete")


@stream("SELECT event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY event_type")
def k3_last_value(events: DataFrame) -> DataFrame:
    return S.finished(S.last_value(events, "event_type"), "complete")


@stream(
    """WITH RECURSIVE t AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) rk FROM events),
    w AS (SELECT user_id, event_id, rk, ts AS last, TRUE AS keep FROM t WHERE rk = 1 UNION ALL SELECT t.user_id, t.event_id, t.rk, CASE WHEN t.ts >= w.last + INTERVAL 1 DAY THEN t.ts ELSE w.last END, t.ts >= w.last + INTERVAL 1 DAY FROM w JOIN t ON t.user_id = w.user_id AND t.rk = w.rk + 1)
    SELECT user_id AS key, event_id FROM w WHERE keep"""
)
def k4_cooled_tips(events: DataFrame) -> DataFrame:
    return S.finished(S.cooled(events, "user_id", 24 * 60))


@stream(
    """WITH e AS (SELECT user_id, ts, event_type FROM events WHERE event_type IN ('view', 'purchase')), l AS (SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type FROM e GROUP BY user_id)
    SELECT user_id AS run, 'reaped' AS verdict FROM l WHERE event_type = 'view' AND ts + INTERVAL 70 MINUTE < (SELECT max(ts) FROM e)"""
)
def k5_orphans(events: DataFrame) -> DataFrame:
    """All events in one batch: what has not ended by its last event is reaped once event time is an hour past it, less ten
    minutes of lateness."""
    return S.finished(S.orphans(events, 60))


@stream("SELECT event_id, user_id FROM events")
def k6_once(events: DataFrame) -> DataFrame:
    doubled = events.withColumn("replica", F.explode(F.array(F.lit(1), F.lit(2))))
    return S.finished(S.once(doubled).select("event_id", "user_id"))


@stream(
    """WITH r AS (SELECT event_type AS model_name, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events),
    s AS (SELECT model_name, abs(avg(x) FILTER (WHERE k <= 20) - avg(x) FILTER (WHERE k > 20)) / stddev_pop(x) FILTER (WHERE k > 20) AS z FROM r GROUP BY model_name)
    SELECT model_name, round(z, 4) AS z_score, z > 0.2 AS is_drifting FROM s"""
)
def k7_rolling_drift(events: DataFrame) -> DataFrame:
    """In several batches: the state after the last one."""
    return S.latest(S.rolling_drift(S.as_runs(events), 20, 0.2), "model_name").select("model_name", F.round("z_score", 4).alias("z_score"), "is_drifting")


@stream("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def k8_sessions(events: DataFrame) -> DataFrame:
    return S.finished(S.sessions(events, "user_id"), "complete")
