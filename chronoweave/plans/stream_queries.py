"""Registered queries: events replayed as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.columns import rounded
from chronoweave.plans.tables import table
from chronoweave.plans.tracking_queries import ORACLES as TRACKING
from chronoweave.streaming.online import closed, drain, sliding_stats_stream, slew_limited_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def event_stream(spark: SparkSession, sf_dir: str, key: str, beyond_s: float) -> tuple[DataFrame, Callable[[], None]]:
    """The files of the events as a stream, and its end."""
    schema = table(spark, sf_dir, "events").schema
    stream, end = closed(spark, f"{sf_dir.rstrip('/')}/events.parquet", schema, key, "ts", beyond_s)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")), end


@register("stream_slew_limit", TRACKING["slew_limit"])
def stream_slew_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same rows as the batch slew limit."""
    stream, end = event_stream(spark, sf_dir, "user_id", 3600.0)
    reading = F.when(F.col("event_type") != "error", F.col("value")).alias("reading")
    done = drain(slew_limited_stream(stream.select("user_id", "ts", "event_id", reading, "end"), "user_id", "ts", "event_id", "reading", lateness_s=40 * 86400.0), "stream-slew", end)
    return done.where("NOT late").select("user_id", "event_id", rounded(F.col("limited")).alias("limited"))


@register(
    "stream_window_stats",
    """WITH w AS (SELECT event_type, time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR * o AS start, value
      FROM events, unnest(generate_series(0, 3)) g(o))
    SELECT event_type, epoch(start)::BIGINT AS start_s, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n
    FROM w GROUP BY event_type, start""",
)
def stream_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 8 hours every 2 hours, all of them: the stream's end closes the last."""
    stream, end = event_stream(spark, sf_dir, "event_type", 42 * 86400.0)
    done = drain(sliding_stats_stream(stream.select("event_type", "ts", "value"), ["event_type"], "ts", "value", "8 hours", "2 hours", "40 days"), "stream-windows", end)
    return done.select(
        "event_type", F.unix_seconds("start").alias("start_s"), rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"), "n"
    )
