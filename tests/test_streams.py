"""Streams of files in any order over several triggers give the batch results."""

from __future__ import annotations

import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.operators.tracking import limit_step
from chronoweave.streaming import online
from chronoweave.streaming.online import closed, drain, sliding_stats_stream, slew_limited_stream

ROWS = "user_id long, event_id long, ts timestamp_ntz, reading double"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events():
    rng = random.Random(3)
    times = sorted(rng.randrange(86_400) for _ in range(600))
    return [(n % 4, n, START + dt.timedelta(seconds=t), None if n % 13 == 0 else rng.uniform(50, 90)) for n, t in enumerate(times)]


def files(spark, root, events, disorder_s, parts=6):
    """Parts in a time order that is wrong by up to ``disorder_s``; each part is one file."""
    rng = random.Random(9)
    moved = sorted(events, key=lambda e: (e[2] - START).total_seconds() + rng.uniform(-disorder_s, disorder_s) / 2)
    size = -(-len(moved) // parts)
    path = f"{root}/events.parquet"
    for n in range(parts):
        part = moved[n * size : (n + 1) * size]
        rng.shuffle(part)
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(path)
    return path


def plain(events):
    out = {}
    for user in {e[0] for e in events}:
        previous = None
        for _, n, _, x in sorted((e for e in events if e[0] == user), key=lambda e: (e[2], e[1])):
            previous = previous if x is None else limit_step(previous, x, 6.0, 4.0)
            out[n] = previous
    return out


def tracked(spark, path, lateness_s):
    schema = spark.read.parquet(path).schema
    stream, end = closed(spark, path, schema, "user_id", "ts", 60.0, per_trigger=1)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return drain(slew_limited_stream(stream, "user_id", "ts", "event_id", "reading", lateness_s=lateness_s), "test-slew", end).collect()


def test_a_folder_in_shuffled_triggers_gives_the_ordered_result(spark, tmp_path, events):
    rows = tracked(spark, files(spark, tmp_path, events, 7200), 3 * 7200.0)
    assert not any(r.late for r in rows) and {r.event_id: r.limited for r in rows} == plain(events) and len(rows) == len(events)


def test_late_rows_leave_by_the_side(spark, tmp_path, events):
    rows = tracked(spark, files(spark, tmp_path, events, 40_000), 60.0)
    late = {r.event_id for r in rows if r.late}
    assert 0 < len(late) < len(events) and len(rows) == len(events) and all(r.limited is None for r in rows if r.late)
    assert {r.event_id: r.limited for r in rows if not r.late} == plain([e for e in events if e[1] not in late])


def test_open_windows_close_at_the_end(spark, tmp_path, events):
    path = files(spark, tmp_path, events, 3600)
    schema = spark.read.parquet(path).schema
    stream, end = closed(spark, path, schema, "user_id", "ts", 10 * 86_400.0, per_trigger=2)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    got = drain(sliding_stats_stream(stream, ["user_id"], "ts", "reading", "2 hours", "1 hour", "1 day"), "test-windows", end)
    rows = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    want = rows.groupBy("user_id", F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("reading").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
    assert sorted(map(tuple, got.select("user_id", "start", "n").collect())) == sorted(map(tuple, want.collect()))


def test_a_group_is_advanced_without_assembling_frames(monkeypatch):
    """Most recordings of a stream are short, so what a call costs by itself is what the stream costs."""

    class Stream:
        schema = T.StructType.fromDDL("user_id long, event_id long, ts timestamp")

        def withColumn(self, *_):
            return self

        groupBy = withColumn

        def applyInPandasWithState(self, update, *_):
            return update

    class State:
        exists = False

        def update(self, value):
            self.exists, self.get = True, value

    def refused(*_, **__):
        raise AssertionError("a frame is assembled for a group")

    monkeypatch.setattr(online, "F", SimpleNamespace(unix_micros=lambda c: c, col=lambda c: SimpleNamespace(cast=lambda _: None)))
    update, state = slew_limited_stream(Stream(), "user_id", "ts", "event_id", "reading", lateness_s=5.0), State()
    part = lambda t, i, v, end: pd.DataFrame({"_t": [x * 10**6 for x in t], "event_id": i, "reading": v, "end": end})
    monkeypatch.setattr(pd, "concat", refused)
    first = list(update((1,), iter([part([3, 9], [3, 9], [70.0, 90.0], False), part([1], [1], [60.0], False)]), state))
    assert [(*r[["event_id", "limited", "late"]],) for f in first for _, r in f.iterrows()] == [(1, 60.0, False), (3, 64.0, False)]
    rest = list(update((1,), iter([part([2, 10], [2, 10], [61.0, None], False), part([99], [None], [None], True)]), state))
    got = [(r.event_id, None if r.late else r.limited, r.late) for f in rest for _, r in f.iterrows()]
    assert got == [(9, 68.0, False), (10, 68.0, False), (2, None, True)]
