"""Online forms of the ordered operators for Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoweave.operators.tracking import limit_step
from chronoweave.storage import new_path


def slew_limited_stream(
    stream: DataFrame, key: str, time: str, row_id: str, value: str, limit: float = 6.0, step: float = 4.0, lateness_s: float = 3600.0, end: str = "end"
) -> DataFrame:
    """Slew-limited values in event-time order: ``key, row_id, time, limited, late``.

    The state of a recording holds its last value and the rows younger than its newest one less
    ``lateness_s``: they wait until no earlier row can come, whatever the order of files and triggers.  A
    row that comes after its place was passed leaves at once with ``late`` and no value.  A row with the
    flag ``end`` (see ``closed``) lets out all that waits.
    """
    schema = T.StructType([stream.schema[key], stream.schema[row_id], stream.schema[time]]).add("limited", "double").add("late", "boolean")
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = stream.withColumn("_t", micros)

    def update(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous, passed, newest, times, ids, values = state.get if state.exists else (None, None, None, [], [], [])
        flush, t, n, v = False, [np.array(times, "int64")], [np.array(ids, "int64")], [np.array(values, float)]
        behind = []
        for part in parts:
            over, at = part[end].to_numpy(bool), part["_t"].to_numpy()
            late = ~over & (at < passed) if passed is not None else np.zeros(len(part), bool)
            flush, here = flush or bool(over.any()), ~over & ~late
            t.append(at[here].astype("int64"))
            n.append(part[row_id].to_numpy()[here].astype("int64"))
            v.append(part[value].to_numpy(float)[here])
            if late.any():
                behind.append(part[late])
        t, n, v = (np.concatenate(x) for x in (t, n, v))
        order = np.lexsort((n, t))
        t, n, v = t[order], n[order], v[order]
        if len(t):
            newest = int(t[-1]) if newest is None else max(int(t[-1]), newest)
        go = len(t) if flush or newest is None else int(np.searchsorted(t, newest - int(lateness_s * 1e6), "right"))
        out = []
        for x in v[:go].tolist():
            previous = previous if x != x else limit_step(previous, x, limit, step)
            out.append(previous)
        passed = int(t[go - 1]) if go else passed
        state.update((previous, passed, newest, t[go:].tolist(), n[go:].tolist(), [None if x != x else x for x in v[go:].tolist()]))
        limited = np.array([np.nan if y is None else y for y in out], float)
        for at, ids, values, late in ((t[:go], n[:go], limited, False), *[(p["_t"].to_numpy("int64"), p[row_id].to_numpy("int64"), np.nan, True) for p in behind]):
            if len(at):
                yield pd.DataFrame({key: group[0], row_id: ids, time: pd.DatetimeIndex(at.view("M8[us]"), tz="UTC"), "limited": values, "late": late})

    kept = "previous double, passed long, newest long, times array<long>, ids array<long>, vals array<double>"
    return rows.groupBy(key).applyInPandasWithState(update, schema, kept, "append", GroupStateTimeout.NoTimeout)


def closed(spark: SparkSession, table_path: str, schema: T.StructType, key: str, time: str, beyond_s: float, per_trigger: int = 1000) -> tuple[DataFrame, Callable[[], None]]:
    """Stream of a table's files, and what ends it: a row with flag ``end`` for every key.

    A drained source tells nobody that no more rows come.  The ending rows stand in a folder of their own
    that belongs to the same stream; written when the files are drained, ``beyond_s`` after the last row, they
    also move the watermark past every open window.
    """
    folder = new_path(spark, "ending")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    spark.createDataFrame([], schema).write.parquet(folder)
    source = lambda path: spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    # As a pattern the path may be a single file as well as a folder of parts.
    stream = source(f"{table_path[:-1]}[{table_path[-1]}]").withColumn("end", F.lit(False)).unionByName(source(folder).withColumn("end", F.lit(True)))

    def end() -> None:
        rows = spark.read.schema(schema).parquet(table_path)
        last = rows.agg(F.max(time).alias("m")).first()["m"]
        keys = rows.select(key).distinct().withColumn(time, F.lit(last) + F.make_dt_interval(secs=F.lit(float(beyond_s))))
        blank = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in (key, time) else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        if last is not None:
            keys.select(*blank).write.mode("append").parquet(folder)

    return stream, end


def sliding_stats_stream(stream: DataFrame, by: list[str], time: str, value: str, width: str, hop: str, lateness: str) -> DataFrame:
    """Mean, deviation and count of sliding event-time windows, final once the watermark has passed."""
    return (
        stream.withWatermark(time, lateness)
        .groupBy(*by, F.window(time, width, hop).alias("win"))
        .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
        .select(*by, F.col("win.start").alias("start"), "mean", "std", "n")
    )


def drain(stream: DataFrame, label: str, end: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over everything that is available now and return the written rows; ``end`` closes it (see ``closed``)."""
    spark = stream.sparkSession
    path = new_path(spark, label)

    def run() -> None:
        query = (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", f"{path}-state")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    run()
    if end is not None:
        end()
        run()
    return spark.read.schema(stream.schema).parquet(path)
