"""The given tables, and the series layout of ``events`` that the ordered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.series import Layout, lay_out
from chronoweave.session import tune

_layouts: dict[tuple[str, str], Layout] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: recording ``user_id``, time ``t`` in seconds of 2024, channel ``event_type``.

    ``reading`` is the value with the ``error`` events as missing samples, ``k`` a second channel.
    """
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        "ts",
        "event_type",
        "value",
        (micros / 1e6).alias("t"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("reading"),
        F.get_json_object("props", "$.k").try_cast("double").alias("k"),
    )


def event_series(spark: SparkSession, sf_dir: str) -> Layout:
    """Layout of the events of one directory, written once per application."""
    slot = (spark.sparkContext.applicationId, sf_dir)
    if slot not in _layouts:
        rows = event_rows(spark, sf_dir)
        _layouts[slot] = lay_out(rows, ["user_id"], ["ts", "event_id"], label="events")
    return _layouts[slot]
