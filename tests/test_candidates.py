"""Candidates of a user's day: one result for any order of the rows, missing values last."""

from __future__ import annotations

import datetime as dt

import duckdb

from chronoweave.functions.columns import steady_mean
from chronoweave.plans.array_queries import ORACLES, near_biggest
from tools.check import compare

ROWS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DAY = dt.datetime(2024, 1, 5, 12)
# One candidate lies exactly 10 below the mean; plain sums put it on either side, by their order.
ORDERS = [(89.9, 130.32, 157.74, 18.77, 5.67, 197.0), (89.9, 130.32, 157.74, 18.77, 197.0, 5.67)]


def events(spark, folder, values):
    rows = [(n, DAY, 1, "click", v, "{}") for n, v in enumerate(values)]
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_order_of_rows_does_not_choose_the_place(spark, tmp_path):
    found = {near_biggest(spark, events(spark, tmp_path / str(n), order)).collect()[0].place for n, order in enumerate(ORDERS)}
    assert len(found) == 1


def test_missing_values_are_no_strongest_candidates(spark, tmp_path):
    folder = events(spark, tmp_path, [None, 20.0, 30.0, None, 29.0, 1.0, 2.0, 28.0])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    assert compare(near_biggest(spark, folder).toPandas(), con.execute(ORACLES["near_biggest"]).df()) == ""


def test_steady_mean_of_numbers_that_no_decimal_holds(spark):
    rows = [("big", 1e300), ("big", 3e300), ("small", 1e-30), ("small", 3e-30), ("plain", 0.1), ("plain", 0.2), ("none", None)]
    got = dict(map(tuple, spark.createDataFrame(rows, "g string, x double").groupBy("g").agg(steady_mean("x")).collect()))
    assert got == {"big": 2e300, "small": 2e-30, "plain": 0.15, "none": None}
