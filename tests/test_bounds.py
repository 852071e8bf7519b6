"""What Python workers hold is bounded: windows at a time, workers a task."""

from __future__ import annotations

import numpy as np
import pandas as pd

from chronoweave.functions.arrays import by_length
from chronoweave.operators import windows
from chronoweave.operators.delay import filter_design


def test_a_batch_is_worked_off_in_bounded_parts():
    column = pd.Series([np.full(4 + n % 2, float(n)) for n in range(1000)])
    sizes = []

    def fn(at):
        sizes.append(len(at))
        return [(n, len(column.iloc[n])) for n in at]

    assert by_length(column, fn, 128) == [(n, 4 + n % 2) for n in range(1000)]
    assert max(sizes) == 128


def test_spectra_of_a_batch_are_made_in_parts(monkeypatch):
    seen = []
    plain = windows.spectra.peak_candidates
    monkeypatch.setattr(windows.spectra, "peak_candidates", lambda x, *a: seen.append(len(x)) or plain(x, *a))
    monkeypatch.setattr(windows, "pandas_udf", lambda _: lambda fn: fn)
    rng = np.random.default_rng(1)
    found = windows.peak_list(pd.Series(list(rng.normal(size=(500, 8)))), 4.0, 0.4, 2.0, 0.3)
    assert len(found) == 500 and max(seen) <= windows.SPECTRA_AT_ONCE


def test_a_cascade_takes_one_worker_for_all_its_stages(spark):
    names = ["ppg_green", *[c for g in windows.GROUPS.values() for c in g]]
    rng = np.random.default_rng(2)
    rows = [(n, *[[float(v) for v in rng.normal(size=16)] for _ in names]) for n in range(5)]
    frame = spark.createDataFrame(rows, f"win long, {', '.join(f'{c} array<double>' for c in names)}")
    found = frame.withColumn("delays", windows.window_delays("ppg_green", names[1:], 16.0))
    done = windows.cascade(found, "ppg_green", "HF2_ACC3", "lms", "delays", filter_design)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # the delays, then the chain
    got = done.collect()
    assert [len(r.stages) for r in got] == [5] * 5 and all(np.isfinite(r.filtered).all() for r in got)


def test_filters_get_a_bounded_number_of_windows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(windows, "pandas_udf", lambda _: lambda fn: lambda *_: fn)
    monkeypatch.setattr(windows.adaptive, "adapt", lambda kind, u, d, *_: seen.append(len(u)) or d)
    run = windows.adaptive_filter("u", "d", "rff_lms", 2, 1, 0.01)
    x, ones = pd.Series(list(np.ones((5000, 4)))), pd.Series(np.ones(5000))
    assert len(run(x, x, ones, ones, ones)) == 5000 and max(seen) <= 2048
