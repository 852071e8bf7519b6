"""Ordered operators on many small blocks must equal plain numpy / pandas on whole recordings."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions import iir
from chronoweave.operators import delay, filtering, missing, segments, tracking
from chronoweave.operators.blocks import block_arrays, stateful_scan
from chronoweave.operators.interpolate import interpolate_at
from chronoweave.operators.series import attach, lay_out

RNG = np.random.default_rng(5)


def recordings() -> dict[str, np.ndarray]:
    """One hot recording, several small ones, and the edge cases of gaps."""
    hot = RNG.normal(10.0, 3.0, 700)
    hot[RNG.random(700) < 0.2] = np.nan
    hot[250:420] = np.nan  # a gap over several blocks
    hot[RNG.integers(0, 200, 8)] = 90.0
    small = RNG.normal(size=37)
    lead = np.array([np.nan, np.nan, 3.0, np.nan, 5.0, np.nan])
    return {
        "hot": hot,
        "small": small,
        "lead": lead,
        "none": np.full(5, np.nan),
        "one": np.array([4.0]),
        "constant": np.full(60, 2.0),
        "single": np.array([np.nan, 7.0, np.nan, np.nan]),
    }


@pytest.fixture(scope="module")
def data():
    return recordings()


@pytest.fixture(scope="module")
def layout(spark, data):
    rows = [(k, int(n), None if np.isnan(v) else float(v)) for k, x in data.items() for n, v in enumerate(x)]
    RNG.shuffle(rows)
    df = spark.createDataFrame([(str(k), int(n), None if v is None else float(v)) for k, n, v in rows], "rec string, pos long, v double")
    return lay_out(df.repartition(5), ["rec"], ["pos"], block_rows=48, halo=40, label="t")


def column(df, name: str) -> dict[str, np.ndarray]:
    pdf = df.select("rec", "i", name).toPandas().sort_values(["rec", "i"])
    return {k: g[name].to_numpy(dtype=float) for k, g in pdf.groupby("rec")}


def same(got: dict, want: dict, **tol):
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], err_msg=k, **({"atol": 1e-9} | tol))


def fill_nearest(x):
    known = np.flatnonzero(~np.isnan(x))
    out = x.copy()
    for n in np.flatnonzero(np.isnan(x)):
        if len(known):
            dist = np.abs(known - n)
            out[n] = x[known[dist == dist.min()].max()]
    return out


def fill_linear(x):
    known = np.flatnonzero(~np.isnan(x))
    if len(known) < 2:
        return x.copy()
    return np.interp(np.arange(len(x)), known, x[known], left=np.nan, right=np.nan)


def local_outliers(x, width):
    s = pd.Series(x)
    roll = lambda v: v.rolling(width, center=True, min_periods=1).median()
    dev = (s - roll(s)).abs()
    mad = roll(dev) * 1.4826
    out = (mad > 0) & (dev > 3 * mad)
    if not out.any():
        return x.copy()
    return fill_nearest(fill_linear(np.where(out, np.nan, x)))


def test_positions_and_blocks(layout, data):
    pdf = layout.core().select("rec", "i", "pos", "blk").toPandas()
    assert (pdf.i == pdf.pos).all() and (pdf.blk == pdf.i // 48).all()
    assert len(pdf) == sum(map(len, data.values())) and layout.spans_blocks
    largest = layout.df.groupBy("rec", "blk").count().agg(F.max("count")).first()[0]
    assert largest <= 48 + 80


def test_fills(layout, data):
    same(column(missing.fill_nearest(layout, "v"), "filled"), {k: fill_nearest(x) for k, x in data.items()})
    same(column(missing.fill_linear(layout, "v"), "filled"), {k: fill_linear(x) for k, x in data.items()})
    many = missing.fill_many(layout, layout.df, ["v"], with_halo=True)
    assert many.where("rec <> 'none' AND v IS NULL").isEmpty()
    same(column(many.where("core"), "v"), {k: fill_nearest(fill_linear(x)) for k, x in data.items()})
    spread = many.groupBy("rec", "i").agg((F.max("v") - F.min("v")).alias("d")).agg(F.max("d")).first()[0]
    assert spread < 1e-12  # halo copies agree with their core row


@pytest.mark.parametrize("width", [3, 10, 11])
def test_local_outliers_and_median(layout, data, width):
    same(column(missing.replace_local_outliers(layout, "v", width), "clean"), {k: local_outliers(x, width) for k, x in data.items()})
    smooth = layout.with_df(layout.df.withColumn("m", missing.moving_median(layout, "v", width))).core()
    pandas = {k: pd.Series(x).rolling(width, center=True, min_periods=1).median().to_numpy() for k, x in data.items()}
    same(column(smooth, "m"), pandas)


def test_global_outliers(layout, data):
    def plain(x):
        good = x[~np.isnan(x)]
        if len(good) < 2 or good.std(ddof=1) == 0:
            return x.copy()
        bad = np.abs(x - good.mean()) > 3 * good.std(ddof=1)
        out, last = x.copy(), np.nan
        for n in range(len(x)):
            if bad[n]:
                out[n] = x[n] if np.isnan(last) else last
            else:
                last = x[n]
        return out

    same(column(missing.replace_global_outliers(layout, "v"), "clean"), {k: plain(x) for k, x in data.items()})


def test_short_smoothing(layout, data):
    def plain(x, win):
        if len(x) < 3:
            return x
        win = min(win + 1 - win % 2, len(x) if len(x) % 2 else len(x) - 1)
        return pd.Series(x).rolling(win, center=True, min_periods=1).median().to_numpy() if win > 1 else x

    same(column(missing.smooth_short(layout, "v", 6, "s"), "s"), {k: plain(x, 6) for k, x in data.items()})


def test_reach_is_checked(layout):
    with pytest.raises(ValueError, match="halo"):
        layout.centred(200)


def test_attach_keeps_rows(layout, data):
    stats = layout.core().groupBy("rec").agg(F.count("v").alias("n"))
    got = attach(layout, layout.core(), stats)
    assert got.count() == sum(map(len, data.values()))
    assert {r.rec: r.n for r in got.select("rec", "n").distinct().collect()} == {k: int((~np.isnan(x)).sum()) for k, x in data.items()}


def plain_slew(x, limit=6.0, step=4.0):
    out, prev = [], np.nan
    for v in x:
        if np.isnan(prev):
            y = v
        elif np.isnan(v):
            y = prev
        else:
            y = v if abs(v - prev) <= limit else prev + np.sign(v - prev) * step
        out.append(y)
        prev = y if not np.isnan(y) else prev
    return np.array(out, dtype=float)


def test_slew_limit_across_blocks(layout, data):
    same(column(tracking.slew_limited(layout, "v"), "limited"), {k: plain_slew(x) for k, x in data.items()})
    assert plain_slew(np.array([72.0, 150.0])).tolist() == [72.0, 76.0]


def test_stateful_scan_with_memory_that_never_fades(layout, data):
    """A running sum needs every earlier block: the repetition still ends in the sequential result."""

    def fold(block, carry):
        total, out = (carry[0] if carry else 0.0), []
        for v in block["v"]:
            total += 0.0 if v is None or np.isnan(v) else v
            out.append(total)
        return out, [total]

    blocks = block_arrays(layout, ["v"])
    done = stateful_scan(blocks, ["rec"], ["v"], fold, T.DoubleType(), spans_blocks=True)
    last = done.groupBy("rec").agg(F.max_by(F.element_at("out", -1), "blk").alias("s")).toPandas().set_index("rec").s
    for k, x in data.items():
        assert last[k] == pytest.approx(np.nansum(x))


def plain_sections(sections, x, start):
    for j, (b0, b1, b2, a1, a2) in enumerate(sections):
        z1, z2 = start[j]
        y = np.empty_like(x)
        for t, v in enumerate(x):
            y[t] = b0 * v + z1
            z1, z2 = b1 * v + z2 - a1 * y[t], b2 * v - a2 * y[t]
        x = y
    return x


def plain_zero_phase(sections, x):
    pad = 3 * (2 * len(sections) + 1)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    rest = iir.steady_state(sections)
    y = plain_sections(sections, ext, ext[0] * rest)
    y = plain_sections(sections, y[::-1], y[-1] * rest)[::-1]
    return y[pad:-pad]


def test_bandpass_carried_over_blocks(spark, layout, data):
    full = layout.with_df(layout.df.withColumn("v", F.coalesce("v", F.lit(1.5))))
    got = column(filtering.bandpass(full, {"v": (0.5, 5.0)}, 20.0), "v")
    sections = filtering.band_sections(20.0, 0.5, 5.0)
    for k, x in data.items():
        x = np.where(np.isnan(x), 1.5, x)
        want = x - x.mean() if len(x) <= 27 else plain_zero_phase(sections, x)
        np.testing.assert_allclose(got[k], want, atol=1e-8, err_msg=k)


def test_bandpass_single_block_equals_blocks(spark, data):
    rows = [("hot", n, float(np.nan_to_num(v, nan=1.0))) for n, v in enumerate(data["hot"])]
    lay = lay_out(spark.createDataFrame(rows, "rec string, pos long, v double"), ["rec"], ["pos"], block_rows=4096, halo=64)
    assert not lay.spans_blocks
    got = column(filtering.bandpass(lay, {"v": (0.5, 5.0)}, 20.0), "v")["hot"]
    x = np.nan_to_num(data["hot"], nan=1.0)
    np.testing.assert_allclose(got, plain_zero_phase(filtering.band_sections(20.0, 0.5, 5.0), x), atol=1e-8)


def test_bandpass_response():
    sections = iir.butter_bandpass(4, 0.01, 0.1)
    for edge, gain in ((0.01, np.sqrt(0.5)), (0.1, np.sqrt(0.5)), (0.9, 0.0)):
        z = np.exp(-1j * np.pi * edge)
        h = np.prod([(s[0] + s[1] * z + s[2] * z * z) / (1 + s[3] * z + s[4] * z * z) for s in sections])
        assert abs(h) == pytest.approx(gain, abs=1e-3)
    assert filtering.band_sections(4.0, 3.0, 1.0) is None


@pytest.mark.parametrize("rates", [(100, 25), (2, 3), (50, 100)])
def test_resample_over_blocks(layout, data, rates):
    fs_in, fs_out = rates
    full = layout.with_df(layout.df.withColumn("v", F.coalesce("v", F.lit(0.0))))
    if fs_in == 100:
        with pytest.raises(ValueError, match="halo"):
            filtering.resample(full, "v", fs_in, fs_out)
        return
    pdf = filtering.resample(full, "v", fs_in, fs_out).toPandas().sort_values(["rec", "j"])
    up, down, taps = iir.resample_taps(fs_in, fs_out)
    half = len(taps) // 2
    for k, x in data.items():
        x = np.nan_to_num(x)
        stretched = np.zeros(len(x) * up)
        stretched[::up] = x
        want = np.convolve(stretched, taps)[half : half + len(stretched)][::down]
        got = pdf[pdf.rec == k]
        assert got.j.tolist() == list(range(-(-len(x) * up // down)))
        np.testing.assert_allclose(got.v, want[: len(got)], atol=1e-9, err_msg=k)


def test_shift_and_ranks(layout, data):
    rows = layout.with_df(layout.df.withColumn("a", delay.shifted(layout, "v", 3)).withColumn("b", delay.shifted(layout, "v", -3)))
    ahead = {k: np.concatenate([x[3:], np.full(min(3, len(x)), np.nan)]) for k, x in data.items()}
    behind = {k: np.concatenate([np.full(3, x[0]), x])[: len(x)] for k, x in data.items()}
    same(column(rows.core(), "a"), ahead)
    same(column(rows.core(), "b"), behind)
    flagged = layout.with_df(layout.df.withColumn("ok", F.coalesce(F.col("v") > 9, F.lit(False))))
    ranked = column(segments.compact_rank(layout, flagged.core(), "ok"), "rank")
    for k, x in data.items():
        ok = np.nan_to_num(x, nan=-1) > 9
        assert (ranked[k][ok] == np.arange(ok.sum())).all() and np.isnan(ranked[k][~ok]).all()
    smooth = column(segments.smooth_in_scope(flagged, "v", "ok", 5, "s"), "s")
    for k, x in data.items():
        ok = np.nan_to_num(x, nan=-1) > 9
        want = pd.Series(x[ok]).rolling(5, center=True, min_periods=1).median().to_numpy()
        np.testing.assert_allclose(smooth[k][ok], want, atol=1e-12)


def test_interpolating_join(spark, data):
    samples = [("a", float(t), 60 + 0.1 * t) for t in range(0, 100, 3)] + [("b", 5.0, 1.0)]
    points = [("a", p, float(x)) for p, x in enumerate([-1.0, 0.0, 0.5, 50.0, 98.9, 99.0, 99.1])] + [("b", 0, 5.0), ("b", 1, 6.0), ("c", 0, 1.0)]
    s = spark.createDataFrame(samples, "rec string, t double, hr double")
    p = spark.createDataFrame(points, "rec string, id int, t double")
    got = interpolate_at(s, p, ["rec"], "t", "hr", block_rows=8, halo=2).toPandas()
    assert len(got) == len(points)
    for _, r in got.iterrows():
        inside = (r.rec == "a" and 0 <= r.t <= 99) or (r.rec == "b" and r.t == 5.0)
        if inside:
            assert r.hr == pytest.approx(60 + 0.1 * r.t if r.rec == "a" else 1.0)
        else:
            assert np.isnan(r.hr)


def burst(fs=10, seconds=80):
    t = np.arange(fs * seconds) / fs
    return np.where((t >= 35) & (t < 50), 0.5 * np.sin(2 * np.pi * t), 0.0)


def test_activity_segments(spark):
    x = np.abs(burst())
    rows = [("move", n, float(v)) for n, v in enumerate(x)] + [("still", n, 0.0) for n in range(300)] + [("tiny", 0, 1.0)]
    df = spark.createDataFrame(rows, "rec string, pos long, mag double")
    lay = lay_out(df, ["rec"], ["pos"], block_rows=160, halo=150, label="seg")
    windows, segs = segments.activity_segments(lay, "mag", 10.0, 1.0)
    found = {r.rec: r for r in segs.collect()}
    assert (found["move"].start_s, found["move"].end_s, found["move"].status) == (35.0, 50.0, "ok")
    assert found["still"].status == "error" and found["tiny"].reason == "signal shorter than one window"
    labels = segments.label_windows(windows, segs).core().where("rec = 'move'").toPandas()
    want = np.where(labels.center_s < 35, "rest", np.where(labels.center_s <= 50, "motion", "recovery"))
    assert (labels.label == want).all() and len(labels) == 80


def test_numbered_rows_leave_when_the_blocks_are_written(spark, monkeypatch):
    from chronoweave.operators import series

    files, write = [], series.materialise

    def kept(df, label):
        done = write(df, label)
        files.extend(done.inputFiles())
        return done

    monkeypatch.setattr(series, "materialise", kept)
    df = spark.createDataFrame([(k, n, float(n)) for k in "ab" for n in range(50)], "rec string, pos long, v double")
    layout = lay_out(df, ["rec"], ["pos"], block_rows=20, halo=5, label="leaves", derived=True)
    assert len(files) > 1 and not any(os.path.exists(f.removeprefix("file://")) for f in files)
    got = layout.core().select("rec", "i", "v").collect()
    assert sorted((r.rec, r.i, r.v) for r in got) == [(k, n, float(n)) for k in "ab" for n in range(50)]
