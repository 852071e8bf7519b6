"""Synthetic recordings through alignment and one trial of the protocol."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import alignment, metrics, protocol, segments
from chronoweave.operators.alignment import RestOptions, partial_fourier
from chronoweave.operators.series import lay_out
from chronoweave.operators.tracking import pick_rate

FS = 20.0
CHANNELS = ["ppg_green", "hf1", "hf2", "cf1", "cf2", "accx", "accy", "accz"]
PARAMS = {
    "Kstop": 0.3, "max_order": 16, "M_base": 2, "C_scale": 1.2, "K_max": 12, "LMS_Mu_Base": 0.01, "Spec_Penalty_Width": 0.2,
    "Spec_Penalty_Weight": 0.2, "smooth_win_len": 7, "hr_range_hz": 25 / 60, "slew_limit_bpm": 10, "slew_step_bpm": 7,
    "alpha_u": 0.1, "M2": 3, "rff_D": 50, "rff_sigma": 1.0, "rff_seed": 3,
}


def rate(t):
    return 75.0 + 8.0 * np.sin(2 * np.pi * t / 40.0)


def recording(name: str, lag_s: float, seconds: int = 140):
    rng = np.random.default_rng(len(name))
    t = np.arange(int(seconds * FS)) / FS
    beat = np.cumsum(rate(t - lag_s)) / 60.0 / FS
    moving = (t >= 70) & (t < 100)
    swing = np.where(moving, np.sin(2 * np.pi * 2.6 * t), 0.0)
    noise = lambda: 0.01 * rng.normal(size=len(t))
    cols = {
        "ppg_green": np.sin(2 * np.pi * beat) + 0.8 * swing + noise(),
        "hf1": swing + noise(), "hf2": np.roll(swing, 2) + noise(), "cf1": np.roll(swing, 1) + noise(), "cf2": noise(),
        "accx": 0.5 * swing + noise() / 10, "accy": 0.2 * swing, "accz": 1.0 + noise() / 10,
    }
    return [(name, n, *(float(cols[c][n]) for c in CHANNELS)) for n in range(len(t))]


@pytest.fixture(scope="module")
def world(spark):
    rows = recording("a", 2.0) + recording("bb", 0.0)
    schema = "rec string, pos long, " + ", ".join(f"{c} double" for c in CHANNELS)
    df = spark.createDataFrame(rows, schema).withColumn("mag", F.sqrt(F.expr("accx*accx + accy*accy + accz*accz")))
    layout = lay_out(df, ["rec"], ["pos"], block_rows=700, halo=340, label="proto")
    _, segs = segments.activity_segments(layout, "mag", FS, 4.0, 1.0)
    ref = spark.createDataFrame([(r, float(t), float(rate(t))) for r in ("a", "bb") for t in range(141)], "rec string, t double, hr double")
    return layout, segs, ref


@pytest.fixture(scope="module")
def delays(world):
    layout, segs, ref = world
    opt = RestOptions(delay_step_s=0.5)
    candidates = alignment.rest_candidates(layout, segs, FS, opt, "ppg_green", "accz")
    scores = alignment.delay_scores(alignment.rest_rates(candidates, ["rec"], FS, opt), ref, ["rec"], opt)
    return alignment.best_delays(scores, ["rec"], opt).select("rec", "delay", "aae", "n_valid")


def test_global_delay_is_found(delays):
    found = {r.rec: r for r in delays.collect()}
    assert found["a"].delay == pytest.approx(2.0, abs=0.5) and found["bb"].delay == pytest.approx(0.0, abs=0.5)
    assert found["a"].aae < 3.0 and found["a"].n_valid > 40


def test_rest_curve_at_the_best_delay(world, delays):
    layout, segs, ref = world
    opt = RestOptions(delay_step_s=0.5)
    rates = alignment.rest_rates(alignment.rest_candidates(layout, segs, FS, opt, "ppg_green", "accz"), ["rec"], FS, opt)
    curve = alignment.rest_curve(rates, delays, ref, ["rec"]).toPandas()
    assert curve.groupby("rec").size().min() > 40 and (curve.rate - curve.ref_hr).abs().mean() < 3.0


def test_motion_frequency_of_whole_segment(world):
    layout, segs, _ = world
    hz = {r.rec: r.move_hz for r in alignment.motion_frequency(layout, segs, ["accx", "accy", "accz"], FS).collect()}
    assert all(v == pytest.approx(2.6, abs=0.05) for v in hz.values()) and len(hz) == 2


def test_partial_fourier_adds_up():
    rng = np.random.default_rng(1)
    y, bins = rng.normal(size=1013), np.arange(17, 200)
    parts = partial_fourier(y[:300], 0, len(y), bins) + partial_fourier(y[300:301], 300, len(y), bins) + partial_fourier(y[301:], 301, len(y), bins)
    np.testing.assert_allclose(parts, np.fft.fft(y)[bins], atol=1e-9)


@pytest.fixture(scope="module")
def windows(world, delays):
    layout, segs, ref = world
    moves = alignment.motion_frequency(layout, segs, ["accx", "accy", "accz"], FS)
    return alignment.training_windows(layout, segs, delays, ref, CHANNELS, FS, 8.0, motion=moves)


def test_training_windows_equal_plain_slices(world, delays, windows):
    layout, _, ref = world
    shift = {r.rec: round(r.delay * FS) for r in delays.collect()}
    raw = {k: g.sort_values("i") for k, g in layout.core().select("rec", "i", "ppg_green").toPandas().groupby("rec")}
    got = windows.select("rec", "w", "s", "center_s", "ref_hr", "ppg_green").toPandas()
    assert not got.duplicated(["rec", "w"]).any()
    for rec, g in got.groupby("rec"):
        x, d = raw[rec].ppg_green.to_numpy(), shift[rec]
        moved = x[d:] if d >= 0 else np.concatenate([np.full(-d, x[0]), x[:d]])
        starts = np.arange(0, len(moved) - 160 + 1, 20)
        starts = starts[starts / FS + 8.0 <= 140]
        assert sorted(g.s) == starts.tolist()
        for r in g.itertuples():
            part = moved[r.s : r.s + 160]
            want = ((part - part.min()) / (part.max() - part.min())).astype(np.float32)
            np.testing.assert_allclose(np.array(r.ppg_green), want, atol=1e-6)
            at = r.s / FS + 8.0
            assert r.ref_hr == pytest.approx(np.interp(at, np.arange(141), rate(np.arange(141))))


@pytest.mark.parametrize("kind,scheme", [("lms", "HF2_ACC3"), ("volterra", "CF2"), ("rff_lms", "ACC3")])
def test_trial(windows, kind, scheme):
    done = protocol.run_trial(windows, ["rec"], FS, PARAMS, scheme, "motion_recovery", kind, tw_s=8.0)
    pdf = done.select("rec", "w", "label", "ref_hr", "baseline_hr", "adaptive_hr", "in_scope").toPandas()
    assert len(pdf) == windows.count() and pdf.adaptive_hr.notna().all()
    assert (pdf.in_scope == pdf.label.isin(["motion", "recovery"])).all()
    rest = pdf[pdf.label == "rest"]
    assert (rest.adaptive_hr == rest.baseline_hr).all()
    assert (rest.baseline_hr - rest.ref_hr).abs().mean() < 5.0
    if kind == "lms":
        motion = pdf[pdf.label == "motion"]
        assert (motion.adaptive_hr - motion.ref_hr).abs().mean() < 12.0
        table = metrics.scope_metrics(done, ["rec"]).toPandas()
        assert (table.n_valid == pdf[pdf.in_scope].groupby("rec").size().reindex(table.rec).to_numpy()).all()


@pytest.mark.parametrize("fs", [25.0, 50.0, 100.0])
def test_every_delay_has_every_window(spark, fs):
    """Positions of all delays, also where the delay step is no whole number of rows."""
    n, opt = int(60 * fs), RestOptions()
    rng = np.random.default_rng(8)
    rows = [("a", i, float(np.sin(2 * np.pi * 1.2 * i / fs)) + float(rng.normal(0, 0.01)), 0.0) for i in range(n)]
    layout = lay_out(spark.createDataFrame(rows, "rec string, i0 long, ppg double, move double"), ["rec"], ["i0"], block_rows=int(20 * fs), halo=int(10 * fs))
    segs = spark.createDataFrame([("a", "ok", 50.0)], "rec string, status string, start_s double")
    rates = alignment.rest_rates(alignment.rest_candidates(layout, segs, fs, opt, "ppg", "move"), ["rec"], fs, opt)
    got = {(r.delay, r.j) for r in rates.select("delay", "j").collect()}
    hop, begin, end = round(opt.hop_s * fs), round(opt.score_start_s * fs), round((50.0 - opt.tw_s) * fs)
    want = set()
    for d in opt.delays():
        j = 0
        while (p := begin + round(d * fs) + hop * j) <= end:
            if p >= 0:
                want.add((float(d), j))
            j += 1
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 97, 256, 257])
def test_ranks_choose_the_bins_that_magnitudes_do(n):
    rng, freq = np.random.default_rng(n), np.linspace(0.5, 4.0, n)
    amp = np.round(rng.random((200, n)), 1)  # ties
    amp[::7, rng.integers(0, n)], amp[::5], amp[1], amp[2, ::2] = np.nan, 0.0, np.nan, -0.0
    ranks = protocol.bin_ranks(amp)
    assert ranks.dtype.itemsize == (1 if n <= 256 else 2)
    for a, r in zip(amp, ranks):
        for previous in (None, 0.0, 30.0, 60.0, 100.3, 500.0):
            how = {"reach_hz": 25 / 60, "limit": 10, "step": 7}
            assert pick_rate(freq, a, previous, **how) == pick_rate(freq, r, previous, **how)


def test_spectra_are_written_as_ranks_and_leave_with_the_trial(windows, monkeypatch):
    tables, write = {}, protocol.materialise

    def kept(df, label):
        done = write(df, label)
        if label == "spectra":
            tables[label] = done.select("in_scope", "_base", "_adap").collect(), done.inputFiles()
        return done

    monkeypatch.setattr(protocol, "materialise", kept)
    protocol.run_trial(windows, ["rec"], FS, PARAMS, "ACC3", "motion_recovery", "lms", tw_s=8.0)
    rows, files = tables["spectra"]
    size = 2 * len(protocol.band_bins(FS, 160))
    assert len(rows) > 100 and {len(r._base) for r in rows} == {size}
    assert all((len(r._adap) == size) if r.in_scope else r._adap is None for r in rows)
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
