"""Numeric work on windows held as array columns.  Windows are independent: no shuffle, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from chronoweave.functions import adaptive, iir, spectra
from chronoweave.functions.arrays import by_length, matrix

SPECTRA_AT_ONCE = 128  # windows transformed together: a padded spectrum is far longer than its window

# Sensor groups, and the order in which a scheme uses them.
GROUPS = {"HF": ["hf1", "hf2"], "CF": ["cf1", "cf2"], "ACC": ["accx", "accy", "accz"]}
GROUP_LIMIT = {"ACC": 3, "HF": 2, "CF": 2}
SCHEME_GROUPS = {
    "ACC3": ["ACC"],
    "HF2": ["HF"],
    "CF2": ["CF"],
    "HF2_CF2": ["HF", "CF"],
    "CF2_HF2": ["CF", "HF"],
    "ACC3_HF2": ["ACC", "HF"],
    "HF2_ACC3": ["HF", "ACC"],
}


def dominant_frequency(col: str | Column, fs: float, low: float, high: float, nfft: int | None = None) -> Column:
    @pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(by_length(x, lambda at: spectra.dominant(matrix(x.iloc[at]), fs, low, high, nfft), SPECTRA_AT_ONCE))

    return run(col)


def band_maximum(cols: list[Column], fs: float, low: float, high: float, nfft: int | None = None) -> Column:
    """Frequency of the largest in-band bin of the candidate window with the most energy."""
    names = [f"c{n}" for n in range(len(cols))]

    def one(candidates: list[np.ndarray]) -> np.ndarray:
        x = spectra.strongest(candidates)
        freq, amp = spectra.magnitude(x, fs, nfft)
        band = (freq >= low) & (freq <= high)
        return freq[band][amp[:, band].argmax(axis=1)] if band.any() else np.full(len(x), np.nan)

    @pandas_udf("double")
    def run(pdf: pd.DataFrame) -> pd.Series:
        return pd.Series(by_length(pdf[names[0]], lambda at: one([matrix(pdf[n].iloc[at]) for n in names]), SPECTRA_AT_ONCE))

    return run(F.struct(*[c.alias(n) for c, n in zip(cols, names)]))


def magnitude_spectrum(col: str | Column, fs: float, nfft: int | None = None) -> Column:
    @pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(by_length(x, lambda at: list(spectra.magnitude(matrix(x.iloc[at]), fs, nfft)[1]), SPECTRA_AT_ONCE))

    return run(col)


def peak_list(
    col: str | Column, fs: float, low: float, high: float, share: float, *, nfft: int = 8192, window: bool = True
) -> Column:
    """Array of (freq, amp): local in-band peaks above a share of the largest, strongest first."""

    def one(x: np.ndarray) -> list:
        found = spectra.peak_candidates(spectra.prepare(x, window=window, symmetric=True), fs, low, high, share, nfft)
        return [[{"freq": float(f[i]), "amp": float(a[i])} for i in np.argsort(-a, kind="stable")] for f, a in found]

    @pandas_udf("array<struct<freq:double,amp:double>>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(by_length(x, lambda at: one(matrix(x.iloc[at])), SPECTRA_AT_ONCE))

    return run(col)


def penalised(peaks: Column, motion_hz: Column, weight: float = 0.2, width_hz: float = 0.2) -> Column:
    """Peaks near the motion frequency or its double lose amplitude; strongest first again."""
    hit = lambda p: (F.abs(p["freq"] - motion_hz) < width_hz) | (F.abs(p["freq"] - 2.0 * motion_hz) < width_hz)
    weighted = F.transform(
        peaks, lambda p: F.struct(p["freq"].alias("freq"), F.when(hit(p), p["amp"] * weight).otherwise(p["amp"]).alias("amp"))
    )
    changed = F.when(motion_hz.isNull(), peaks).otherwise(weighted)
    by_amp = F.transform(changed, lambda p, n: F.struct((-p["amp"]).alias("k"), n.alias("n"), p.alias("p")))
    return F.transform(F.array_sort(by_amp), lambda s: s["p"])


def shape_for_delay(x: np.ndarray, fs: float, k_stop: float, move_hz: float | np.ndarray, mode: str) -> np.ndarray:
    """Signal compared in the delay search: the z-scored window itself (``direct``), or the z-scored
    magnitude of its analytic signal, low-passed below ``k_stop`` times the motion frequency (``envelope``).

    ``move_hz`` may differ by row: equal low-passes run together."""
    if mode == "direct":
        return adaptive.zscore(x, 0)
    if mode != "envelope":
        raise ValueError("delay mode must be 'envelope' or 'direct'")
    known = np.isfinite(x)
    level = np.where(known, x, 0.0).sum(1, keepdims=True) / np.maximum(known.sum(1, keepdims=True), 1)
    swing = np.where(known, x - level, 0.0)
    size = np.abs(swing) if x.shape[1] < 4 else iir.analytic_magnitude(swing)
    cut = np.broadcast_to(np.clip(k_stop * move_hz, 0.05, 0.45 * fs) / (fs / 2.0), len(x))
    shaped = np.zeros(size.shape)
    for c in np.unique(cut):
        lowpass, pick = iir.butter_lowpass(2, float(c)), np.flatnonzero(cut == c)
        shaped[pick] = iir.zero_phase(lowpass, size[pick]) if x.shape[1] > iir.pad_length(lowpass) else size[pick]
    return adaptive.zscore(shaped, 0)


def envelope(col: str | Column, fs: float, k_stop: float = 0.3, move_hz: float = 1.0) -> Column:
    @pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(by_length(x, lambda at: list(shape_for_delay(matrix(x.iloc[at]), fs, k_stop, move_hz, "envelope"))))

    return run(col)


def lag_search(a: np.ndarray, b: np.ndarray, max_lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Lag and correlation of the largest absolute correlation per row; the most negative lag wins ties."""
    n = a.shape[1]
    best, lag = np.zeros(len(a)), np.zeros(len(a), dtype=int)
    for d in range(-max_lag, max_lag + 1):
        if n - abs(d) < 3:
            continue
        x, y = (a[:, d:], b[:, : n - d]) if d >= 0 else (a[:, : n + d], b[:, -d:])
        x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
        scale = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        r = np.where(scale > 1e-12, (x * y).sum(axis=1) / np.where(scale > 1e-12, scale, 1.0), 0.0)
        better = np.round(np.abs(r), 9) > np.round(np.abs(best), 9)
        best, lag = np.where(better, r, best), np.where(better, d, lag)
    return lag, best


def batch_delays(
    signals: dict[str, np.ndarray], primary: str, others: list[str], move_hz: np.ndarray, fs: float, k_stop: float, mode: str, reach: int
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Lag and correlation of every compensation channel against the primary one, for a batch of windows."""
    every = np.concatenate([signals[c] for c in (primary, *others)])
    shaped = shape_for_delay(every, fs, k_stop, np.tile(move_hz, 1 + len(others)), mode).reshape(1 + len(others), len(move_hz), -1)
    return {c: lag_search(shaped[0], shaped[n], reach) for n, c in enumerate(others, start=1)}


def window_delays(
    primary: str, others: list[str], fs: float, *, mode: str = "direct", k_stop: float = 0.3, move_hz: str | None = None, max_lag: int | None = None
) -> Column:
    """Array of (channel, lag, r) of every compensation channel against the primary channel."""
    reach = round(0.5 * fs) if max_lag is None else max_lag

    @pandas_udf("array<struct<channel:string,lag:int,r:double>>")
    def run(cols: pd.DataFrame) -> pd.Series:
        def one(at: np.ndarray) -> list:
            part = cols.iloc[at]
            signals = {c: matrix(part[c]) for c in (primary, *others)}
            found = batch_delays(signals, primary, others, part["move_hz"].to_numpy(dtype=float), fs, k_stop, mode, reach)
            return [[{"channel": c, "lag": int(found[c][0][n]), "r": float(found[c][1][n])} for c in others] for n in range(len(at))]

        return pd.Series(by_length(cols[primary], one))

    moving = F.lit(1.0) if move_hz is None else F.col(move_hz)
    return run(F.struct(*[F.col(c) for c in (primary, *others)], moving.alias("move_hz")))


def adaptive_filter(u: str, d: str, kind: str, m: Column | int, k: Column | int, mu: Column | float, **options) -> Column:
    """Residual of ``d`` after one adaptive filter with reference ``u``; designs may differ by row."""

    @pandas_udf("array<double>")
    def run(uu: pd.Series, dd: pd.Series, mm: pd.Series, kk: pd.Series, step: pd.Series) -> pd.Series:
        def one(at: np.ndarray) -> list:
            pick = [s.iloc[at] for s in (uu, dd, mm, kk, step)]
            design = [p.to_numpy() for p in pick[2:]]
            return list(adaptive.adapt(kind, matrix(pick[0]), matrix(pick[1]), *design, options))

        return pd.Series(by_length(dd, one))

    lift = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return run(F.col(u), F.col(d), lift(m, "int"), lift(k, "int"), lift(mu, "double"))


def by_strength(delays: str, names: list[str]) -> Column:
    """Delay records of one sensor group, largest absolute correlation first, ties in declared order."""
    keyed = F.transform(
        F.filter(delays, lambda c: c["channel"].isin(names)),
        lambda c, n: F.struct((-F.round(F.abs(c["r"]), 9)).alias("k"), n.alias("n"), c.alias("c")),
    )
    return F.transform(F.array_sort(keyed), lambda s: s["c"])


def cascade(windows: DataFrame, primary: str, scheme: str, kind: str, delays: str, design, out: str = "filtered", **options) -> DataFrame:
    """Chain of adaptive filters: each stage filters the residual of the stage before.

    The channels of a sensor group come in order of their absolute correlation; ``design(lag, r)``
    gives the columns M, K, mu, mode.  No design depends on a residual, so ``stages`` records them all
    first and one Python worker a task runs the whole chain.
    """
    sources = list(dict.fromkeys([primary, *[c for g in SCHEME_GROUPS[scheme] for c in GROUPS[g]]]))
    stages = []
    for group in SCHEME_GROUPS[scheme]:
        ranked = f"_{group}"
        windows = windows.withColumn(ranked, by_strength(delays, GROUPS[group]))
        for place in range(min(GROUP_LIMIT[group], len(GROUPS[group]))):
            pick = F.get(ranked, F.lit(place))
            m, k, mu, mode = design(pick["lag"], pick["r"])
            stages.append(
                F.struct(
                    F.lit(group).alias("sensor_type"), pick["channel"].alias("channel"), pick["lag"].alias("lag"),
                    pick["r"].alias("r"), m, k, mu, mode, F.lit(kind).alias("filter_type"),
                )
            )

    count = len(stages)

    @pandas_udf("array<double>")
    def run(cols: pd.DataFrame) -> pd.Series:
        def one(at: np.ndarray) -> list:
            part = cols.iloc[at]
            signals = {c: matrix(part[c]) for c in sources}
            current = signals[primary]
            for n in range(count):
                channel, m, k, mu = (part[f"_{x}{n}"].to_numpy() for x in ("c", "m", "k", "mu"))
                reference = np.empty(current.shape)
                for c in np.unique(channel):
                    reference[channel == c] = signals[c][channel == c]
                current = adaptive.adapt(kind, reference, current, m, k, mu, options)
            return list(current)

        return pd.Series(by_length(cols[primary], one))

    windows = windows.withColumn("stages", F.array(*stages)).drop(*[f"_{g}" for g in SCHEME_GROUPS[scheme]])
    used = [F.get("stages", F.lit(n)) for n in range(len(stages))]
    fields = {"c": ("channel", "string"), "m": ("M", "int"), "k": ("K", "int"), "mu": ("mu", "double")}
    designs = [u[name].cast(t).alias(f"_{x}{n}") for n, u in enumerate(used) for x, (name, t) in fields.items()]
    return windows.withColumn(out, run(F.struct(*[F.col(c) for c in sources], *designs)))
