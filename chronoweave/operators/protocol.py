"""One evaluation of the protocol: windows -> cascade -> spectra -> tracked rates -> errors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from chronoweave.functions import spectra
from chronoweave.functions.arrays import by_length, matrix
from chronoweave.functions.columns import in_scope
from chronoweave.operators import windows as W
from chronoweave.operators.alignment import SCAN_ROWS
from chronoweave.operators.blocks import stateful_scan
from chronoweave.operators.delay import filter_design
from chronoweave.operators.segments import smooth_in_scope
from chronoweave.operators.series import Layout
from chronoweave.operators.tracking import pick_rate
from chronoweave.storage import materialise, release

RATE_BAND_HZ = (0.5, 4.0)  # fixed values
MOVE_BAND_HZ = (0.2, 5.0)
PAIR = T.StructType([T.StructField("w", T.LongType()), T.StructField("baseline_hr", T.DoubleType()), T.StructField("adaptive_hr", T.DoubleType())])


def band_bins(fs: float, n: int, nfft: int | None = None) -> np.ndarray:
    freq = np.fft.rfftfreq(nfft or spectra.fft_length(n), 1.0 / fs)
    return freq[(freq >= RATE_BAND_HZ[0]) & (freq <= RATE_BAND_HZ[1])]


def in_band(x: np.ndarray, fs: float, refs: list[np.ndarray] = (), width_hz: float = 0.2, weight: float = 0.2, nfft: int | None = None) -> np.ndarray:
    """In-band magnitudes of a batch of windows.  Bins near the main frequency of the strongest of
    ``refs``, and near its double, are weighted down."""
    freq, amp = spectra.magnitude(x, fs, nfft)
    band = (freq >= RATE_BAND_HZ[0]) & (freq <= RATE_BAND_HZ[1])
    freq, amp = freq[band], amp[:, band]
    if refs:
        move = spectra.dominant(spectra.strongest(refs), fs, *MOVE_BAND_HZ, nfft)[:, None]
        near = (np.abs(freq - move) < width_hz) | (np.abs(freq - 2.0 * move) < width_hz)
        amp = np.where(near & (move > 0), amp * weight, amp)
    return amp


def rank_type(n: int) -> np.dtype:
    """Smallest unsigned type that holds the ranks of ``n`` bins."""
    return np.min_scalar_type(max(n - 1, 0)).newbyteorder("<")


def bin_ranks(amp: np.ndarray) -> np.ndarray:
    """Rank of every bin among the distinct magnitudes of its row; NaN counts as one value above all, as for argmax."""
    order = np.argsort(amp, axis=1, kind="stable")
    ordered = np.take_along_axis(amp, order, 1)
    above = np.zeros(amp.shape, np.int64)
    above[:, 1:] = (ordered[:, 1:] != ordered[:, :-1]) & ~np.isnan(ordered[:, :-1])
    ranks = np.empty(amp.shape, rank_type(amp.shape[1]))
    np.put_along_axis(ranks, order, np.cumsum(above, axis=1).astype(ranks.dtype), 1)
    return ranks


def band_ranks(
    signal: str, fs: float, penalty: list[str] | None = None, width_hz: float = 0.2, weight: float = 0.2, nfft: int | None = None
) -> Column:
    """In-band magnitudes of a column of windows, with ``penalty`` signals as ``refs``, as bytes of their ranks.

    The trackers only ask which bin is the strongest, so ranks of one or two bytes say all that a spectrum
    of doubles says to them, in an eighth or a quarter of the room.
    """
    names = [f"r{n}" for n in range(len(penalty or []))]

    @pandas_udf("binary")
    def run(cols: pd.DataFrame) -> pd.Series:
        def one(at: np.ndarray) -> list:
            refs = [matrix(cols[n].iloc[at]) for n in names]
            return [r.tobytes() for r in bin_ranks(in_band(matrix(cols["x"].iloc[at]), fs, refs, width_hz, weight, nfft))]

        return pd.Series(by_length(cols["x"], one, W.SPECTRA_AT_ONCE))

    refs = [F.col(c).alias(n) for c, n in zip(penalty or [], names)]
    return run(F.struct(F.col(signal).alias("x"), *refs))


def plain_rate(signal: str, fs: float) -> Column:
    """Frequency of the largest bin between 0.5 and 2 Hz."""
    return W.band_maximum([F.col(signal)], fs, 0.5, 2.0)


def penalty_columns(rows: DataFrame, scheme: str) -> tuple[DataFrame, list[str]]:
    """Signals of the spectral penalty: the axes for ACC schemes, else the primary bridge channel."""
    if "ACC" in W.SCHEME_GROUPS[scheme]:
        return rows, W.GROUPS["ACC"]
    names = W.GROUPS["CF" if scheme == "CF2" else "HF"]
    first = F.get(W.by_strength("delays", names), F.lit(0))["channel"]
    return rows.withColumn("_pen", F.coalesce(*[F.when(first == c, F.col(c)) for c in names])), ["_pen"]


def run_trial(
    windows: DataFrame, key: list[str], fs: float, params: dict, scheme: str, scope: str, kind: str, *, tw_s: float
) -> DataFrame:
    """Window results of one trial: ``key, w, center_s, label, ref_hr, baseline_hr, adaptive_hr, in_scope, stages``.

    ``windows`` come from ``training_windows`` with a ``move_hz`` column.  Everything up to the
    spectra is independent per window; only two short spectra per window enter the ordered scan.
    """
    others = [c for g in ("HF", "CF", "ACC") for c in W.GROUPS[g]]
    inside = in_scope(F.col("label"), F.lit(scope), F.col("center_s"), F.col("motion_end"))
    rows = windows.withColumn("in_scope", inside)
    rows = rows.withColumn(
        "delays",
        W.window_delays("ppg_green", others, fs, mode=params.get("delay_estimation_mode", "envelope"), k_stop=params["Kstop"], move_hz="move_hz"),
    )

    def design(lag: Column, r: Column) -> list[Column]:
        return filter_design(
            lag, r, max_order=params["max_order"], m_base=params["M_base"], c_scale=params["C_scale"],
            k_max=params["K_max"], mu_base=params["LMS_Mu_Base"], mu_min=params.get("LMS_Mu_Min", 1e-6),
        )

    extras = {k: params[k] for k in ("alpha_u", "M2", "rff_D", "rff_sigma", "rff_seed", "LMS_Mu_Min") if k in params}
    rows = W.cascade(rows, "ppg_green", scheme, kind, "delays", design, **extras)
    rows, penalty = penalty_columns(rows, scheme)
    nfft = params.get("nfft")  # default: 8192 points or the next power of two
    base = band_ranks("ppg_green", fs, nfft=nfft).alias("_base")
    adap = band_ranks("filtered", fs, penalty, params["Spec_Penalty_Width"], params["Spec_Penalty_Weight"], nfft)
    adap = F.when(F.col("in_scope"), adap).alias("_adap")  # nothing looks at the others
    narrow = materialise(rows.select(*key, "w", "center_s", "label", "ref_hr", "in_scope", "stages", base, adap), "spectra")
    rates = materialise(track_rates(narrow, key, fs, params, round(tw_s * fs)), "rates")
    release(narrow)
    return smooth_results(rates, key, params["smooth_win_len"])


def two_rates(freq: np.ndarray, ws, inside, base_spectra, adap_spectra, how: dict, carry: list | None) -> tuple[list[dict], list[float]]:
    """Baseline and adaptive rate of the windows of one block, and the state that the next block needs."""
    base, adap = (None if math.isnan(c) else c for c in carry) if carry else (None, None)
    out = []
    for w, within, b, a in zip(ws, inside, base_spectra, adap_spectra):
        now = pick_rate(freq, np.asarray(b), base, **how)
        base = now if math.isfinite(now) else base
        rate = pick_rate(freq, np.asarray(a), adap, **how) if within else now
        adap = rate if math.isfinite(rate) else adap
        out.append({"w": int(w), "baseline_hr": float(now), "adaptive_hr": float(rate)})
    return out, [math.nan if c is None else float(c) for c in (base, adap)]


def track_rates(rows: DataFrame, key: list[str], fs: float, params: dict, win: int) -> DataFrame:
    """Baseline and adaptive rate in window order, from spectra as ``band_ranks``.  Windows out of scope
    feed the baseline rate into the adaptive state."""
    fields, inputs = ["w", "center_s", "label", "ref_hr", "in_scope", "stages"], ["w", "in_scope", "_base", "_adap"]
    packed = rows.groupBy(*key, F.expr(f"w div {SCAN_ROWS}").alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct("w", "in_scope", "_base", "_adap"))).alias("_a")
    )
    packed = packed.select(*key, "blk", *[F.col(f"_a.{c}").alias(c) for c in inputs])
    freq = band_bins(fs, win, params.get("nfft"))
    how = {"reach_hz": params["hr_range_hz"], "limit": params["slew_limit_bpm"], "step": params["slew_step_bpm"]}

    kind = rank_type(len(freq))

    def fold(block: dict, carry: list | None):
        base, adap = ([None if b is None else np.frombuffer(b, kind) for b in block[c]] for c in ("_base", "_adap"))
        return two_rates(freq, block["w"], block["in_scope"], base, adap, how, carry)

    last_w = rows.agg(F.max("w")).first()[0]
    spans = last_w is not None and last_w >= SCAN_ROWS
    done = stateful_scan(packed, key, inputs, fold, PAIR, spans_blocks=spans)
    return done.select(*key, "blk", F.inline("out")).join(rows.select(*key, *fields), [*key, "w"])


def smooth_results(rows: DataFrame, key: list[str], width: int) -> DataFrame:
    """Moving median of the adaptive rate over the windows in scope; ``rows`` are a written table."""
    blocks = rows.select(*key, "blk").distinct()
    last = blocks.agg(F.max("blk")).first()[0]
    layout = Layout(rows.withColumn("core", F.lit(True)).withColumn("i", F.col("w")), tuple(key), SCAN_ROWS, 0, int(last or 0), blocks)
    smooth = smooth_in_scope(layout, "adaptive_hr", "in_scope", width, "_smooth")
    return smooth.withColumn("adaptive_hr", F.when(F.col("in_scope"), F.col("_smooth")).otherwise(F.col("adaptive_hr"))).drop(
        "_smooth", "rank", "i", "blk"
    )
