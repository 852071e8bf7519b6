"""Global delay of a recording against its reference, motion frequency, and training windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.arrays import doubles, minmax
from chronoweave.functions.columns import segment_label
from chronoweave.operators import windows as W
from chronoweave.operators.blocks import block_arrays, stateful_scan
from chronoweave.operators.interpolate import bias_scores, interpolate_at
from chronoweave.operators.metrics import pick_best
from chronoweave.operators.segments import re_block
from chronoweave.operators.series import Layout, attach
from chronoweave.operators.tracking import track_rest
from chronoweave.storage import materialise

TRACKED = T.StructType([T.StructField("j", T.LongType()), T.StructField("tracked", T.DoubleType())])
SCAN_ROWS = 4096  # windows per block of an ordered scan


@dataclass(frozen=True)
class RestOptions:
    """Fixed values of the delay search."""

    tw_s: float = 8.0
    hop_s: float = 1.0
    score_start_s: float = 5.0
    delay_step_s: float = 0.1
    delay_max_s: float = 5.0
    band_bpm: tuple[float, float] = (40.0, 180.0)
    track_bpm: float = 30.0
    slew_limit_bpm: float = 6.0
    slew_step_bpm: float = 4.0
    smooth_win: int = 3
    peak_share: float = 0.3
    penalty: bool = True
    penalty_weight: float = 0.2
    penalty_width_hz: float = 0.2
    score: str = "aae"

    def delays(self) -> np.ndarray:
        low = -min(5.0, self.tw_s / 2.0)
        return np.round(np.arange(low, self.delay_max_s + 1e-9, self.delay_step_s), 10)


def _cut(arrays: list[str], start: Column, size: int) -> list[Column]:
    """Slices of block arrays from row position ``start``."""
    return [F.slice(F.col(a), (start - F.col("first_i") + 1).cast("int"), F.lit(size)).alias(a) for a in arrays]


def _grid(first: Column, last: Column, step: int) -> Column:
    """Multiples ``first, first + step, ...`` up to ``last``; empty when there is none."""
    return F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def _round_up(value: Column, step: int, offset: int = 0) -> Column:
    """Smallest number ``>= value`` that equals ``offset`` modulo ``step``."""
    return value + F.pmod(F.lit(offset) - value, F.lit(step))


def rest_candidates(layout: Layout, segments: DataFrame, fs: float, opt: RestOptions, ppg: str, penalty: str) -> DataFrame:
    """Spectral candidates of every rest window that any delay can need: ``key, p, freqs`` (in Hz).

    A delayed recording only moves the windows, so each window position is transformed once and
    shared by all delays: about ten times less work than one pass per delay.
    """
    win, hop, begin = round(opt.tw_s * fs), round(opt.hop_s * fs), round(opt.score_start_s * fs)
    # Windows of a delay lie one hop apart; delays whose shift is equal modulo the hop share theirs.
    residues = F.array(*[F.lit(r).cast("long") for r in sorted({(begin + round(d * fs)) % hop for d in opt.delays()})])
    layout.check_reach(win - 1)
    blocks = attach(layout, block_arrays(layout, [ppg, penalty], with_halo=True), segments.where("status = 'ok'").select(*layout.key, "start_s"))
    rows_in = F.col("first_i") + F.size(ppg)
    low_p = F.greatest(F.col("blk") * layout.block_rows, F.lit(0)).cast("long")
    rest_end = F.rint((F.col("start_s") - opt.tw_s) * fs).cast("long")
    last = F.least((F.col("blk") + 1) * layout.block_rows - 1, rest_end, rows_in - win)
    starts = blocks.where(F.col("start_s").isNotNull()).withColumns({"_low": low_p, "_last": last})
    starts = starts.withColumn("_p", F.flatten(F.transform(residues, lambda r: _grid(F.col("_low") + F.pmod(r - F.col("_low"), F.lit(hop)), F.col("_last"), hop))))
    cut = F.transform("_p", lambda p: F.struct(p.alias("p"), *_cut([ppg, penalty], p, win)))
    rows = starts.select(*layout.key, F.inline(cut))
    low, high = opt.band_bpm[0] / 60.0, opt.band_bpm[1] / 60.0
    rows = rows.withColumn("_peaks", W.peak_list(ppg, fs, low, high, opt.peak_share))
    if opt.penalty:
        rows = rows.withColumn("_move", F.get(W.peak_list(penalty, fs, low, high, opt.peak_share, window=False), F.lit(0))["freq"])
        rows = rows.withColumn("_peaks", W.penalised(F.col("_peaks"), F.col("_move"), opt.penalty_weight, opt.penalty_width_hz))
    return rows.select(*layout.key, "p", F.transform("_peaks", lambda c: c["freq"]).alias("freqs"))


def rest_rates(candidates: DataFrame, key: list[str], fs: float, opt: RestOptions) -> DataFrame:
    """Tracked and smoothed rest rate of every delay: ``key, delay, j, time_s, tracked, smooth``."""
    hop, begin = round(opt.hop_s * fs), round(opt.score_start_s * fs)
    candidates = materialise(candidates, "candidates")
    last_p = candidates.agg(F.max("p")).first()[0]
    furthest = 0 if last_p is None else (last_p - begin + round(opt.tw_s * fs)) // hop
    options = F.array(*[F.struct(F.lit(float(d)).alias("delay"), F.lit(int(round(d * fs))).alias("rows")) for d in opt.delays()])
    fits = F.filter(
        options, lambda o: (F.col("p") - o["rows"] >= begin) & (F.pmod(F.col("p") - o["rows"] - begin, F.lit(hop)) == 0)
    )
    per_delay = candidates.select(*key, "p", "freqs", F.inline(fits)).select(
        *key, "delay", F.expr(f"(p - rows - {begin}) div {hop}").alias("j"), "freqs"
    )
    full_key = [*key, "delay"]
    packed = (
        per_delay.groupBy(*full_key, F.expr(f"j div {SCAN_ROWS}").alias("blk"))
        .agg(F.array_sort(F.collect_list(F.struct("j", "freqs"))).alias("_a"))
        .select(*full_key, "blk", F.col("_a.j").alias("js"), F.col("_a.freqs").alias("freqs"))
    )
    band, limit, step = opt.track_bpm, opt.slew_limit_bpm, opt.slew_step_bpm

    def fold(block: dict, carry: list | None):
        rates, carry = track_rest(block["freqs"], carry, band=band, limit=limit, step=step)
        return [{"j": int(j), "tracked": r} for j, r in zip(block["js"], rates)], carry

    done = stateful_scan(packed, full_key, ["js", "freqs"], fold, TRACKED, spans_blocks=furthest >= SCAN_ROWS)
    rows = done.select(*full_key, F.inline("out"))
    near = re_block(rows, full_key, "j", SCAN_ROWS, opt.smooth_win + 1)
    order = Window.partitionBy(*full_key, "_rb").orderBy("j")
    n_here = F.count(F.lit(1)).over(Window.partitionBy(*full_key, "_rb"))
    # An even width grows by one; a width above the length of the recording shrinks to its largest odd part.
    odd, smoothed = opt.smooth_win + 1 - opt.smooth_win % 2, F.col("tracked")
    for w in range(3, odd + 1, 2) if opt.smooth_win > 1 else ():
        whole = F.col("_rb") == 0
        fits = ~whole | (n_here >= w) if w == odd else whole & n_here.isin(w, w + 1)
        smoothed = F.when(fits, F.percentile("tracked", F.lit(0.5)).over(order.rowsBetween(-(w // 2), w // 2))).otherwise(smoothed)
    smooth = near.withColumn("smooth", smoothed).where("core")
    time_s = opt.score_start_s + F.col("j") * (hop / fs) + opt.tw_s / 2.0
    return smooth.select(*full_key, "j", time_s.alias("time_s"), "tracked", "smooth")


def delay_scores(rates: DataFrame, reference: DataFrame, key: list[str], opt: RestOptions) -> DataFrame:
    """Score table per recording and delay.  The reference is read once per window time, not per delay."""
    rates = materialise(rates, "rates")
    times = rates.groupBy(*key, "j").agg(F.first("time_s").alias("t"))
    ref = interpolate_at(reference, times, key, "t", "hr").select(*key, "j", F.col("hr").alias("ref_hr"))
    joined = rates.join(ref, [*key, "j"]).withColumn("err", F.col("smooth") - F.col("ref_hr"))
    return bias_scores(joined, key, "delay", "err")


def rest_curve(rates: DataFrame, best: DataFrame, reference: DataFrame, key: list[str]) -> DataFrame:
    """Diagnostic curve at the best delay: ``key, time_s, rate, ref_hr`` where both are known."""
    chosen = rates.join(best.select(*key, "delay"), [*key, "delay"]).select(*key, "time_s", F.col("time_s").alias("t"), F.col("smooth").alias("rate"))
    rows = interpolate_at(reference, chosen, key, "t", "hr")
    return rows.where("rate IS NOT NULL AND hr IS NOT NULL").select(*key, "time_s", "rate", F.col("hr").alias("ref_hr"))


def best_delays(scores: DataFrame, key: list[str], opt: RestOptions) -> DataFrame:
    """Best delay per recording by (score, absolute delay, RMSE, other score)."""
    main, other = ("aae", "std") if opt.score in ("aae", "mae") else ("std", "aae")
    best = pick_best(scores, key, "delay", main, ["rmse", other])
    return best.where(F.col("delay").isNotNull())


def motion_frequency(layout: Layout, segments: DataFrame, axes: list[str], fs: float, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Main frequency of the most energetic axis inside the motion segment: ``key, move_hz``.

    The spectrum has the resolution of the whole segment.  Every block adds its part of each
    Fourier sum, so a segment of any length is transformed without bringing it into one task.
    """
    spans = segments.where("status = 'ok'").select(
        *layout.key, F.rint(F.col("start_s") * fs).cast("long").alias("_from"), F.rint(F.col("end_s") * fs).cast("long").alias("_to")
    )
    rows = attach(layout, layout.core(), spans).where((F.col("i") >= F.col("_from")) & (F.col("i") < F.col("_to")))
    stats = rows.groupBy(*layout.key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("i").alias("_i0"),
        *[F.avg(a).alias(f"_m_{a}") for a in axes],
        *[(F.var_pop(a) * F.count(a)).alias(f"_e_{a}") for a in axes],
    )
    ranked = F.array(*[F.struct(F.round(f"_e_{a}", 9).alias("e"), F.lit(-n).alias("n")) for n, a in enumerate(axes)])
    chosen = stats.where(F.col("_n") >= max(8, int(fs))).withColumn("_axis", -F.array_max(ranked)["n"])
    mean = F.coalesce(*[F.when(F.col("_axis") == n, F.col(f"_m_{a}")) for n, a in enumerate(axes)])
    chosen = chosen.select(*layout.key, "_n", "_i0", "_axis", mean.alias("_mean"))
    value = F.coalesce(*[F.when(F.col("_axis") == n, F.col(a)) for n, a in enumerate(axes)])
    at = F.col("i") - F.col("_i0")
    weight = 0.54 - 0.46 * F.cos(2.0 * np.pi * at / F.col("_n"))
    weighted = attach(layout, rows, chosen).where(F.col("_n").isNotNull()).select(
        *layout.block_key, "i", F.col("_n"), at.alias("at"), ((value - F.col("_mean")) * weight).alias("y")
    )
    blocks = weighted.groupBy(*layout.block_key, "_n").agg(F.array_sort(F.collect_list(F.struct("at", "y"))).alias("_a"))
    blocks = blocks.select(*layout.key, "_n", F.element_at("_a.at", 1).alias("_at"), F.col("_a.y").alias("_y"))
    key = list(layout.key)
    schema = blocks.select(*key).schema.add("hz", T.DoubleType()).add("re", T.DoubleType()).add("im", T.DoubleType())

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some in np.array_split(np.arange(len(pdf)), -(-len(pdf) // 256)):
                hz, totals, sizes = [np.empty(0)], [np.empty(0, complex)], []
                for n, at, y in zip(*(pdf[c].iloc[some] for c in ("_n", "_at", "_y"))):
                    bins = np.arange(int(np.ceil(low * n / fs - 1e-9)), int(np.floor(high * n / fs + 1e-9)) + 1)
                    bins = bins[(bins * fs / n >= low) & (bins * fs / n <= high) & (bins <= n // 2)]
                    sizes.append(len(bins))
                    if len(bins):
                        hz.append(bins * fs / n)
                        totals.append(partial_fourier(np.asarray(y, dtype=float), int(at), int(n), bins))
                total = np.concatenate(totals)
                whose = pdf[key].iloc[np.repeat(some, sizes)].reset_index(drop=True)
                yield whose.assign(hz=np.concatenate(hz), re=total.real, im=total.imag)

    sums = blocks.mapInPandas(parts, schema).groupBy(*key, "hz").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    power = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return sums.groupBy(*key).agg(F.max_by("hz", F.struct(F.round(power, 9), -F.col("hz"))).alias("move_hz"))


def partial_fourier(y: np.ndarray, start: int, n: int, bins: np.ndarray) -> np.ndarray:
    """Contribution of samples ``start, start + 1, ...`` to the bins of an ``n``-point transform.

    A chirp turns the sums at consecutive bins into one convolution; squares are reduced modulo
    ``2 n`` so that the phases stay exact for long segments.
    """
    phase = lambda q: np.exp(1j * np.pi * (q % (2 * n)) / n)
    j, k = np.arange(len(y), dtype=np.int64), np.arange(len(bins), dtype=np.int64)
    lead = np.exp(-2j * np.pi * ((int(bins[0]) * j) % n) / n)
    a = y * lead * phase(-(j * j))
    size = 1 << int(len(y) + len(bins) - 1).bit_length()
    kernel = np.zeros(size, complex)
    kernel[: len(bins)] = phase(k * k)
    kernel[size - len(y) + 1 :] = phase(j[1:] * j[1:])[::-1]
    conv = np.fft.ifft(np.fft.fft(a, size) * np.fft.fft(kernel))[: len(bins)]
    shift = np.exp(-2j * np.pi * ((bins.astype(np.int64) * start) % n) / n)
    return conv * phase(-(k * k)) * shift


def training_windows(
    layout: Layout,
    segments: DataFrame,
    delays: DataFrame,
    reference: DataFrame,
    channels: list[str],
    fs: float,
    tw_s: float,
    hop_s: float = 1.0,
    motion: DataFrame | None = None,
) -> DataFrame:
    """Delay-corrected, labelled, normalised windows: one row per window, one array per channel.

    The window list with label and reference is small and is joined to the blocks; each block then
    cuts its own windows, so samples are never shuffled.  A negative delay repeats the first sample
    in front of the recording.  ``motion(key, move_hz)`` gives the motion frequency, 1 Hz where it
    is unknown.
    """
    win, hop = round(tw_s * fs), max(1, round(hop_s * fs))
    key = list(layout.key)
    layout.check_reach(win - 1)
    sizes = layout.core().groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    shift = F.rint(F.col("delay") * fs).cast("long")
    known = segments.where("status = 'ok'").join(delays.select(*key, "delay"), key).join(sizes, key)
    known = known.withColumn("move_hz", F.lit(None).cast("double")) if motion is None else known.join(motion, key, "left")
    per_recording = (
        known.select(
            *key, F.coalesce("move_hz", F.lit(1.0)).alias("move_hz"), shift.alias("_shift"), "_n",
            F.greatest(F.lit(0.0), F.col("start_s") - F.col("delay")).alias("_ms"),
            F.greatest(F.lit(0.0), F.col("start_s") - F.col("delay"), F.col("end_s") - F.col("delay")).alias("motion_end"),
        )
    )
    spread = layout.blocks.join(per_recording, key)
    low = F.when(F.col("blk") == 0, F.least(F.col("_shift"), F.lit(0))).otherwise(F.col("blk") * layout.block_rows)
    low = F.greatest(low, F.col("_shift"))
    last = F.least((F.col("blk") + 1) * layout.block_rows - 1, F.col("_n") + F.least(F.col("_shift"), F.lit(0)) - win)
    first_s = _round_up(low - F.col("_shift"), hop)
    starts = spread.select(
        *key, "blk", "_shift", "_ms", "motion_end", "move_hz", F.explode(_grid(first_s, last - F.col("_shift"), hop)).alias("s")
    )
    center = F.col("s") / fs + tw_s / 2.0
    plan = starts.select(
        *key, "blk", "_shift", "move_hz", F.col("s"), F.expr(f"s div {hop}").alias("w"), center.alias("center_s"),
        segment_label(center, F.col("_ms"), F.col("motion_end")).alias("label"), "motion_end", (center + tw_s / 2.0).alias("t"),
    )
    with_ref = interpolate_at(reference, plan, key, "t", "hr").where("hr IS NOT NULL")
    lists = with_ref.groupBy(*key, "blk").agg(
        F.first("_shift").alias("_shift"),
        F.array_sort(F.collect_list(F.struct("w", "s", "center_s", "label", "motion_end", "move_hz", F.col("hr").alias("ref_hr")))).alias("_plan"),
    )
    lists = lists.repartition(layout.buckets, *layout.block_key)  # meets the bucketed blocks where they are
    blocks = block_arrays(layout, channels, with_halo=True).join(lists, [*key, "blk"])
    pad = F.when(F.col("blk") == 0, F.greatest(-F.col("_shift"), F.lit(0))).otherwise(F.lit(0)).cast("int")
    padded = [F.concat(F.array_repeat(F.get(c, F.lit(0)), pad), F.col(c)).alias(c) for c in channels]
    blocks = blocks.select(*key, "_shift", "_plan", (F.col("first_i") - pad).alias("first_i"), *padded)
    cut = F.transform("_plan", lambda p: F.struct(p.alias("p"), *_cut(channels, p["s"] + F.col("_shift"), win)))
    rows = blocks.select(*key, F.inline(cut)).select(*key, "p.*", *channels)
    return rows.withColumns({c: doubles(minmax(F.col(c))) for c in channels})
