"""Trials as data: a graph of stages whose nodes are the distinct parameter tuples of that stage.

A trial is a row of parameters.  What a stage computes depends on the parameters up to that stage only, so
its nodes are the distinct tuples of those: trials that differ later share all earlier work, whatever mode
they belong to.  Nodes are rows with an id; their parameters reach the kernels as columns.  The number of
Spark jobs follows from the stages, not from the trials.

    windows -> delays -> cascade -> spectrum -> track -> smooth -> trials

Windows meet the nodes in units of up to ``UNIT`` cascades, so that neither a row nor a task grows with the
number of trials.  A kernel that fails for a unit returns the reason in place of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import adaptive
from chronoweave.functions.arrays import matrix
from chronoweave.functions.columns import in_scope
from chronoweave.operators import windows as W
from chronoweave.operators.alignment import SCAN_ROWS
from chronoweave.operators.blocks import stateful_scan
from chronoweave.operators.metrics import HIT_BPM
from chronoweave.operators.protocol import PAIR, band_bins, in_band, two_rates
from chronoweave.operators.segments import smooth_many
from chronoweave.operators.series import Layout, salted_join
from chronoweave.storage import materialise

UNIT = 32  # cascades that one pass over a batch of windows works off
KERNEL_ERRORS = (ValueError, IndexError, KeyError, ArithmeticError, np.linalg.LinAlgError)

# What each stage adds to the parameters of the stages before it.
STAGES = {
    "windows": ["Fs_Target", "TW"],
    "delays": ["Kstop", "delay_mode"],
    "cascade": ["cascade_scheme", "adaptive_filter", "max_order", "M_base", "C_scale", "K_max", "LMS_Mu_Base", "alpha_u", "M2", "rff_D", "rff_sigma", "rff_seed"],
    "spectrum": ["Spec_Penalty_Width", "Spec_Penalty_Weight"],
    "track": ["target_scope", "hr_range_hz", "slew_limit_bpm", "slew_step_bpm"],
    "smooth": ["smooth_win_len"],
}
TYPES = {
    "Fs_Target": "int", "TW": "double", "Kstop": "double", "max_order": "int", "M_base": "int", "C_scale": "double", "K_max": "int",
    "Spec_Penalty_Width": "double", "Spec_Penalty_Weight": "double", "smooth_win_len": "int", "hr_range_hz": "double",
    "slew_limit_bpm": "double", "slew_step_bpm": "double", "LMS_Mu_Base": "double", "alpha_u": "double", "M2": "int", "rff_D": "int",
    "rff_sigma": "double", "rff_seed": "long",
}
MODE = ["target_scope", "cascade_scheme", "adaptive_filter"]
FILTER_ONLY = {"alpha_u": ["volterra"], "M2": ["volterra"], "rff_D": ["rff_lms"], "rff_sigma": ["rff_lms"], "rff_seed": ["rff_lms"]}
STAGE = "struct<sensor_type:string,channel:string,lag:int,r:double,M:int,K:int,mu:double,filter_type:string>"
SUMS = ["n", "abs_sum", "hits", "base_sum", "base_hits"]


def trial_frame(spark: SparkSession, rows: list[dict], extra: dict[str, str] | None = None) -> DataFrame:
    """Trials of all modes as typed rows; parameters that a mode's filter does not use are NULL."""
    kinds = {**(extra or {}), **dict.fromkeys(MODE, "string"), "delay_mode": "string", "repeat_idx": "int", "trial_idx": "int", **TYPES}
    cast = {"int": int, "long": int, "double": float, "string": str}
    get = lambda r, c: None if r.get(c) is None else cast[kinds[c]](r[c])
    return only_used(spark.createDataFrame([tuple(get(r, c) for c in kinds) for r in rows], ", ".join(f"{c} {t}" for c, t in kinds.items())))


def only_used(trials: DataFrame) -> DataFrame:
    return trials.withColumns({c: F.when(F.col("adaptive_filter").isin(kinds), F.col(c)) for c, kinds in FILTER_ONLY.items()})


def graph(trials: DataFrame, stages: dict[str, list[str]] = STAGES) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Trials with the id of their node in the last stage, and the nodes of every stage.

    A node has its own id ``<stage>_id``, the id of the node above it and the parameters of its stage.
    """
    nodes, above, trials = {}, [], trials.withColumn("_t", F.monotonically_increasing_id())
    trials = materialise(trials, "trials")
    rest = trials
    for stage, names in stages.items():
        tuple_of = F.to_json(F.struct(*above, *names))  # equal only for equal tuples, nulls included
        rest = rest.withColumn("_k", tuple_of)
        own = rest.groupBy("_k").agg(*[F.first(c).alias(c) for c in (*above, *names)])
        own = materialise(own.withColumn(f"{stage}_id", F.monotonically_increasing_id()), f"nodes_{stage}")
        rest = rest.join(own.select("_k", f"{stage}_id"), "_k").drop("_k", *above)
        nodes[stage], above = own.drop("_k"), [f"{stage}_id"]
    return trials.join(rest.select("_t", *above), "_t").drop("_t"), nodes


def units(nodes: dict[str, DataFrame]) -> DataFrame:
    """Work of one pass over windows: ``windows_id, fs, k_stop, mode, cascades`` with the spectra below each cascade."""
    spectra = nodes["spectrum"].groupBy("cascade_id").agg(
        F.array_sort(F.collect_list(F.struct("spectrum_id", F.col("Spec_Penalty_Width").alias("width"), F.col("Spec_Penalty_Weight").alias("weight")))).alias("spectra")
    )
    work = nodes["cascade"].join(spectra, "cascade_id").withColumn("_n", F.pmod(F.xxhash64("cascade_id"), F.lit(1 << 20)))
    sizes = nodes["cascade"].groupBy("delays_id").agg(F.ceil(F.count(F.lit(1)) / UNIT).alias("_parts"))
    work = work.join(sizes, "delays_id").withColumn("unit", F.col("_n") % F.col("_parts"))
    fields = [c for c in STAGES["cascade"]]
    packed = work.groupBy("delays_id", "unit").agg(F.array_sort(F.collect_list(F.struct("cascade_id", *fields, "spectra"))).alias("cascades"))
    packed = packed.join(nodes["delays"], "delays_id").join(nodes["windows"], "windows_id")
    return packed.select("windows_id", "unit", F.col("Fs_Target").alias("fs"), F.col("Kstop").alias("k_stop"), F.col("delay_mode").alias("mode"), "cascades")


def design(lag: np.ndarray, r: np.ndarray, node: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, future taps and step of each row's filter; the rule of ``delay.filter_design``."""
    steps = np.floor(np.abs(lag) * node["C_scale"]).astype(int)
    m = np.where(lag > 0, np.minimum(np.maximum(1, steps), node["max_order"]), max(1, node["M_base"]))
    k = np.where(lag < 0, np.minimum(node["K_max"], steps), 0)
    return m, k, np.maximum(1e-6, node["LMS_Mu_Base"] - np.abs(r) / 100.0)


def run_cascade(
    signals: dict[str, np.ndarray], ranked: dict[str, np.ndarray], delays: dict[str, tuple[np.ndarray, np.ndarray]], node: dict, used: list | None = None
) -> np.ndarray:
    """Residual of the primary signal after the stages of one cascade, for all windows of a batch.

    ``used`` gets one record per stage of what each window's filter was.
    """
    options = {c: node[c] for c in ("alpha_u", "M2", "rff_D", "rff_sigma", "rff_seed") if node[c] is not None}
    current = signals["ppg_green"]
    for group in W.SCHEME_GROUPS[node["cascade_scheme"]]:
        names = W.GROUPS[group]
        for place in range(min(W.GROUP_LIMIT[group], len(names))):
            at = ranked[group][:, place]
            pick = lambda parts: np.choose(at if np.ndim(parts[0]) == 1 else at[:, None], parts)  # noqa: B023, E731
            lag, r = (pick([delays[c][i] for c in names]) for i in (0, 1))
            m, k, mu = design(lag, r, node)
            current = adaptive.adapt(node["adaptive_filter"], pick([signals[c] for c in names]), current, m, k, mu, options)
            if used is not None:
                used.append([
                    {"sensor_type": group, "channel": names[a], "lag": int(d), "r": float(x), "M": int(mm), "K": int(kk), "mu": float(u), "filter_type": node["adaptive_filter"]}
                    for a, d, x, mm, kk, u in zip(at, lag, r, m, k, mu)
                ])
    return current


def unit_spectra(signals: dict[str, np.ndarray], move_hz: np.ndarray, fs: float, k_stop: float, mode: str, cascades: list[dict], full: bool = False):
    """(spectrum_id, in-band magnitudes, stages) of all windows for every spectrum below the cascades of a unit."""
    others = [c for g in ("HF", "CF", "ACC") for c in W.GROUPS[g]]
    delays = W.batch_delays(signals, "ppg_green", others, move_hz, fs, k_stop, mode, round(0.5 * fs))
    strength = lambda names: np.stack([-np.round(np.abs(delays[c][1]), 9) for c in names], axis=1)
    ranked = {g: np.argsort(strength(names), axis=1, kind="stable") for g, names in W.GROUPS.items()}
    for node in cascades:
        used: list | None = [] if full else None
        filtered = run_cascade(signals, ranked, delays, node, used)
        stages = [list(s) for s in zip(*used)] if full else [None] * len(move_hz)
        scheme = node["cascade_scheme"]
        if "ACC" in W.SCHEME_GROUPS[scheme]:
            refs = [signals[c] for c in W.GROUPS["ACC"]]
        else:
            group = "CF" if scheme == "CF2" else "HF"
            refs = [np.choose(ranked[group][:, :1], [signals[c] for c in W.GROUPS[group]])]
        for s in node["spectra"]:
            yield s["spectrum_id"], in_band(filtered, fs, refs, s["width"], s["weight"]), stages


def spectra_of(windows: DataFrame, nodes: dict[str, DataFrame], key: list[str], channels: list[str], full: bool = False) -> DataFrame:
    """``key, windows_id, w, spectrum_id, amp, reason, stages``: spectra of every window and node, or why there are none.

    A failing unit gives one row per recording and spectrum with ``w`` and ``amp`` missing.  ``full`` also
    records what each filter used.
    """
    rows = salted_join(windows.select(*key, "windows_id", "w", "move_hz", *channels), units(nodes), ["windows_id"], "w")
    schema = windows.select(*key, "windows_id").schema.simpleString()[7:-1].replace(":", " ")

    def attempt(same: pd.DataFrame) -> Iterator[pd.DataFrame]:
        first, names = same.iloc[0], same[[*key, "windows_id", "w"]].reset_index(drop=True)
        try:
            signals = {c: matrix(same[c]) for c in channels}
            made = list(unit_spectra(signals, same["move_hz"].to_numpy(float), float(first["fs"]), first["k_stop"], first["mode"], first["cascades"], full))
        except KERNEL_ERRORS as error:
            who = names.drop(columns="w").drop_duplicates()
            if len(who) > 1:  # the others must not suffer
                for _, one in same.groupby(key, sort=False):
                    yield from attempt(one)
                return
            for spectrum in [s["spectrum_id"] for c in first["cascades"] for s in c["spectra"]]:
                yield who.assign(w=pd.array([None], "Int64"), spectrum_id=spectrum, amp=None, reason=f"{type(error).__name__}: {error}", stages=None)
            return
        for spectrum, amp, stages in made:
            yield names.assign(spectrum_id=spectrum, amp=list(amp), reason="", stages=stages)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for _, same in pdf.groupby(["windows_id", "k_stop", "mode", "unit"], sort=False):
                yield from attempt(same)

    return rows.mapInPandas(run, f"{schema}, w long, spectrum_id long, amp array<double>, reason string, stages array<{STAGE}>")


def failures(spectra: DataFrame, nodes: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """``key, smooth_id, reason`` of every node that has no result because a kernel failed above it."""
    failed = spectra.where("reason <> ''").groupBy(*key, "spectrum_id").agg(F.min("reason").alias("reason"))
    below = failed.join(nodes["track"].select("spectrum_id", "track_id"), "spectrum_id")
    return below.join(nodes["smooth"].select("track_id", "smooth_id"), "track_id").select(*key, "smooth_id", "reason")


def baselines(windows: DataFrame, nodes: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Blocks of windows in order with what does not depend on the later stages: label, reference, plain spectrum."""
    rows = windows.join(nodes["windows"].select("windows_id", F.col("Fs_Target").alias("fs"), "TW"), "windows_id")
    info = ["w", "center_s", "label", "motion_end", "ref_hr"]
    schema = rows.select(*key, "windows_id", "fs", "TW", *info).schema.simpleString()[7:-1].replace(":", " ")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for fs, same in pdf.groupby("fs", sort=False):
                for _, part in same.groupby(same["ppg_green"].map(len), sort=False):
                    yield part.drop(columns="ppg_green").assign(base=list(in_band(matrix(part["ppg_green"]), float(fs))))

    plain = rows.select(*key, "windows_id", "fs", "TW", *info, "ppg_green").mapInPandas(run, f"{schema}, base array<double>")
    packed = plain.groupBy(*key, "windows_id", "fs", "TW", F.expr(f"w div {SCAN_ROWS}").alias("blk")).agg(F.array_sort(F.collect_list(F.struct(*info, "base"))).alias("_b"))
    return packed.select(*key, "windows_id", "fs", "TW", "blk", *[F.col(f"_b.{c}").alias(c) for c in (*info, "base")])


def tracked(spectra: DataFrame, base: DataFrame, nodes: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """``key, track_id, blk, w, baseline_hr, adaptive_hr, in_scope, ref_hr`` of every tracking node."""
    packed = spectra.where("reason = ''").groupBy(*key, "windows_id", "spectrum_id", F.expr(f"w div {SCAN_ROWS}").alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct("w", "amp"))).alias("_a")
    )
    rows = packed.select(*key, "windows_id", "spectrum_id", "blk", F.col("_a.amp").alias("adap"))
    rows = rows.join(base, [*key, "windows_id", "blk"]).join(nodes["track"], "spectrum_id")
    flags = F.transform(F.arrays_zip("label", "center_s", "motion_end"), lambda x: in_scope(x["label"], F.col("target_scope"), x["center_s"], x["motion_end"]))
    rows = rows.withColumn("in_scope", flags)
    own, inputs = [*key, "track_id"], ["w", "in_scope", "base", "adap", "fs", "TW", "hr_range_hz", "slew_limit_bpm", "slew_step_bpm"]
    rows = materialise(rows.select(*own, "blk", *inputs, "ref_hr"), "to_track")

    def fold(block: dict, carry: list | None):
        freq = band_bins(float(block["fs"]), round(block["TW"] * block["fs"]))
        how = {"reach_hz": block["hr_range_hz"], "limit": block["slew_limit_bpm"], "step": block["slew_step_bpm"]}
        return two_rates(freq, block["w"], block["in_scope"], block["base"], block["adap"], how, carry)

    spans = rows.where("blk > 0").limit(1).count() > 0
    done = stateful_scan(rows, own, inputs, fold, PAIR, spans_blocks=spans, keep=["ref_hr", "in_scope"])
    zipped = F.transform(F.arrays_zip("out", "in_scope", "ref_hr"), lambda x: F.struct(
        x["out"]["w"].alias("w"), x["out"]["baseline_hr"].alias("baseline_hr"), x["out"]["adaptive_hr"].alias("adaptive_hr"), x["in_scope"].alias("in_scope"), x["ref_hr"].alias("ref_hr")
    ))
    return done.select(*own, "blk", F.inline(zipped))


def _smoothed(rates: DataFrame, nodes: dict[str, DataFrame], key: list[str]) -> tuple[DataFrame, list[int]]:
    """Rates with a column ``_s<width>`` for every width in use: all are read off one pass."""
    own = [*key, "track_id"]
    rates = materialise(rates, "rates")
    widths = [r[0] for r in nodes["smooth"].select("smooth_win_len").distinct().orderBy("smooth_win_len").collect()]
    blocks = rates.select(*own, "blk").distinct()
    last = blocks.agg(F.max("blk")).first()[0]
    layout = Layout(rates.withColumn("core", F.lit(True)).withColumn("i", F.col("w")), tuple(own), SCAN_ROWS, 0, int(last or 0), blocks)
    return smooth_many(layout, "adaptive_hr", "in_scope", {f"_s{w}": w for w in widths}), widths


def smoothed_rates(rates: DataFrame, nodes: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Window rates of every smoothing node: ``key, smooth_id, w, baseline_hr, adaptive_hr, in_scope, ref_hr``."""
    smooth, widths = _smoothed(rates, nodes, key)
    value = F.coalesce(*[F.when(F.col("smooth_win_len") == w, F.col(f"_s{w}")) for w in widths])
    joined = smooth.join(nodes["smooth"], "track_id")
    return joined.select(*key, "smooth_id", "w", "baseline_hr", F.when(F.col("in_scope"), value).otherwise(F.col("adaptive_hr")).alias("adaptive_hr"), "in_scope", "ref_hr")


def lineage(nodes: dict[str, DataFrame]) -> DataFrame:
    """Ids of all nodes above each node of the last stage."""
    stages = list(nodes)
    rows = nodes[stages[-1]].select(f"{stages[-1]}_id", f"{stages[-2]}_id")
    for below, above in zip(stages[-2::-1], stages[-3::-1]):
        rows = rows.join(nodes[below].select(f"{below}_id", f"{above}_id"), f"{below}_id")
    return rows


def smoothed_sums(rates: DataFrame, nodes: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Error sums of every recording and smoothing node: ``key, smooth_id, n, abs_sum, hits, base_sum, base_hits``.

    ``rates`` are those of the tracking nodes.
    """
    own = [*key, "track_id"]
    smooth, widths = _smoothed(rates, nodes, key)
    error = lambda c: F.when(F.col("in_scope"), F.round(F.abs(F.col(c) - F.col("ref_hr")), 9))
    parts = [F.struct(F.lit(w).alias("width"), error(f"_s{w}").alias("err")) for w in widths]
    each = smooth.select(*own, error("baseline_hr").alias("base"), F.explode(F.array(*parts)).alias("_p"))
    sums = each.groupBy(*own, F.col("_p.width").alias("smooth_win_len")).agg(
        F.count("_p.err").alias("n"), F.sum("_p.err").alias("abs_sum"), F.count_if(F.col("_p.err") <= HIT_BPM).alias("hits"),
        F.sum("base").alias("base_sum"), F.count_if(F.col("base") <= HIT_BPM).alias("base_hits"),
    )
    return sums.join(nodes["smooth"], ["track_id", "smooth_win_len"]).select(*key, "smooth_id", *SUMS)
