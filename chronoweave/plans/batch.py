"""The batch experiment: folder of recordings -> quality -> alignment -> trials -> folds -> result tables.

Trials are rows of parameters.  Uniform ones do not depend on the fold or the motion type, so every
trial is evaluated once on all recordings, and stages with equal parameters are shared among trials.
What remains per recording is a row of sums (windows, absolute error, hits); folds, motion types and
winners are joins and aggregations of these rows, however many folds there are.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.operators import alignment, experiment, filtering, metrics, protocol, qc, redraw, sampler, segments, trials
from chronoweave.operators.alignment import RestOptions
from chronoweave.operators.recording import CHANNELS, band_of, clean_recording
from chronoweave.operators.series import Layout, block_rows_of
from chronoweave.session import tune
from chronoweave.sources import pairing, recordings, sinks
from chronoweave.storage import materialise

KEY = ["sample_id"]
MODE = ["target_scope", "cascade_scheme", "adaptive_filter"]


@dataclass(frozen=True)
class BatchOptions:
    fs: int = 100
    scopes: tuple[str, ...] = ("motion_recovery",)
    schemes: tuple[str, ...] = tuple(experiment.SCHEMES)
    filters: tuple[str, ...] = ("lms",)
    n_trials: int = experiment.DEFAULT_TRIALS["n_trials"]
    n_repeats: int = experiment.DEFAULT_TRIALS["n_repeats"]
    random_state: int = experiment.DEFAULT_TRIALS["random_state"]
    objective: str = "aae"
    split_mode: str = "leave_one_group_out"  # or all_train, split
    val_groups: int = 1
    test_groups: int = 1
    delay_mode: str = "envelope"
    sampler: str = "uniform"  # or learning: in generations, a search for every motion type, mode, fold and repeat
    generation: int = 25
    overrides: dict = field(default_factory=dict)
    budgets: dict[str, tuple[int, int]] = field(default_factory=dict)  # scheme -> (trials, repeats)
    rest: RestOptions = RestOptions()
    calibration_s: float = segments.CALIBRATION_S
    block_rows: int = 16_384
    halo: int = 4_096

    def budget(self, scheme: str) -> tuple[int, int]:
        return self.budgets.get(scheme, (self.n_trials, self.n_repeats))

    def most(self) -> tuple[int, int]:
        """Largest budget of any scheme: the trials that have to be drawn."""
        each = [self.budget(s) for s in self.schemes]
        return max(t for t, _ in each), max(r for _, r in each)


@dataclass(frozen=True)
class Recordings:
    """Prepared inputs: band-passed channels by position, references, pairs and quality verdicts."""

    samples: DataFrame
    reference: DataFrame
    pairs: DataFrame
    unpaired: DataFrame
    verdicts: DataFrame
    rows: int


def _relay(rows: DataFrame, count: int, opt: BatchOptions, label: str) -> Layout:
    return block_rows_of(rows, KEY, count, block_rows=opt.block_rows, halo=opt.halo, label=label)


def prepare(spark: SparkSession, folder: str, opt: BatchOptions) -> Recordings:
    """Pair, check, clean and band-pass all recordings of a folder."""
    tune(spark)
    files = materialise(pairing.list_csv(spark, folder), "listed")
    pairs, unpaired = (materialise(t, "files") for t in pairing.pair_files(files))
    unpaired = unpaired.join(files.select("file_name", "file_path"), "file_name", "left")
    lines = recordings.number_lines(recordings._lines(spark, f"{folder}/multi_*[0-9].csv"))
    paired = lines.join(pairs.select(F.col("stem").alias("sample_id")), "sample_id", "left_semi")
    lines = materialise(paired, "lines")
    lacking = recordings.missing_columns(lines)
    some = lines.where("i > 0").select("sample_id").distinct()
    empty = pairs.select(F.col("stem").alias("sample_id")).join(some, "sample_id", "left_anti").join(lacking, "sample_id", "left_anti")
    broken = materialise(lacking.unionByName(empty.withColumn("reason", F.lit("sensor file has no samples"))), "broken")
    raw = recordings.parse_sensor_lines(lines.join(broken, "sample_id", "left_anti"), opt.fs)
    count = lines.count()
    layout = _relay(raw, count, opt, "raw")
    checked = qc.quality(layout, "hf1", "hf2", round(10 * opt.fs))
    verdicts = checked.select("sample_id", "status", "reason", "std1", "std2", "outliers1", "outliers2").unionByName(
        broken.withColumn("status", F.lit("bad")), allowMissingColumns=True
    )
    verdicts = materialise(verdicts, "verdicts")
    good = verdicts.where("status = 'good'").select("sample_id")
    clean = clean_recording(layout, max(3, opt.fs)).join(good, "sample_id", "left_semi").drop("blk")
    clean = _relay(clean, count, opt, "clean")
    samples = materialise(filtering.bandpass(clean, {c: band_of(c) for c in CHANNELS}, float(opt.fs)).drop("blk"), "samples")
    ref = recordings.read_reference_csv(spark, f"{folder}/*_ref.csv")
    ref = ref.withColumn("sample_id", F.regexp_replace("sample_id", "_ref$", ""))
    return Recordings(samples, materialise(ref, "reference"), pairs, unpaired, verdicts, count)


def aligned_base(rec: Recordings, opt: BatchOptions, fs: int) -> tuple[Layout, DataFrame, DataFrame, DataFrame]:
    """Resampled layout, segments, delays and motion frequencies; shared by all trials with this rate."""
    rows = rec.samples
    if fs != opt.fs:
        lay = _relay(rows, rec.rows, opt, "resample")
        parts = [filtering.resample(lay, c, opt.fs, fs).select(*KEY, F.col("j").alias("i"), c) for c in CHANNELS]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.join(part, [*KEY, "i"])
    rows = rows.withColumn("mag", F.sqrt(F.expr("accx * accx + accy * accy + accz * accz")))
    layout = _relay(rows, rec.rows, opt, f"fs{fs}")
    _, segs = segments.activity_segments(layout, "mag", float(fs), opt.rest.tw_s, 1.0, opt.calibration_s)
    segs = materialise(segs, "segments")
    candidates = alignment.rest_candidates(layout, segs, float(fs), opt.rest, "ppg_green", "accz")
    scores = materialise(alignment.delay_scores(alignment.rest_rates(candidates, KEY, float(fs), opt.rest), rec.reference, KEY, opt.rest), "scores")
    delays = materialise(alignment.best_delays(scores, KEY, opt.rest), "delays")
    return layout, segs, delays, scores


def windows_of(rec: Recordings, base: tuple, fs: int, tw_s: float) -> DataFrame:
    """Normalised windows of one (rate, length); shared by all trials with that pair."""
    layout, segs, delays, _ = base
    moved = segs.join(delays.select(*KEY, "delay"), KEY).select(
        *KEY, "status",
        F.greatest(F.lit(0.0), F.col("start_s") - F.col("delay")).alias("start_s"),
        F.greatest(F.lit(0.0), F.col("start_s") - F.col("delay"), F.col("end_s") - F.col("delay")).alias("end_s"),
    )
    hz = alignment.motion_frequency(layout, moved, ["accx", "accy", "accz"], float(fs))
    wins = alignment.training_windows(layout, segs, delays, rec.reference, CHANNELS, float(fs), tw_s, motion=hz)
    return materialise(wins, "windows")


def uniform_trials(spark: SparkSession, opt: BatchOptions) -> DataFrame:
    """Seeded uniform trials of every mode within its budget."""
    rows = []
    for kind in opt.filters:
        for trial in experiment.sample_trials(kind, *opt.most(), opt.random_state, opt.overrides):
            for scope in opt.scopes:
                for scheme in opt.schemes:
                    most, repeats = opt.budget(scheme)
                    if trial["trial_idx"] < most and trial["repeat_idx"] < repeats:
                        mode = {"target_scope": scope, "cascade_scheme": scheme, "adaptive_filter": kind}
                        seed = experiment.stable_hash_of({**trial, "mode": "__".join(mode.values()), "random_state": opt.random_state})
                        rows.append({**trial, **mode, "delay_mode": opt.delay_mode, "rff_seed": seed})
    return trials.trial_frame(spark, rows)


def groups_of(rec: Recordings) -> DataFrame:
    return rec.pairs.select(F.col("stem").alias("sample_id"), "motion_type", "motion_index", F.col("motion_id").alias("group_id"))


def gaps_of(rec: Recordings, base: tuple, windows: DataFrame) -> DataFrame:
    """``sample_id, stage, reason`` of every good recording that has no windows: the first stage it does not pass."""
    _, segs, delays, _ = base
    good = rec.verdicts.where("status = 'good'").select(*KEY)
    known = rec.reference.where("hr IS NOT NULL").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_ref"))
    rows = good.join(segs.select(*KEY, F.col("status").alias("found"), F.col("reason").alias("why")), KEY, "left").join(known, KEY, "left")
    rows = rows.join(delays.select(*KEY, "delay"), KEY, "left").join(windows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), KEY, "left")
    fault = lambda stage, reason: F.struct(F.lit(stage).alias("stage"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    first = (
        F.when(~F.coalesce(F.col("found") == "ok", F.lit(False)), fault("segments", F.coalesce("why", F.lit("no samples"))))
        .when(F.coalesce("n_ref", F.lit(0)) < 2, fault("reference", "fewer than two reference values"))
        .when(F.col("delay").isNull(), fault("delay", "no delay with two valid windows"))
        .when(F.col("n").isNull(), fault("windows", "no window with a reference value"))
    )
    return rows.select(*KEY, first.alias("f")).where("f IS NOT NULL").select(*KEY, "f.*")


def stages_of(tried: DataFrame) -> dict[str, list[str]]:
    """Trials of one motion type meet the recordings of that type only."""
    typed = ["motion_type"] if "motion_type" in tried.columns else []
    return {**trials.STAGES, "windows": [*typed, *trials.STAGES["windows"]]}


def all_windows(rec: Recordings, opt: BatchOptions, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows of every (rate, length) in use, of which the search space has nine, and who has none and why."""
    bases: dict = {}
    parts, gaps = [], []
    keyed = nodes.select("windows_id", "Fs_Target", "TW", *[c for c in nodes.columns if c == "motion_type"])
    types = groups_of(rec).select(*KEY, "motion_type")
    for fs, tw in sorted({(int(r["Fs_Target"]), float(r["TW"])) for r in nodes.select("Fs_Target", "TW").distinct().collect()}):
        if fs not in bases:
            bases[fs] = aligned_base(rec, opt, fs)
        own = keyed.where((F.col("Fs_Target") == fs) & (F.col("TW") == tw)).drop("Fs_Target", "TW")
        if "motion_type" in own.columns:
            own = types.join(own, "motion_type").drop("motion_type")
        else:
            own = types.select(*KEY).withColumn("windows_id", F.lit(own.first()["windows_id"]).cast("long"))
        windows = windows_of(rec, bases[fs], fs, tw)
        parts.append(windows.join(own, KEY))
        gaps.append(gaps_of(rec, bases[fs], windows).join(own, KEY))
    whole, missing = parts[0], gaps[0]
    for part, gap in zip(parts[1:], gaps[1:]):
        whole, missing = whole.unionByName(part), missing.unionByName(gap)
    return whole, materialise(missing, "missing")


@dataclass(frozen=True)
class Evaluation:
    """Sums per trial, mode and recording; why a recording has none for a trial, or for all of a rate and length."""

    sums: DataFrame
    failures: DataFrame
    missing: DataFrame
    tried: DataFrame


IDS = ["motion_type", *MODE, "heldout_group_id", "study", "repeat_idx", "trial_idx"]


def evaluate(rec: Recordings, opt: BatchOptions, tried: DataFrame | None = None) -> Evaluation:
    """``sums`` hold ``n, abs_sum, hits`` of the adaptive and baseline rate, ``failures`` a ``reason``.

    ``tried`` are trials as rows of ``trials.trial_frame``; the seeded uniform ones by default.  With a
    ``motion_type`` they are evaluated on its recordings only.  Equal parameter tuples are worked off once,
    see ``operators.trials``.
    """
    tried = uniform_trials(rec.samples.sparkSession, opt) if tried is None else tried
    tried, nodes = trials.graph(tried, stages_of(tried))
    windows, missing = all_windows(rec, opt, nodes["windows"])
    spectra = materialise(trials.spectra_of(windows, nodes, KEY, CHANNELS), "spectra")
    base = materialise(trials.baselines(windows, nodes, KEY), "baselines")
    sums = trials.smoothed_sums(trials.tracked(spectra, base, nodes, KEY), nodes, KEY)
    failed = materialise(trials.failures(spectra, nodes, KEY), "failed")
    names = tried.select(*[c for c in IDS if c in tried.columns], "smooth_id")
    known = groups_of(rec)
    by = [*KEY, *[c for c in names.columns if c == "motion_type"]]
    meet = lambda part, label: materialise(names.join(part, "smooth_id").join(known, by).drop("smooth_id"), label)
    sums = sums.join(failed, [*KEY, "smooth_id"], "left_anti")
    lost = missing.join(nodes["windows"].select("windows_id", "Fs_Target", "TW"), "windows_id").select(*KEY, "Fs_Target", "TW", "stage", "reason").distinct()
    return Evaluation(meet(sums, "trial-sums"), meet(failed, "trial-failures"), materialise(lost, "lost"), tried.drop("smooth_id"))


def studies_of(rec: Recordings, opt: BatchOptions) -> DataFrame:
    """One search per motion type, fold, mode and repeat, with its budget of trials."""
    good = rec.verdicts.where("status = 'good'").select(*KEY).join(groups_of(rec), KEY)
    if opt.split_mode == "leave_one_group_out":
        folds = good.select("motion_type", F.col("group_id").alias("heldout_group_id"))
        several = good.groupBy("motion_type").count().where("count > 1").select("motion_type")
        folds = folds.join(several, "motion_type", "left_semi")
    else:
        folds = good.select("motion_type", F.lit("").alias("heldout_group_id")).distinct()
    each = lambda names: F.explode(F.array(*[F.lit(n) for n in names]))
    rows = folds.withColumn("target_scope", each(opt.scopes)).withColumn("cascade_scheme", each(opt.schemes)).withColumn("adaptive_filter", each(opt.filters))
    budget = lambda i: F.coalesce(*[F.when(F.col("cascade_scheme") == s, F.lit(opt.budget(s)[i])) for s in opt.schemes])
    rows = rows.withColumn("repeat_idx", F.explode(F.sequence(F.lit(0), budget(1) - 1))).withColumn("n_trials", budget(0))
    return rows.withColumn("study", F.concat_ws("|", "motion_type", *MODE, "heldout_group_id", "repeat_idx"))


def learned_evaluation(rec: Recordings, opt: BatchOptions) -> Evaluation:
    """Trials in generations: each learns from the objective of all before it, in all studies at once."""
    spark = rec.samples.sparkSession
    studies = materialise(studies_of(rec, opt), "studies")
    space = materialise(sampler.space_frame(spark, opt.filters), "space")
    limit = {c: F.lit(v).cast(trials.TYPES[c]) for c, v in opt.overrides.items() if c in trials.TYPES}
    draws, done, history = None, [], None
    for first in range(0, opt.most()[0], opt.generation):
        if draws is None:
            new = sampler.uniform(studies, space, first, opt.generation, opt.random_state)
        else:
            known = materialise(sampler.densities(history, draws, space), "densities")
            new = sampler.propose(studies, space, known, first, opt.generation, opt.random_state)
        new = materialise(new.join(studies.select("study", "n_trials"), "study").where("trial < n_trials").drop("n_trials"), "draws")
        rows = sampler.decode(new, trials.TYPES).withColumns(limit).join(studies.drop("n_trials"), "study")
        seed = experiment.stable_hash(F.concat_ws("|", F.lit(str(opt.random_state)), "study", "trial"))
        rows = rows.withColumns({"delay_mode": F.lit(opt.delay_mode), "rff_seed": seed}).withColumnRenamed("trial", "trial_idx")
        done.append(evaluate(rec, opt, trials.only_used(rows)))
        values = fold_table(done[-1].sums, opt).select("study", F.col("trial_idx").alias("trial"), F.col("objective_value").alias("value"))
        past = lambda old, more: more if old is None else old.unionByName(more)
        draws, history = past(draws, new), materialise(past(history, values), "history")
    union = lambda name: functools.reduce(DataFrame.unionByName, [getattr(d, name) for d in done])
    return Evaluation(union("sums"), union("failures"), union("missing").distinct(), union("tried"))


def fold_table(sums: DataFrame, opt: BatchOptions, groups: DataFrame | None = None) -> DataFrame:
    """Per motion type, mode, trial and fold: error on the objective set and on the test set.

    ``groups(motion_type, group_id, motion_index)`` are all groups that have folds; one without sums (its
    recording failed) still is a fold and has no test error.
    """
    by = [c for c in IDS if c in sums.columns]
    names = ["n", "abs_sum", "hits", "base_sum", "base_hits"]
    if groups is not None:
        every = sums.select(*by).distinct().join(groups, "motion_type")
        sums = every.join(sums.select(*by, "group_id", *names), [*by, "group_id"], "left").fillna(0, names)
    totals = [F.sum(c).alias(f"all_{c}") for c in names]
    whole = sums.groupBy(*by).agg(*totals, F.count(F.lit(1)).alias("n_groups"))
    out = F.col("heldout_group_id") if "heldout_group_id" in by else F.lit("").alias("heldout_group_id")
    rest = [c for c in by if c != "heldout_group_id"]
    if opt.split_mode == "all_train":
        fold = whole.select(*rest, out, *[F.col(f"all_{c}").alias(f"train_{c}") for c in names],
                            *[F.col(f"all_{c}").alias(f"test_{c}") for c in names], F.lit("").alias("reason"))
    elif opt.split_mode == "leave_one_group_out":
        few = F.when(F.col("n_groups") < 2, "fewer than two good recordings").otherwise("")
        held = sums.where("group_id = heldout_group_id") if "heldout_group_id" in by else sums
        fold = held.join(whole, by).select(
            *rest, F.col("group_id").alias("heldout_group_id"), *[(F.col(f"all_{c}") - F.col(c)).alias(f"train_{c}") for c in names],
            *[F.col(c).alias(f"test_{c}") for c in names], few.alias("reason"),
        )
    else:
        known = (sums if groups is None else groups).select("motion_type", "group_id", "motion_index").distinct()
        plan = materialise(experiment.split_groups(known, opt.val_groups, opt.test_groups, opt.random_state), "split")
        parts = sums.join(plan.select("motion_type", "group_id", "split"), ["motion_type", "group_id"])
        pick = lambda s, c: F.sum(F.when(F.col("split") == s, F.col(c)))
        fold = parts.groupBy(*by).agg(
            *[pick("val", c).alias(f"train_{c}") for c in names], *[pick("test", c).alias(f"test_{c}") for c in names],
            F.when(F.bool_or(F.col("split") == "failed"), "too few good recordings").otherwise("").alias("reason"),
        ).withColumn("heldout_group_id", out)
    rate = lambda part, c, scale: F.col(f"{part}_{c}") * scale / F.nullif(F.col(f"{part}_n"), F.lit(0))
    value = metrics.objective(rate("train", "abs_sum", 1.0), rate("train", "hits", 100.0), F.lit(opt.objective))
    return fold.withColumns({
        "objective_value": F.when(F.col("reason") == "", value),
        "test_aae": rate("test", "abs_sum", 1.0),
        "test_acc": rate("test", "hits", 100.0),
    })


def first_three(rows: DataFrame, by: list[str], order: list[str], text: str, out: str) -> DataFrame:
    """The first three texts of each group in order, joined by ``; ``: three rows a group are ever collected."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    few = rows.withColumn("_p", place).where("_p <= 3")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_p", F.col(text).alias("x")))), lambda s: s["x"])
    return few.groupBy(*by).agg(F.array_join(listed, "; ").alias(out))


def summarise(
    sums: DataFrame, opt: BatchOptions, groups: DataFrame | None = None, reasons: Callable[[DataFrame], DataFrame] | None = None
) -> dict[str, DataFrame]:
    """History, best trial per fold, and one complete row per motion type and mode.

    ``reasons`` gives, for the best trials, ``motion_type, MODE, heldout_group_id, group_id, motion_index, reason``
    of every recording that failed in them: a mode succeeds if none of its test recordings did.
    """
    spark = sums.sparkSession
    folds = materialise(fold_table(sums, opt, groups), "folds")
    by = ["motion_type", *MODE, "heldout_group_id"]
    history = experiment.best_so_far(folds, by)
    best = materialise(experiment.winning_trial(folds.where("objective_value IS NOT NULL"), by), "best")
    tested = metrics.objective(F.col("test_aae"), F.col("test_acc"), F.lit(opt.objective))
    done = best.groupBy("motion_type", *MODE).agg(
        (F.sum("test_abs_sum") / F.nullif(F.sum("test_n"), F.lit(0))).alias("adaptive_aae"),
        (F.sum("test_hits") * 100.0 / F.nullif(F.sum("test_n"), F.lit(0))).alias("adaptive_acc"),
        (F.sum("test_base_sum") / F.nullif(F.sum("test_n"), F.lit(0))).alias("baseline_aae"),
        (F.sum("test_base_hits") * 100.0 / F.nullif(F.sum("test_n"), F.lit(0))).alias("baseline_acc"),
        F.sum("test_n").alias("n_valid"),
        F.min_by("heldout_group_id", F.struct(F.round(tested, 9), "heldout_group_id")).alias("representative_group"),
    )
    if reasons is None:
        why = done.select("motion_type", *MODE).withColumn("failed", F.lit("")).limit(0)
    else:
        own = (F.col("group_id") == F.col("heldout_group_id")) | (F.col("heldout_group_id") == "")
        why = materialise(first_three(reasons(best).where(own), ["motion_type", *MODE], ["motion_index", "group_id"], "reason", "failed"), "reasons")
    types = F.explode(F.array(*[F.lit(m) for m in experiment.MOTION_TYPES])).alias("motion_type")
    dim = experiment.modes(spark, opt.scopes, opt.schemes, opt.filters).select(types, "*")
    complete = dim.join(done, ["motion_type", *MODE], "left").join(why, ["motion_type", *MODE], "left").withColumns({
        "success": F.col("n_valid").isNotNull() & F.col("failed").isNull(),
        "reason": F.coalesce("failed", F.when(F.coalesce("n_valid", F.lit(0)) == 0, "no evaluated recordings").otherwise("")),
        "objective_mode": F.lit(opt.objective),
        "data_split_mode": F.lit(opt.split_mode),
        "n_trials": F.lit(opt.n_trials),
        "n_repeats": F.lit(opt.n_repeats),
        "result_level": F.lit("aggregate" if opt.split_mode == "leave_one_group_out" else "single_split"),
        "aggregation": F.lit("logo_window_concat" if opt.split_mode == "leave_one_group_out" else ""),
        "params_semantics": F.lit("representative_fold_best_params_not_global" if opt.split_mode == "leave_one_group_out" else "best_params_for_this_split"),
    }).drop("failed")
    return {"history": history, "best_params": best, "mode_summary": complete, "final_summary": final_rows(complete)}


def final_rows(complete: DataFrame) -> DataFrame:
    """One row per mode and metric; the post-hoc ones where the table has them."""
    known = {"aae": "adaptive_aae", "accuracy": "adaptive_acc", "posthoc_aae": "posthoc_aae", "posthoc_accuracy": "posthoc_acc"}
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(c).alias("metric_value")) for m, c in known.items() if c in complete.columns]
    return complete.select("*", F.inline(F.array(*pairs)))


def failed_recordings(rec: Recordings, done: Evaluation) -> Callable[[DataFrame], DataFrame]:
    """For ``summarise``: reasons of the recordings that failed under the best trials."""

    def reasons(best: DataFrame) -> DataFrame:
        ids = [c for c in IDS if c in done.tried.columns and c in best.columns]
        chosen = best.select("motion_type", *MODE, "heldout_group_id", *[c for c in ids if c not in ("motion_type", *MODE, "heldout_group_id")])
        rated = chosen.join(done.tried.select(*ids, "Fs_Target", "TW"), ids)
        columns = ["motion_type", *MODE, "heldout_group_id", "group_id", "motion_index", "reason"]
        early = rated.join(done.missing.join(groups_of(rec), KEY), ["motion_type", "Fs_Target", "TW"]).select(*columns)
        late = chosen.join(done.failures.select(*dict.fromkeys([*ids, "motion_type"]), "group_id", "motion_index", "reason"), [*dict.fromkeys([*ids, "motion_type"])]).select(*columns)
        return early.unionByName(late)

    return reasons


def recording_table(rec: Recordings, done: Evaluation) -> DataFrame:
    """Every paired recording with its status and, unless it was evaluated, the reason."""
    lost = done.missing.groupBy(*KEY).agg(F.min_by("reason", F.struct("Fs_Target", "TW")).alias("lost"))
    kernel = done.failures.groupBy(*KEY).agg(F.min("reason").alias("kernel"))
    rows = groups_of(rec).join(rec.verdicts.select(*KEY, F.col("status").alias("verdict"), F.col("reason").alias("why")), KEY, "left").join(lost, KEY, "left").join(kernel, KEY, "left")
    good = F.coalesce(F.col("verdict") == "good", F.lit(False))
    status = F.when(~good, "failed_quality").when(F.col("lost").isNotNull(), "failed_preprocess").when(F.col("kernel").isNotNull(), "failed_some_trials").otherwise("ok")
    reason = F.when(~good, F.coalesce("why", F.lit("no verdict"))).otherwise(F.coalesce("lost", "kernel", F.lit("")))
    return rows.select("motion_type", "group_id", "motion_index", F.col("sample_id").alias("sample"), status.alias("status"), reason.alias("reason"))


def batch_summary(table: DataFrame, target: str) -> DataFrame:
    """One row per motion type with good recordings and one per failed recording."""
    ok = table.where("status IN ('ok', 'failed_some_trials')")
    listed = first_three(ok, ["motion_type"], ["motion_index", "group_id"], "group_id", "sample").join(ok.groupBy("motion_type").count(), "motion_type")
    place = lambda name: F.concat(F.lit(f"{target}/{name}/motion_type="), F.col("motion_type"))
    types = listed.select(
        "motion_type", F.concat("sample", F.when(F.col("count") > 3, "; ...").otherwise("")).alias("sample"),
        F.lit("ok").alias("status"), F.lit("").alias("reason"), place("split_files").alias("split"), place("mode_summary").alias("result_csv"), place("best_params").alias("report_json"),
    )
    failed = table.where("status LIKE 'failed_%' AND status <> 'failed_some_trials'").select("motion_type", "sample", "status", "reason")
    return types.unionByName(failed, allowMissingColumns=True)


def split_files(rec: Recordings, opt: BatchOptions, good: DataFrame) -> DataFrame:
    """Folds by file.  Of a leave-one-out fold the test group is named; ``*`` stands for all other groups of the
    type, as the full list of members would grow with the square of the groups."""
    files = rec.pairs.select(F.col("motion_id").alias("group_id"), F.element_at(F.split("file_path", "/"), -1).alias("data_file"), F.element_at(F.split("ref_path", "/"), -1).alias("ref_file"))
    if opt.split_mode == "leave_one_group_out":
        folds = experiment.leave_one_out_folds(good).withColumn("ok", F.col("status") == "ok")
        kinds = F.when(F.col("ok"), F.array(F.lit("train"), F.lit("test"))).otherwise(F.array(F.lit("failed")))
        rows = folds.withColumn("split", F.explode(kinds)).withColumn("group_id", F.when(F.col("split") == "test", F.col("heldout_group_id")).when(F.col("split") == "train", "*").otherwise(""))
        rows = rows.withColumn("reason", F.when(F.col("ok"), "").otherwise("fewer than two good recordings"))
    elif opt.split_mode == "all_train":
        rows = good.withColumn("split", F.explode(F.array(F.lit("train"), F.lit("test"))))
    else:
        rows = experiment.split_groups(good, opt.val_groups, opt.test_groups, opt.random_state)
    lacking = {c: F.lit(v) for c, v in {"fold_id": 0, "heldout_group_id": "", "reason": ""}.items() if c not in rows.columns}
    return rows.withColumns(lacking).join(files, "group_id", "left").select(*sinks.SPLIT_COLUMNS)


def winners(tables: dict[str, DataFrame], done: Evaluation) -> DataFrame:
    """The best trial of every fold with all its parameters, as trials of its motion type."""
    ids = [c for c in IDS if c in done.tried.columns]
    best = tables["best_params"].select("motion_type", *MODE, "heldout_group_id", "repeat_idx", "trial_idx")
    return best.join(done.tried.select(*ids, *trials.TYPES, "delay_mode"), [c for c in ids if c in best.columns])


def evaluate_fully(rec: Recordings, opt: BatchOptions, chosen: DataFrame) -> DataFrame:
    """Window results of the winning trials alone, with what every filter stage used.

    The trials run through the same graph; ``role`` says whether the recording is the fold's test or training.
    """
    tried, nodes = trials.graph(chosen, stages_of(chosen))
    windows, _ = all_windows(rec, opt, nodes["windows"])
    spectra = materialise(trials.spectra_of(windows, nodes, KEY, CHANNELS, full=True), "spectra-full")
    rates = trials.tracked(spectra, trials.baselines(windows, nodes, KEY), nodes, KEY)
    rows = trials.smoothed_rates(rates, nodes, KEY).join(trials.lineage(nodes).select("smooth_id", "spectrum_id", "windows_id"), "smooth_id")
    rows = rows.join(windows.select(*KEY, "windows_id", "w", "center_s", "label"), [*KEY, "windows_id", "w"])
    rows = rows.join(spectra.where("reason = ''").select(*KEY, "spectrum_id", "w", "stages"), [*KEY, "spectrum_id", "w"])
    named = tried.select("motion_type", *MODE, "heldout_group_id", "repeat_idx", "trial_idx", "smooth_id")
    rows = named.join(rows, "smooth_id").join(groups_of(rec), [*KEY, "motion_type"])
    if opt.split_mode == "split":
        plan = experiment.split_groups(good_groups(rec), opt.val_groups, opt.test_groups, opt.random_state).select("motion_type", "group_id", F.col("split").alias("role"))
        rows = rows.join(plan, ["motion_type", "group_id"])
    else:
        rows = rows.withColumn("role", F.when((F.col("heldout_group_id") == "") | (F.col("group_id") == F.col("heldout_group_id")), "test").otherwise("train"))
    return materialise(rows.select(*sinks.WINDOW_COLUMNS, "stages"), "winner-windows")


def good_groups(rec: Recordings) -> DataFrame:
    return rec.verdicts.where("status = 'good'").select(*KEY).join(groups_of(rec), KEY).select("motion_type", "group_id", "motion_index")


def posthoc(full: DataFrame, rec: Recordings) -> tuple[DataFrame, DataFrame]:
    """Errors after the best time bias of each test recording: per recording, and per motion type and mode.

    A mode reports its bias if all its recordings have the same.
    """
    by = ["motion_type", *MODE, "heldout_group_id", "group_id"]
    inside = full.where("in_scope AND role = 'test'")
    sums = redraw.bias_sums(inside, rec.reference, KEY, by, redraw.bias_grid())
    each = materialise(redraw.best_bias(sums, [*KEY, *by]), "posthoc")
    n = F.nullif(F.sum("n"), F.lit(0))
    kinds = F.count_distinct(F.round("bias_s", 10))
    modes = each.groupBy("motion_type", *MODE).agg(
        (F.sum("abs_sum") / n).alias("posthoc_aae"), (F.sum("hits") * 100.0 / n).alias("posthoc_acc"),
        (F.sum("base_sum") / n).alias("posthoc_baseline_aae"), (F.sum("base_hits") * 100.0 / n).alias("posthoc_baseline_acc"),
        F.sum("n").cast("long").alias("posthoc_n_valid_windows"), F.when(kinds == 1, F.min("bias_s")).alias("time_bias_after_s"),
        F.when(kinds == 1, "posthoc_oracle_alignment").otherwise("per_run_posthoc_oracle_alignment").alias("time_bias_after_mode"),
    )
    return each, modes


def run_batch(spark: SparkSession, folder: str, output: str, root: str, opt: BatchOptions) -> dict[str, DataFrame]:
    """Run everything and write the result tables below ``output``, which must lie below ``root``."""
    target = sinks.safe_output(output, root, [folder])
    rec = prepare(spark, folder, opt)
    done = learned_evaluation(rec, opt) if opt.sampler == "learning" else evaluate(rec, opt)
    tables = summarise(done.sums, opt, good_groups(rec), failed_recordings(rec, done))
    chosen = materialise(winners(tables, done), "winners")
    full = evaluate_fully(rec, opt, chosen)
    each, modes = posthoc(full, rec)
    tables["mode_summary"] = materialise(tables["mode_summary"].join(modes, ["motion_type", *MODE], "left"), "mode-summary")
    tables["final_summary"] = final_rows(tables["mode_summary"])
    number = F.create_map(*[x for c in trials.TYPES for x in (F.lit(c), F.col(c).cast("double"))])
    params = F.map_filter(number, lambda k, v: v.isNotNull()).alias("params")
    keys = ["motion_type", *MODE, "heldout_group_id", "repeat_idx", "trial_idx"]
    tables["best_params"] = tables["best_params"].join(chosen.select(*keys, params), keys)
    tables |= {"windows": full, "posthoc": each, "recordings": materialise(recording_table(rec, done), "recordings")}
    tables["batch_summary"] = batch_summary(tables["recordings"], target)
    write_tables(rec, opt, tables, target)
    return tables


def write_tables(rec: Recordings, opt: BatchOptions, tables: dict[str, DataFrame], target: str) -> None:
    """Result tables as CSV with fixed columns; stages of the winners as JSON."""
    files = rec.pairs.select(
        F.col("stem").alias("sample_id"), F.col("motion_id").alias("group_id"), "motion_type", "motion_index",
        F.element_at(F.split("file_path", "/"), -1).alias("data_file"), F.element_at(F.split("ref_path", "/"), -1).alias("ref_file"),
    )
    shares = {f"outlier_ratio_ut{c}": F.col(f"outliers{c}") / float(round(10 * opt.fs)) for c in (1, 2)}
    renamed = {"std1": "std_ut1", "std2": "std_ut2", "outliers1": "outlier_count_ut1", "outliers2": "outlier_count_ut2"}
    checked = files.join(rec.verdicts, "sample_id").withColumns({**shares, "file_name": F.col("data_file"), "is_good": F.col("status") == "good"}).withColumnsRenamed(renamed)
    for status in ("good", "bad"):
        sinks.write_csv(checked.where(F.col("status") == status), f"{target}/qc/{status}_samples", columns=sinks.QC_COLUMNS)
    sinks.write_csv(rec.unpaired, f"{target}/qc/unpaired_samples", columns=["file_name", "file_path", "reason"])
    sinks.write_csv(files, f"{target}/qc/motion_type_samples", columns=sinks.SAMPLE_COLUMNS)
    sinks.write_csv(rec.verdicts.groupBy("status").count(), f"{target}/qc/summary", one_file=True)
    sinks.write_csv(split_files(rec, opt, good_groups(rec)).withColumn("type", F.col("motion_type")), f"{target}/split_files", by=["type"])
    sinks.write_csv(tables["recordings"], f"{target}/recordings")
    sinks.write_csv(tables["batch_summary"], f"{target}/batch_summary", columns=sinks.BATCH_COLUMNS)
    for name in ("history", "best_params", "mode_summary"):
        sinks.write_csv(tables[name], f"{target}/{name}", by=["motion_type"])
    sinks.write_csv(tables["posthoc"], f"{target}/per_group", by=["motion_type"])
    sinks.write_csv(tables["windows"], f"{target}/windows", columns=sinks.WINDOW_COLUMNS, by=["motion_type"])
    sinks.json_safe(tables["windows"].select("motion_type", *MODE, "heldout_group_id", "sample_id", "w", "stages")).write.mode("overwrite").json(f"{target}/stages")
    for scope in experiment.SCOPES:
        for metric in sinks.FINAL_METRICS:
            rows = tables["final_summary"].where((F.col("target_scope") == scope) & (F.col("metric") == metric))
            sinks.write_csv(rows, f"{target}/final_summary/{scope}_test_{metric}", columns=sinks.FINAL_COLUMNS, one_file=True)


def redraw_best(rec: Recordings, opt: BatchOptions, params: dict, scope: str, scheme: str, kind: str, saved: DataFrame) -> DataFrame:
    """Full-length rate curve of every recording for one parameter row.

    ``saved(sample_id, saved_bias)`` holds biases of earlier runs; the others are searched again.
    """
    fs, tw = int(params["Fs_Target"]), float(params["TW"])
    wins = windows_of(rec, aligned_base(rec, opt, fs), fs, tw)
    done = materialise(protocol.run_trial(wins, KEY, float(fs), params, scheme, scope, kind, tw_s=tw), "redraw")
    plain = wins.select(*KEY, "w", (protocol.plain_rate("ppg_green", float(fs)) * 60.0).alias("fft_hr"))
    found = redraw.posthoc_bias(done, rec.reference, KEY).select(*KEY, F.col("bias_s").alias("found_bias"))
    biases = done.select(*KEY).distinct().join(found, KEY, "left").join(saved, KEY, "left")
    return redraw.global_rates(done.join(plain, [*KEY, "w"]), biases, rec.reference, KEY)
