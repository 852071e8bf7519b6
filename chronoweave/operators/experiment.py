"""Search space, trials, folds and result tables of the batch experiment."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions.columns import rounded
from chronoweave.operators.series import index_rows

# Names and candidates of the experiment.
MOTION_TYPES = ["bobi", "fuwo", "kaihe", "tiaosheng", "wanju"]
SCOPES = ["motion_only", "motion_recovery", "motion_post10"]
SCHEMES = ["ACC3", "HF2", "CF2", "HF2_CF2", "CF2_HF2", "ACC3_HF2", "HF2_ACC3"]
FILTERS = ["lms", "volterra", "rff_lms"]
SEARCH_SPACE = {
    "Fs_Target": [25, 50, 100],
    "TW": [6, 8, 10],
    "Kstop": [0.2, 0.3, 0.5],
    "max_order": [8, 12, 16, 20],
    "M_base": [1, 2],
    "C_scale": [0.6, 0.9, 1.2, 1.5],
    "K_max": [8, 12, 16, 20, 30],
    "Spec_Penalty_Width": [0.1, 0.2, 0.3],
    "Spec_Penalty_Weight": [0.1, 0.2, 0.4],
    "smooth_win_len": [3, 5, 7, 9],
    "hr_range_hz": [15 / 60, 20 / 60, 25 / 60, 30 / 60, 35 / 60, 40 / 60],
    "slew_limit_bpm": [8, 9, 10, 11, 12, 13, 14, 15],
    "slew_step_bpm": [5, 7, 9],
    "LMS_Mu_Base": [0.008, 0.01, 0.012],
    "RFF_LMS_Mu_Base": [0.006, 0.008, 0.01],
    "alpha_u": [0.01, 0.05, 0.1, 0.2],
    "M2": [2, 3, 4, 5],
    "rff_D": [50, 100, 200, 300],
    "rff_sigma": [0.1, 0.5, 1.0, 2.0, 5.0],
}
FILTER_EXTRAS = {
    "lms": ["LMS_Mu_Base"],
    "volterra": ["LMS_Mu_Base", "alpha_u", "M2"],
    "rff_lms": ["RFF_LMS_Mu_Base", "rff_D", "rff_sigma"],
}
DEFAULT_TRIALS = {"n_trials": 350, "n_repeats": 3, "random_state": 42}


def names_for_filter(adaptive_filter: str) -> list[str]:
    if adaptive_filter not in FILTER_EXTRAS:
        raise ValueError(f"unknown adaptive filter: {adaptive_filter}")
    common = list(SEARCH_SPACE)[:13]
    return common + FILTER_EXTRAS[adaptive_filter]


def decode_trial(adaptive_filter: str, index: dict[str, int], overrides: dict | None = None) -> dict:
    """Candidate values for option indices; an index outside its list or an unknown override is an error."""
    values = {}
    for name in names_for_filter(adaptive_filter):
        options = SEARCH_SPACE[name]
        if not 0 <= index[name] < len(options):
            raise IndexError(f"index {index[name]} out of range for {name}")
        values["LMS_Mu_Base" if name == "RFF_LMS_Mu_Base" else name] = options[index[name]]
    unknown = set(overrides or {}) - (set(SEARCH_SPACE) | {"adaptive_filter", "objective_mode"})
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    values.update(overrides or {})
    return values


def sample_trials(adaptive_filter: str, n_trials: int, n_repeats: int, random_state: int, overrides: dict | None = None) -> list[dict]:
    """Seeded uniform draws, one generator per repeat; the trial list is small by definition."""
    trials = []
    for repeat in range(n_repeats):
        rng = np.random.default_rng(random_state + repeat)
        for trial in range(n_trials):
            index = {n: int(rng.integers(0, len(SEARCH_SPACE[n]))) for n in names_for_filter(adaptive_filter)}
            trials.append({"repeat_idx": repeat, "trial_idx": trial, **decode_trial(adaptive_filter, index, overrides)})
    return trials


def trials_frame(spark: SparkSession, trials: list[dict]) -> DataFrame:
    """Trials as rows ``(repeat_idx, trial_idx, params MAP<STRING, DOUBLE>)``."""
    rows = [
        (t["repeat_idx"], t["trial_idx"], {k: float(v) for k, v in t.items() if k not in ("repeat_idx", "trial_idx")})
        for t in trials
    ]
    return spark.createDataFrame(rows, "repeat_idx int, trial_idx int, params map<string,double>")


def modes(spark: SparkSession, scopes=SCOPES, schemes=SCHEMES, filters=FILTERS) -> DataFrame:
    """Scope x scheme x filter as nested explodes of three short literal lists."""
    lists = [F.array(*[F.lit(x) for x in xs]) for xs in (scopes, schemes, filters)]
    return (
        spark.range(1)
        .select(F.explode(lists[0]).alias("target_scope"))
        .select("target_scope", F.explode(lists[1]).alias("cascade_scheme"))
        .select("target_scope", "cascade_scheme", F.explode(lists[2]).alias("adaptive_filter"))
    )


def run_name(scopes: Column, schemes: Column, filters: Column, objective: Column, split: Column) -> Column:
    return F.concat_ws("__", scopes, schemes, filters, objective, split)


def stable_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256, modulo 2^32."""
    digits = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (digits % F.lit(4294967296).cast("decimal(20,0)")).cast("long")


def stable_hash_of(payload: dict) -> int:
    """Driver-side twin of ``stable_hash`` for parameter dictionaries (sorted-key JSON)."""
    import hashlib

    text = json.dumps(payload, sort_keys=True, ensure_ascii=False, default=str)
    return int(hashlib.sha256(text.encode("utf-8")).hexdigest()[:16], 16) % 2**32


def split_groups(groups: DataFrame, val_groups: int, test_groups: int, seed: int) -> DataFrame:
    """Shuffle the groups of each motion type by a seeded hash: test, then val, the rest train.

    ``groups(motion_type, group_id, ...)``.  The position comes from a distributed row index, so a
    motion type may hold any number of groups.  Types with too few groups get split ``failed``.
    """
    key = F.concat_ws("|", F.lit(str(seed)), F.col("motion_type"), F.col("group_id"))
    shuffled, _ = index_rows(groups.withColumn("_h", stable_hash(key)), ["motion_type"], ["_h", "group_id"], derived=True)
    sizes = groups.groupBy("motion_type").agg(F.count(F.lit(1)).alias("_n"))
    split = (
        F.when(F.col("_n") - val_groups - test_groups < 1, "failed")
        .when(F.col("i") < test_groups, "test")
        .when(F.col("i") < test_groups + val_groups, "val")
        .otherwise("train")
    )
    return shuffled.join(sizes, "motion_type").withColumn("split", split).drop("_h", "_n").withColumnRenamed("i", "position")


def leave_one_out_folds(groups: DataFrame) -> DataFrame:
    """One fold per group: the fold id is the group's position in its motion type.

    The training set of a fold is every group of the type but the held-out one; it is kept as that
    rule and as a count, never as the quadratic list of (fold, member) pairs.
    """
    ordered, _ = index_rows(groups, ["motion_type"], ["motion_index", "group_id"], derived=True)
    sizes = groups.groupBy("motion_type").agg(F.count(F.lit(1)).alias("_n"))
    return ordered.join(sizes, "motion_type").select(
        "motion_type",
        F.col("i").alias("fold_id"),
        F.col("group_id").alias("heldout_group_id"),
        (F.col("_n") - 1).alias("n_train"),
        F.when(F.col("_n") < 2, "failed").otherwise("ok").alias("status"),
    )


def leave_one_out_metrics(windows: DataFrame, by: list[str], group: str, err: str) -> DataFrame:
    """Train and test error of every leave-one-out fold.

    Sums over the training groups are the type's sums minus the held-out group's sums, so each
    window is read once however many folds there are.  ``windows`` holds windows in scope.
    """
    e = F.round(err, 9)
    own = windows.groupBy(*by, group).agg(
        F.count(e).alias("n"), F.sum(F.abs(e)).alias("s"), F.count_if(F.abs(e) <= 5.0).alias("h")
    )
    total = own.groupBy(*by).agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.sum("h").alias("all_h"))
    joined = own.join(total, by)
    left = F.nullif(F.col("all_n") - F.col("n"), F.lit(0))
    mine = F.nullif(F.col("n"), F.lit(0))
    return joined.select(
        *by,
        group,
        (F.col("s") / mine).alias("test_aae"),
        (F.col("h") * 100.0 / mine).alias("test_acc"),
        F.col("n").alias("n_test"),
        ((F.col("all_s") - F.col("s")) / left).alias("train_aae"),
        ((F.col("all_h") - F.col("h")) * 100.0 / left).alias("train_acc"),
        (F.col("all_n") - F.col("n")).alias("n_train"),
    )


def best_so_far(history: DataFrame, by: list[str], value: str = "objective_value") -> DataFrame:
    """Running best over the trials of one mode, in (repeat, trial) order; trials are few by definition."""
    w = Window.partitionBy(*by).orderBy("repeat_idx", "trial_idx").rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("best_so_far", F.min(value).over(w))


def winning_trial(history: DataFrame, by: list[str], value: str = "objective_value") -> DataFrame:
    """Earliest trial with the smallest objective."""
    packed = F.struct(*[F.col(c) for c in history.columns if c not in by])
    best = history.groupBy(*by).agg(F.min_by(packed, F.struct(F.round(value, 9), "repeat_idx", "trial_idx")).alias("_b"))
    return best.select(*by, "_b.*")


def posthoc_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Error after the per-run time bias.  One common bias is reported, several are not averaged.

    Distinct biases are found through a partial aggregation per bias, so no row set is collected.
    """
    b = F.round("bias", 10)
    per = rows.groupBy(*by, b.alias("bias")).agg(
        F.sum(F.abs("err_after")).alias("s"), F.count("err_after").alias("n")
    )
    kinds = F.count("bias")
    return per.groupBy(*by).agg(
        F.when(kinds == 1, F.min("bias")).alias("time_bias_s"),
        F.when(kinds == 0, "").when(kinds == 1, "posthoc_oracle_alignment").otherwise("per_run_posthoc_oracle_alignment").alias("mode"),
        rounded(F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("posthoc_aae"),
        F.sum("n").alias("n_valid"),
    )
