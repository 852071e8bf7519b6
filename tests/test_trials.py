"""Trials as rows: stages shared among trials, checked against single runs; failing kernels give reasons."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import protocol, trials
from chronoweave.operators.metrics import HIT_BPM
from chronoweave.plans import batch
from chronoweave.plans.batch import KEY, evaluate, prepare
from tests.test_batch import FS, OPT, write_recording

MODES = replace(OPT, schemes=("HF2", "ACC3_HF2"), filters=("lms", "rff_lms"), scopes=("motion_only", "motion_recovery"), budgets={"ACC3_HF2": (1, 1)})


@pytest.fixture(scope="module")
def rec(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("trials")
    for name, lag in (("multi_bobi1", 1.0), ("multi_fuwo1", 2.0)):
        write_recording(root, name, lag)
    return prepare(spark, str(root), MODES)


def counted(spark, rec, opt):
    """An evaluation and the number of Spark jobs it took."""
    group = f"trials-{opt.n_trials}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        done = evaluate(rec, opt)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return done, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.fixture(scope="module")
def many(spark, rec):
    patch = pytest.MonkeyPatch()
    patch.setattr(trials, "UNIT", 2)
    result = counted(spark, rec, MODES)
    patch.undo()
    return result


def test_tuples_are_shared(spark):
    rows = [dict(target_scope=s, cascade_scheme=c, adaptive_filter="lms", delay_mode="direct", repeat_idx=0, trial_idx=t, Fs_Target=25, TW=6, Kstop=0.2, smooth_win_len=w, rff_seed=t)
            for s in ("motion_only", "motion_recovery") for c in ("HF2", "CF2") for t, w in enumerate((3, 5, 3))]
    tried, nodes = trials.graph(trials.trial_frame(spark, rows))
    assert {k: n.count() for k, n in nodes.items()} == {"windows": 1, "delays": 1, "cascade": 2, "spectrum": 2, "track": 4, "smooth": 8}
    assert tried.count() == 12 and tried.select("smooth_id").distinct().count() == 8
    assert tried.where("trial_idx IN (0, 2)").groupBy("target_scope", "cascade_scheme").agg(F.count_distinct("smooth_id").alias("n")).where("n <> 1").count() == 0


def test_sums_equal_single_runs(spark, rec, many):
    done, _ = many
    got = {(r.target_scope, r.cascade_scheme, r.adaptive_filter, r.trial_idx, r.sample_id): r for r in done.sums.collect()}
    assert len(got) == 2 * 2 * (2 + 1) * 2 and done.failures.count() == 0
    base = batch.aligned_base(rec, MODES, FS)
    wins = batch.windows_of(rec, base, FS, 8.0)
    compared = [t for t in batch.uniform_trials(spark, MODES).collect() if t.target_scope == "motion_recovery" or t.adaptive_filter == "lms" and t.trial_idx == 0]
    assert len(compared) == 8
    for t in compared:
        params = {k: v for k, v in t.asDict().items() if v is not None} | {"delay_estimation_mode": t.delay_mode}
        one = protocol.run_trial(wins, KEY, float(FS), params, t.cascade_scheme, t.target_scope, t.adaptive_filter, tw_s=8.0).where("in_scope").toPandas()
        for sample, part in one.groupby("sample_id"):
            row = got[t.target_scope, t.cascade_scheme, t.adaptive_filter, t.trial_idx, sample]
            error, plain = (np.round(np.abs(part[c] - part.ref_hr), 9) for c in ("adaptive_hr", "baseline_hr"))
            assert (row.n, row.hits, row.base_hits) == (len(part), (error <= HIT_BPM).sum(), (plain <= HIT_BPM).sum())
            assert row.abs_sum == pytest.approx(error.sum(), abs=1e-6) and row.base_sum == pytest.approx(plain.sum(), abs=1e-6)


def test_a_failing_kernel_gives_a_reason_for_its_recording_only(spark, rec):
    few = batch.uniform_trials(spark, replace(MODES, filters=("lms",), scopes=("motion_only",), schemes=("HF2",)))
    tried, nodes = trials.graph(few)
    windows, missing = batch.all_windows(rec, MODES, nodes["windows"])
    assert missing.count() == 0
    short = F.when(F.col("sample_id") == "multi_fuwo1", F.slice("hf1", 1, 7)).otherwise(F.col("hf1"))
    spectra = trials.spectra_of(windows.withColumn("hf1", short), nodes, KEY, batch.CHANNELS)
    failed = trials.failures(spectra, nodes, KEY).collect()
    assert {r.sample_id for r in failed} == {"multi_fuwo1"} and len(failed) == 2 and all("Error" in r.reason for r in failed)
    whole = spectra.where("reason = ''").groupBy("sample_id").count().collect()
    assert [r.sample_id for r in whole] == ["multi_bobi1"] and whole[0]["count"] > 40


def test_the_number_of_jobs_does_not_follow_the_trials(spark, rec, many):
    _, few = counted(spark, rec, replace(MODES, n_trials=1, filters=("lms",), schemes=("HF2",), scopes=("motion_only",)))
    assert 0 < many[1] <= few * 1.3 + 8
