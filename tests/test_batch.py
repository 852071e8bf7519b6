"""Folder of synthetic CSV recordings through the whole batch experiment."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators.alignment import RestOptions
from chronoweave.operators import experiment, protocol, redraw
from chronoweave.plans import batch
from chronoweave.plans.batch import BatchOptions, evaluate, prepare, redraw_best, run_batch, summarise
from chronoweave.sources import recordings, sinks

FS = 20
OPT = BatchOptions(
    fs=FS, schemes=("HF2",), n_trials=2, n_repeats=1, overrides={"Fs_Target": FS, "TW": 8}, rest=RestOptions(delay_step_s=0.5), block_rows=1500, halo=400,
)


def write_recording(root, name: str, lag: float, moving: bool = True):
    rng = np.random.default_rng(sum(map(ord, name)))
    n = 150 * FS
    t = np.arange(n) / FS
    rate = lambda s: 75 + 8 * np.sin(2 * np.pi * s / 40)
    beat = np.cumsum(rate(t - lag)) / 60 / FS
    swing = np.where((t >= 75) & (t < 105) & moving, np.sin(2 * np.pi * 2.6 * t), 0.0)
    noise = lambda s=0.01: s * rng.normal(size=n)
    cols = [3 + swing + noise(), 3 + noise(), 8 + swing + noise(), 8 + 0.5 * swing + noise()]
    cols += [np.sin(2 * np.pi * beat) + 0.8 * swing + noise() for _ in range(3)]
    cols += [0.5 * swing + noise(0.001), 0.2 * swing + noise(0.001), 1 + noise(0.001), noise(), noise(), noise()]
    lines = [",".join(recordings.SENSOR_COLUMNS)] + [",".join(f"{v:.5f}" for v in row) for row in zip(*cols)]
    (root / f"{name}.csv").write_text("\n".join(lines) + "\n")
    ref = ["time,hr"] + [f"{s},{rate(s):.3f}" for s in range(151)]
    (root / f"{name}_ref.csv").write_text("\n".join(ref) + "\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("rec")
    for name, lag in (("multi_bobi1", 1.0), ("multi_bobi2", 0.0), ("multi_fuwo1", 2.0)):
        write_recording(root, name, lag)
    write_recording(root, "multi_wanju1", 0.0, moving=False)
    for n, text in ((1, "a,b\n1,2\n"), (2, ""), (3, ",".join(recordings.SENSOR_COLUMNS) + "\n")):
        (root / f"multi_kaihe{n}.csv").write_text(text)
        (root / f"multi_kaihe{n}_ref.csv").write_text("time,hr\n0,60\n1,61\n")
    (root / "multi_walk1.csv").write_text("a\n")
    return root


@pytest.fixture(scope="module")
def rec(spark, folder):
    return prepare(spark, str(folder), OPT)


@pytest.fixture(scope="module")
def done(rec):
    return evaluate(rec, OPT)


@pytest.fixture(scope="module")
def sums(done):
    return done.sums


def test_budgets():
    from dataclasses import replace

    opt = replace(OPT, schemes=("HF2", "CF2"), budgets={"CF2": (1, 3)})
    assert opt.budget("HF2") == (2, 1) and opt.budget("CF2") == (1, 3) and opt.most() == (2, 3)


def test_prepare(rec):
    verdicts = {r.sample_id: (r.status, r.reason) for r in rec.verdicts.collect()}
    assert verdicts["multi_kaihe1"][0] == "bad" and verdicts["multi_kaihe1"][1].startswith("missing required columns")
    assert verdicts["multi_kaihe2"] == verdicts["multi_kaihe3"] == ("bad", "sensor file has no samples")
    assert [verdicts[f"multi_{g}"] for g in ("bobi1", "bobi2", "fuwo1", "wanju1")] == [("good", "ok")] * 4
    assert rec.samples.groupBy("sample_id").count().toPandas()["count"].tolist() == [3000] * 4


def test_trials_and_folds(sums):
    pdf = sums.toPandas()
    assert len(pdf) == 2 * 3 and (pdf.n > 20).all()
    tables = summarise(sums, OPT)
    folds = tables["best_params"].toPandas()
    assert sorted(folds.heldout_group_id) == ["bobi1", "bobi2"]
    for row in folds.itertuples():
        others = pdf[(pdf.motion_type == "bobi") & (pdf.group_id != row.heldout_group_id)]
        score = others.groupby("trial_idx").apply(lambda g: g.abs_sum.sum() / g.n.sum(), include_groups=False)
        assert row.trial_idx == score.idxmin() and row.objective_value == pytest.approx(score.min())
    summary = tables["mode_summary"].toPandas().set_index("motion_type")
    assert len(summary) == 5 and summary.success.to_dict()["bobi"] and not summary.success.to_dict()["fuwo"]
    assert summary.adaptive_aae["bobi"] == pytest.approx(folds.test_abs_sum.sum() / folds.test_n.sum())
    history = tables["history"].toPandas()
    ordered = history[history.heldout_group_id == "bobi1"].sort_values("trial_idx")
    assert (ordered.best_so_far == ordered.objective_value.cummin()).all()


@pytest.mark.parametrize("mode", ["all_train", "split"])
def test_other_split_modes(sums, mode):
    from dataclasses import replace

    summary = summarise(sums, replace(OPT, split_mode=mode, val_groups=0))["mode_summary"].toPandas().set_index("motion_type")
    assert bool(summary.success["bobi"]) and len(summary) == 5


def test_every_recording_has_a_status_and_a_reason(rec, done):
    rows = {r["sample"]: (r.status, r.reason) for r in batch.recording_table(rec, done).collect()}
    assert len(rows) == 7 and rows["multi_bobi1"] == rows["multi_fuwo1"] == ("ok", "")
    assert rows["multi_kaihe1"][0] == "failed_quality" and rows["multi_kaihe1"][1].startswith("missing required columns")
    assert rows["multi_kaihe2"] == rows["multi_kaihe3"] == ("failed_quality", "sensor file has no samples")
    assert rows["multi_wanju1"] == ("failed_preprocess", "no rest to motion transition")
    assert {r.file_name for r in rec.unpaired.where("file_path IS NOT NULL").collect()} == {"multi_walk1.csv"}


def test_failed_recordings_keep_their_fold_and_reason(spark, sums):
    groups = spark.createDataFrame([("bobi", f"bobi{n}", n) for n in range(1, 7)] + [("fuwo", "fuwo1", 1)], "motion_type string, group_id string, motion_index int")
    def reasons(best):
        wide = best.join(groups.where("motion_index > 2"), "motion_type").where("heldout_group_id = group_id")
        return wide.select("motion_type", *batch.MODE, "heldout_group_id", "group_id", "motion_index", F.concat(F.lit("broken "), "group_id").alias("reason"))

    tables = summarise(sums, OPT, groups, reasons)
    folds = {r.heldout_group_id: r for r in tables["best_params"].where("motion_type = 'bobi'").collect()}
    assert len(folds) == 6 and folds["bobi5"].test_n == 0 and folds["bobi5"].train_n == folds["bobi1"].train_n + folds["bobi1"].test_n
    row = {r.motion_type: r for r in tables["mode_summary"].collect()}
    assert not row["bobi"].success and row["bobi"].reason == "broken bobi3; broken bobi4; broken bobi5"
    assert row["bobi"].n_valid == folds["bobi1"].test_n + folds["bobi2"].test_n and row["bobi"].adaptive_aae is not None


@pytest.fixture(scope="module")
def ran(spark, folder, tmp_path_factory, rec, done):
    root, patch = tmp_path_factory.mktemp("out"), pytest.MonkeyPatch()
    patch.setattr(batch, "prepare", lambda *a: rec)
    patch.setattr(batch, "evaluate", lambda *a: done)
    tables = run_batch(spark, str(folder), f"{root}/outputs/run1", f"{root}/outputs", OPT)
    patch.undo()
    return f"{root}/outputs/run1", tables


def test_output_tables(spark, folder, ran):
    out, _ = ran
    read = lambda name: spark.read.csv(f"{out}/{name}", header=True)
    for scope in experiment.SCOPES:
        for metric in sinks.FINAL_METRICS:
            table = read(f"final_summary/{scope}_test_{metric}")
            assert table.columns == sinks.FINAL_COLUMNS and table.count() == (5 if scope == "motion_recovery" else 0)
    found = read("final_summary/motion_recovery_test_posthoc_aae").where("motion_type = 'bobi'").first()
    assert 0 < float(found.metric_value) < 20 and found.success == "true"
    assert read("qc/bad_samples").columns == sinks.QC_COLUMNS and read("qc/bad_samples").count() == 3
    assert read("qc/motion_type_samples").columns == sinks.SAMPLE_COLUMNS and read("qc/motion_type_samples").count() == 7
    split = read("split_files")
    assert split.columns[:-1] == sinks.SPLIT_COLUMNS and {(r.motion_type, r.split) for r in split.collect()} == {("bobi", "train"), ("bobi", "test"), ("fuwo", "failed"), ("wanju", "failed")}
    summary = {(r.motion_type, r.status): r for r in read("batch_summary").collect()}
    assert read("batch_summary").columns == sinks.BATCH_COLUMNS and summary["bobi", "ok"]["sample"] == "bobi1; bobi2" and summary["wanju", "failed_preprocess"].reason == "no rest to motion transition"
    assert read("best_params").where("params LIKE '%Kstop%'").count() == 2
    rows = sinks.read_params(spark, f"{out}/best_params")
    asked = spark.createDataFrame([("motion_recovery", "HF2", "lms"), ("motion_only", "CF2", "lms")], "target_scope string, cascade_scheme string, adaptive_filter string")
    got = {r.cascade_scheme: r for r in sinks.pick_params(asked, rows, ["target_scope", "cascade_scheme", "adaptive_filter"], "test_aae").collect()}
    assert got["HF2"].matched and got["HF2"].params["TW"] == 8.0 and not got["CF2"].matched and got["CF2"].params["TW"] == 8.0
    assert got["HF2"].test_aae == min(r.test_aae for r in rows.collect())
    stages = spark.read.json(f"{out}/stages").where("size(stages) = 2").first()
    assert stages.stages[0].sensor_type == "HF" and stages.stages[0].channel in ("hf1", "hf2")
    with pytest.raises(ValueError):
        run_batch(spark, str(folder), str(folder), str(folder), OPT)


def test_winners_are_evaluated_fully(spark, rec, ran):
    """Window results of the winners equal single runs, and their errors the sums that made them win."""
    _, tables = ran
    full = tables["windows"].toPandas()
    assert sorted(full.heldout_group_id.unique()) == ["bobi1", "bobi2"] and set(full.role) == {"train", "test"}
    best = {r.heldout_group_id: r for r in tables["best_params"].collect()}
    base = batch.aligned_base(rec, OPT, FS)
    wins = batch.windows_of(rec, base, FS, 8.0)
    for fold, row in best.items():
        params = {k: int(v) if v == int(v) and k not in ("TW",) else v for k, v in row.params.items()} | {"delay_estimation_mode": OPT.delay_mode}
        one = protocol.run_trial(wins, ["sample_id"], float(FS), params, "HF2", "motion_recovery", "lms", tw_s=8.0).toPandas()
        part = full[full.heldout_group_id == fold].merge(one, on=["sample_id", "w"], suffixes=("", "_one"))
        assert len(part) == (full.heldout_group_id == fold).sum()
        assert np.allclose(part.adaptive_hr, part.adaptive_hr_one, equal_nan=True) and np.allclose(part.baseline_hr, part.baseline_hr_one, equal_nan=True)
        mine = part[(part.role == "test") & part.in_scope]
        assert (mine.adaptive_hr - mine.ref_hr).abs().mean() == pytest.approx(row.test_aae)


def test_posthoc_bias_in_vectors_of_sums(spark, rec, ran):
    """The same biases and errors as copies of the points at every bias."""
    _, tables = ran
    inside = tables["windows"].where("in_scope AND role = 'test'")
    found = {r.sample_id: r for r in tables["posthoc"].collect()}
    plain = redraw.posthoc_bias(inside, rec.reference, ["sample_id"]).collect()
    assert len(plain) == len(found) == 2
    for r in plain:
        assert (found[r.sample_id].bias_s, found[r.sample_id].n) == (r.bias_s, r.bias_n_valid)
    row = tables["mode_summary"].where("motion_type = 'bobi'").first()
    total, n = (sum(r[c] for r in found.values()) for c in ("abs_sum", "n"))
    assert row.posthoc_aae == pytest.approx(total / n) and row.posthoc_aae <= row.adaptive_aae + 1e-9


def test_learning_search(spark, rec):
    from dataclasses import replace

    opt = replace(OPT, sampler="learning", n_trials=3, generation=2)
    done = batch.learned_evaluation(rec, opt)
    rows = done.sums.toPandas()
    assert sorted(rows.trial_idx.unique()) == [0, 1, 2] and sorted(rows.heldout_group_id.unique()) == ["bobi1", "bobi2"] and len(rows) == 2 * 3 * 2
    best = summarise(done.sums, opt, batch.good_groups(rec))["best_params"].toPandas()
    for row in best.itertuples():
        own = rows[(rows.heldout_group_id == row.heldout_group_id) & (rows.group_id != row.heldout_group_id)]
        scores = own.groupby("trial_idx").apply(lambda g: g.abs_sum.sum() / g.n.sum(), include_groups=False)
        assert row.trial_idx == scores.idxmin() and row.objective_value == pytest.approx(scores.min())


def test_redraw(spark, rec, tmp_path):
    params = experiment.sample_trials("lms", 1, 1, 42, OPT.overrides)[0]
    saved = spark.createDataFrame([("multi_bobi1", 2.0)], "sample_id string, saved_bias double")
    got = redraw_best(rec, OPT, params, "motion_recovery", "HF2", "lms", saved)
    pdf = got.groupBy("sample_id", "time_bias_after_source").agg(F.min("time_bias_after_s").alias("b"), F.count("w").alias("n"), F.avg("abs_err_after_bpm").alias("e")).toPandas().set_index("sample_id")
    assert pdf.loc["multi_bobi1"].tolist()[:2] == ["saved_best_params", 2.0]
    assert pdf.loc["multi_fuwo1", "time_bias_after_source"] == "computed_during_redraw" and (pdf.n > 100).all() and pdf.e["multi_bobi2"] < 12
    sinks.write_global_rates(got, f"{tmp_path}/curves", ["sample_id"])
    back = spark.read.csv(f"{tmp_path}/curves", header=True)
    assert back.columns == [*sinks.GLOBAL_HR_COLUMNS, "sample_id"] and back.count() == pdf.n.sum()
