"""Reading and writing recordings as files."""

from __future__ import annotations

import pathlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import experiment, qc
from chronoweave.operators.recording import clean_recording
from chronoweave.sources import pairing, recordings, sinks

HEADER = "Time(s)," + ",".join(recordings.SENSOR_COLUMNS)


def sensor_text(n: int, header: str = HEADER) -> str:
    lines = [header]
    for i in range(n):
        row = [0.0, 1.0 + i % 5, 2.0, 3.0 + i % 5, 5.0, np.sin(i / 7), np.cos(i / 5), i % 3, 0.1, 0.2, 1.0, i, -i, 0.0]
        lines.append(",".join("bad" if (i == 4 and j == 5) else f"{v:.6f}" for j, v in enumerate(row)))
    return "\n".join(lines) + "\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    (root / "multi_kaihe01.csv").write_text("﻿" + sensor_text(3000), encoding="utf-8")
    (root / "multi_bobi2.csv").write_text(sensor_text(50), encoding="utf-8")
    (root / "multi_yoga3.csv").write_text(sensor_text(5), encoding="utf-8")
    wide = "Name,Sport,Date,Start time,Duration,Total,Average heart rate (bpm)\nx,run,d,10:00:00,1,2,99\n"
    rows = "".join(f",{n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d},{60 + n % 7},,\n" for n in range(90))
    (root / "multi_kaihe01_ref.csv").write_text(wide + "Sample rate,Time,HR (bpm),Speed,Pace\n" + rows, encoding="utf-8")
    (root / "multi_fuwo9_ref.csv").write_text("seconds,hr\n" + "5,80\n3,70\n5,99\nx,1\n4,\n", encoding="utf-8")
    (root / "multi_wanju4_ref.csv").write_text("a,b,c\n1,2,3\n2,3,4\n", encoding="utf-8")
    (root / "sub").mkdir()
    (root / "sub" / "multi_bobi7.csv").write_text("x\n", encoding="utf-8")
    return str(root)


def test_pairing(spark, folder):
    pairs, unpaired = pairing.pair_files(pairing.list_csv(spark, folder))
    got = [(r.motion_id, r.motion_type, r.motion_index, r.stem) for r in pairs.collect()]
    assert got == [("kaihe1", "kaihe", 1, "multi_kaihe01")]
    reasons = {r.file_name: r.reason for r in unpaired.collect()}
    assert reasons["multi_bobi2.csv"] == "missing reference file multi_bobi2_ref.csv"
    assert reasons["multi_yoga3.csv"].startswith("sensor name must match")
    assert reasons["multi_fuwo9_ref.csv"] == "missing sensor file multi_fuwo9.csv"
    assert len(reasons) == 4


def test_sensor_csv_keeps_file_order(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")  # several splits of one file
    try:
        rows = recordings.read_sensor_csv(spark, [f"{folder}/multi_kaihe01.csv", f"{folder}/multi_bobi2.csv"]).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    big = rows[rows.sample_id == "multi_kaihe01"].sort_values("i")
    assert len(rows) == 3050 and (big.gyrox.to_numpy()[:3] == [0, 1, 2]).all() and (big.i == range(3000)).all()
    np.testing.assert_allclose(big.gyrox, np.arange(3000))
    assert np.isnan(big.ppg_green.iloc[4]) and big.t.iloc[150] == 1.5


def test_missing_column_names_the_file(spark, tmp_path):
    (tmp_path / "multi_bobi1.csv").write_text(sensor_text(3, HEADER.replace("AccX(g)", "Other")), encoding="utf-8")
    with pytest.raises(Exception, match="multi_bobi1 lacks columns"):
        recordings.read_sensor_csv(spark, str(tmp_path / "multi_bobi1.csv")).collect()


def test_reference_layouts(spark, folder):
    got = recordings.read_reference_csv(spark, f"{folder}/*_ref.csv").toPandas().sort_values(["sample_id", "t"])
    kaihe = got[got.sample_id == "multi_kaihe01_ref"]
    assert kaihe.t.tolist() == list(range(90)) and kaihe.hr.tolist() == [60 + n % 7 for n in range(90)]
    fuwo = got[got.sample_id == "multi_fuwo9_ref"]
    assert list(zip(fuwo.t, fuwo.hr)) == [(3.0, 70.0), (5.0, 80.0)]
    wanju = got[got.sample_id == "multi_wanju4_ref"]
    assert list(zip(wanju.t, wanju.hr)) == [(2.0, 3.0), (3.0, 4.0)]


def test_clean_recording_and_quality(spark, folder):
    rows = recordings.read_sensor_csv(spark, f"{folder}/multi_*[0-9].csv")
    lay = recordings.sensor_layout(rows.where("sample_id <> 'multi_yoga3'"), block_rows=500, halo=120)
    clean = clean_recording(lay, 100)
    assert clean.count() == 3050
    bad = clean.select([F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in clean.columns if c not in ("sample_id", "blk", "i")])
    assert sum(bad.first()) == 0
    verdict = {r.sample_id: r for r in qc.quality(lay, "hf1", "hf2", 500).collect()}
    assert verdict["multi_bobi2"].reason == "fewer samples than the quality prefix"
    t, x = np.arange(500), 3.0 + np.arange(500) % 5
    res = x - np.polyval(np.polyfit(t / 100, x, 4), t / 100)
    assert verdict["multi_kaihe01"].std1 == pytest.approx(res.std(), abs=1e-9)
    assert verdict["multi_kaihe01"].reason == "STD ratio above limit"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1, 2]), (2, 3.5, [])], "id int, x double, a array<int>")
    out = sinks.safe_output(f"{tmp_path}/outputs/run", f"{tmp_path}/outputs")
    sinks.write_csv(df, out, one_file=True)
    assert spark.read.csv(out, header=True).orderBy("id").collect()[0].asDict() == {"id": "1", "x": None, "a": "[1,2]"}
    sinks.write_csv(df.where("false"), out, columns=["id", "missing"], one_file=True)
    assert spark.read.csv(out, header=True).columns == ["id", "missing"]
    assert sinks.as_json(df, "id").orderBy("id").first().json == '{"x":null,"a":[1,2]}'
    for bad in (f"{tmp_path}/outputs", f"{tmp_path}/other", f"{tmp_path}/outputs/../x"):
        with pytest.raises(ValueError):
            sinks.safe_output(bad, f"{tmp_path}/outputs")
    with pytest.raises(ValueError, match="overwrite"):
        sinks.safe_output(f"{tmp_path}/outputs/a", f"{tmp_path}/outputs", [f"{tmp_path}/outputs/a/keep"])


def test_experiment_parts(spark):
    trials = experiment.sample_trials("volterra", 4, 2, 42, {"TW": 8})
    assert len(trials) == 8 and all(t["TW"] == 8 for t in trials) and trials == experiment.sample_trials("volterra", 4, 2, 42, {"TW": 8})
    assert "M2" in trials[0] and "rff_D" not in trials[0]
    with pytest.raises(ValueError, match="unknown parameters"):
        experiment.sample_trials("lms", 1, 1, 0, {"nope": 1})
    with pytest.raises(IndexError):
        experiment.decode_trial("lms", {n: 99 for n in experiment.names_for_filter("lms")})
    assert experiment.modes(spark).count() == 63
    text = '{"a": 1}'
    row = spark.range(1).select(experiment.stable_hash(F.lit(text)).alias("h")).first()
    assert row.h == experiment.stable_hash_of({"a": 1})
    groups = spark.createDataFrame([("bobi", n, f"bobi{n}") for n in range(12)] + [("fuwo", 0, "fuwo0")], "motion_type string, motion_index int, group_id string")
    split = experiment.split_groups(groups, 2, 3, 1).groupBy("motion_type", "split").count().collect()
    assert {(r[0], r[1]): r[2] for r in split} == {("bobi", "test"): 3, ("bobi", "val"): 2, ("bobi", "train"): 7, ("fuwo", "failed"): 1}
    folds = experiment.leave_one_out_folds(groups).toPandas()
    assert sorted(folds[folds.motion_type == "bobi"].fold_id) == list(range(12))
    assert folds[folds.motion_type == "fuwo"].status.tolist() == ["failed"]


def test_quoted_fields(spark):
    rows = [(0, 'a,"b,c",d'), (1, '" x ""y"" ",,3'), (2, "1, 2 ,")]
    got = spark.createDataFrame(rows, "i int, value string").select("i", recordings._fields(F.col("value")).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == [["a", "b,c", "d"], ['x "y"', "", "3"], ["1", "2", ""]]


def test_empty_partitioned_csv_has_a_header(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([], "kind string, value double"), str(tmp_path / "out"), by=["kind"])
    texts = [p.read_text() for p in (tmp_path / "out").glob("*.csv")]
    assert texts == ["kind,value\n"]


def test_params_keep_file_order(spark, tmp_path):
    for name, n in (("a.csv", 1), ("b.csv", 400)):  # the longer file is listed first
        (tmp_path / name).write_text("mode,test_aae,params\n" + "".join(f"{name}{i:03d},,{{}}\n" for i in range(n)))
    rows = [r.mode for r in sinks.read_params(spark, str(tmp_path)).orderBy("row_id").collect()]
    assert rows == ["a.csv000"] + [f"b.csv{i:03d}" for i in range(400)]


def test_time_slice_of_a_clustered_table_skips_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select((F.col("id") % 20).alias("rec"), (F.col("id") / 2000.0).alias("time_s"), F.rand(1).alias("x"))
    path = f"{tmp_path}/samples"
    sinks.write_samples(rows, path, ["rec"], "time_s", rows_per_file=50_000, group_bytes=20_000)
    part = sinks.time_slice(spark.read.parquet(path).where("rec = 7"), 40.0, 45.0)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time_s,40.0)" in plan and "LessThanOrEq" in plan.split("PushedFilters")[1]
    times = [r.time_s for r in part.orderBy("time_s").collect()]
    want = [r.time_s for r in rows.where("rec = 7 AND time_s BETWEEN 40 AND 45").orderBy("time_s").collect()]
    assert times == want and len(want) > 400
    touched = total = 0
    for file in pathlib.Path(path).glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(3)}
            total += 1
            touched += stats["rec"].min <= 7 <= stats["rec"].max and stats["time_s"].min <= 45.0 and stats["time_s"].max >= 40.0
    assert len(list(pathlib.Path(path).glob("*.parquet"))) == 4 and 0 < touched < total / 4


def test_score_map(spark):
    rows = spark.createDataFrame([("a", -1.0, 2.5), ("a", 0.1, 1.5), ("a", 0.2, None), ("b", 0.1, 4.0), ("c", 0.1, None)], "rec string, delay double, aae double")
    got = {r.rec: r.scores for r in sinks.score_map(rows, ["rec"], "delay", "aae").collect()}
    assert got == {"a": {-1.0: 2.5, 0.1: 1.5}, "b": {0.1: 4.0}, "c": {}}
