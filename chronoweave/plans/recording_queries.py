"""Registered queries: file pairing, CSV parsing, cleaning and quality control of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.columns import rounded
from chronoweave.operators import qc
from chronoweave.operators.recording import clean_legacy, clean_recording, raw_recording
from chronoweave.plans.series_queries import LINEAR, NEAREST, OUTLIER_SQL, SERIES_SQL, _bracket
from chronoweave.plans.tables import event_series, table
from chronoweave.sources import pairing, recordings

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# --- pairing: customers stand for recordings, every sixth has an unknown type -----------------------

KINDS = ["bobi", "fuwo", "kaihe", "tiaosheng", "wanju", "yoga"]

FILES_SQL = """WITH n AS (SELECT c_custkey AS id, 'multi_' || (['bobi', 'fuwo', 'kaihe', 'tiaosheng', 'wanju', 'yoga'])[CAST(c_custkey % 6 + 1 AS INTEGER)] || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS stem FROM customer),
s AS (SELECT id, stem, id % 6 <> 5 AS legal FROM n WHERE id % 7 <> 0),
r AS (SELECT id, stem FROM n WHERE id % 4 <> 0)
"""


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (key % 6 + 1).cast("int"))
    stem = F.concat(F.lit("multi_"), kind, F.lpad(key.cast("string"), 8, "0"))
    stems = F.array_compact(F.array(F.when(key % 7 != 0, stem), F.when(key % 4 != 0, F.concat(stem, F.lit("_ref")))))
    names = table(spark, sf_dir, "customer").select(F.explode(stems).alias("stem"))
    name = F.concat("stem", F.lit(".csv"))
    return names.select(F.concat(F.lit("/data/"), name).alias("file_path"), name.alias("file_name"), "stem")


@register(
    "pair_discovery",
    FILES_SQL
    + """SELECT regexp_extract(s.stem, '_([a-z]+)', 1) || CAST(s.id AS VARCHAR) AS motion_id, regexp_extract(s.stem, '_([a-z]+)', 1) AS motion_type,
       s.id AS motion_index, s.stem, '/data/' || s.stem || '.csv' AS file_path, '/data/' || s.stem || '_ref.csv' AS ref_path
     FROM s JOIN r USING (id) WHERE legal""",
)
def pair_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pair_files(file_names(spark, sf_dir))[0]


@register(
    "unpaired_files",
    FILES_SQL
    + """SELECT stem || '.csv' AS file_name, CASE WHEN NOT legal THEN 'sensor name must match multi_<motion_type><index>.csv with motion_type in bobi, fuwo, kaihe, tiaosheng, wanju'
         ELSE 'missing reference file ' || stem || '_ref.csv' END AS reason FROM s WHERE NOT legal OR id NOT IN (SELECT id FROM r)
       UNION ALL SELECT stem || '_ref.csv', 'missing sensor file ' || stem || '.csv' FROM r WHERE id NOT IN (SELECT id FROM s WHERE legal)""",
)
def unpaired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pair_files(file_names(spark, sf_dir))[1]


# --- CSV text of the events ---------------------------------------------------------------------


def _with_header(lay_core: DataFrame, header_lines: list[str], text) -> DataFrame:
    """Numbered CSV lines per user: header lines first, then one line per event."""
    heads = F.array(*[F.struct(F.lit(n).cast("long").alias("i"), F.lit(h).alias("value")) for n, h in enumerate(header_lines)])
    head = lay_core.where("i = 0").select(F.col("user_id").cast("string").alias("sample_id"), F.inline(heads))
    body = lay_core.select(
        F.col("user_id").cast("string").alias("sample_id"), (F.col("i") + len(header_lines)).alias("i"), text.alias("value")
    )
    return head.unionByName(body)


def sensor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = event_series(spark, sf_dir).core()
    v, k = F.col("value").cast("string"), F.col("k").cast("string")
    total = (F.col("value") + (F.col("k") - 50.0)).cast("string")
    bad = F.when(F.col("event_type") == "view", "bad").otherwise(v)
    text = F.concat_ws(",", F.lit("0"), v, k, total, F.coalesce(F.col("reading").cast("string"), F.lit("")), bad, v, k, v, F.lit("1.0"), k, v, k, v)
    names = ["Time(s)", "Uc1(mV)", "Uc2(mV)", "Ut1(mV)", "PPG_Green", "PPG_Red", "PPG_IR", "AccX(g)", "AccY(g)", "AccZ(g)", "GyroX(dps)", "GyroY(dps)", "GyroZ(dps)", "Ut2(mV)"]
    return _with_header(core, ["﻿" + ",".join(names)], text)


@register(
    "sensor_csv_parse",
    SERIES_SQL
    + """SELECT CAST(user_id AS VARCHAR) AS sample_id, i, round(i / 100.0, 6) AS t, value AS uc1, k AS uc2, round(value + (k - 50), 6) + 0.0 AS hf1, value AS hf2,
       reading AS ppg_green, CASE WHEN event_type <> 'view' THEN value END AS ppg_red, value AS ppg_ir, k AS accx, value AS accy, 1.0::DOUBLE AS accz,
       k AS gyrox, value AS gyroy, k AS gyroz FROM e""",
)
def sensor_csv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recordings.parse_sensor_lines(sensor_lines(spark, sf_dir))
    return rows.withColumn("t", rounded(F.col("t"))).withColumn("hf1", rounded(F.col("hf1")))


@register(
    "reference_csv_parse",
    SERIES_SQL
    + """SELECT CAST(user_id AS VARCHAR) AS sample_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS t,
       arg_min(reading, i) AS hr FROM e WHERE reading IS NOT NULL GROUP BY ALL""",
)
def reference_csv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = event_series(spark, sf_dir).core()
    text = F.concat_ws(",", F.lit(""), F.date_format("ts", "HH:mm:ss"), F.coalesce(F.col("reading").cast("string"), F.lit("")), F.lit(""))
    summary = ["Name,Sport,Date,Start time,Average heart rate (bpm)", "x,run,2024-01-01,10:00:00,70", "Sample rate,Time,HR (bpm),Speed (km/h)"]
    return recordings.parse_reference_lines(_with_header(core, summary, text))


# --- cleaning and quality -----------------------------------------------------------------------

CLEAN_SQL = (
    SERIES_SQL
    + _bracket("reading").replace(", b AS (", ", b0 AS (")
    + f", fl AS (SELECT user_id, event_id, event_type, value, k, t, i, coalesce(reading, {LINEAR}, {NEAREST}) AS reading FROM b0)"
    + OUTLIER_SQL.replace("FROM e)", "FROM fl)")
    + _bracket("kept", "kept").replace(", b AS (", ", bg AS (")
    + f", green AS (SELECT user_id, i, CASE WHEN any_out THEN coalesce(kept, {LINEAR}, {NEAREST}) ELSE reading END AS ppg_green FROM bg)"
    + ", r1 AS (SELECT *, CASE WHEN abs(k - 50) >= 1e-9 THEN value / (k - 50) END AS raw FROM e)"
    + _bracket("raw", "r1").replace(", b AS (", ", bc AS (")
    + f", cf AS (SELECT user_id, i, coalesce(raw, {LINEAR}, {NEAREST}, 0.0) AS cf1 FROM bc)"
)


@register(
    "clean_recording",
    CLEAN_SQL
    + """SELECT e.user_id, e.i, round(ppg_green, 9) + 0.0 AS ppg_green, round(cf1, 8) + 0.0 AS cf1, e.value AS accy, e.k AS gyrox
     FROM e JOIN green ON green.user_id = e.user_id AND green.i = e.i JOIN cf ON cf.user_id = e.user_id AND cf.i = e.i""",
)
def clean_recording_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = event_series(spark, sf_dir)
    rows = clean_recording(lay.with_df(_as_sensor(lay.df)), 10)
    return rows.select("user_id", "i", rounded(F.col("ppg_green"), 9).alias("ppg_green"), rounded(F.col("cf1"), 8).alias("cf1"), "accy", "gyrox")


LEGACY_SQL = (
    SERIES_SQL
    + ", e1 AS (SELECT user_id, event_id, event_type, value, k, t, i, reading - 5 AS reading FROM e)"
    + _bracket("reading", "e1").replace(", b AS (", ", b0 AS (")
    + f", n0 AS (SELECT user_id, event_id, event_type, value, k, t, i, coalesce(reading, {NEAREST}) AS y FROM b0)"
    + ", n1 AS (SELECT user_id, event_id, event_type, value, k, t, i, CASE WHEN y >= 0 THEN y END AS pos FROM n0)"
    + _bracket("pos", "n1").replace(", b AS (", ", b1 AS (")
    + f", fl AS (SELECT user_id, event_id, event_type, value, k, t, i, coalesce(pos, {LINEAR}, {NEAREST}) AS reading FROM b1)"
    + OUTLIER_SQL.replace("FROM e)", "FROM fl)")
    + _bracket("kept", "kept")
)


@register(
    "clean_legacy",
    LEGACY_SQL + f"SELECT user_id, i, round(CASE WHEN any_out THEN coalesce(kept, {LINEAR}, {NEAREST}) ELSE reading END, 9) + 0.0 AS ppg_green FROM b",
)
def clean_legacy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = event_series(spark, sf_dir)
    rows = clean_legacy(lay.with_df(lay.df.withColumn("ppg_green", F.col("reading") - 5.0)), ["ppg_green"], 10)
    return rows.select("user_id", "i", rounded(F.col("ppg_green"), 9).alias("ppg_green"))


@register(
    "raw_recording",
    SERIES_SQL
    + "SELECT user_id, i, reading AS ppg_green, CASE WHEN (value + (k - 50)) - value <> 0 THEN round(value / ((value + (k - 50)) - value), 8) + 0.0 END AS cf1, value AS accy FROM e",
)
def raw_recording_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = event_series(spark, sf_dir)
    rows = raw_recording(lay.with_df(_as_sensor(lay.df)))
    return rows.select("user_id", "i", "ppg_green", rounded(F.col("cf1"), 8).alias("cf1"), "accy")


def _as_sensor(df: DataFrame) -> DataFrame:
    """Events as sensor rows with all required channels."""
    v, k = F.col("value"), F.col("k")
    cols = {
        "uc1": v, "uc2": k, "hf1": v + (k - 50.0), "hf2": v + k, "ppg_green": F.col("reading"),
        "ppg_red": F.when(F.col("event_type") != "view", v), "ppg_ir": v, "accx": k, "accy": v, "accz": F.lit(1.0),
        "gyrox": k, "gyroy": v, "gyroz": k,
    }
    return df.withColumns(cols)


POLY_SQL = """
, q AS (SELECT *, i - 19.5::DOUBLE AS x, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT user_id, i, {y1} AS y1, {y2} AS y2 FROM {src} WHERE i < 40))
, p AS (SELECT *, 1.0::DOUBLE AS p0, x AS p1, x * x - (1600 - 1) / 12.0::DOUBLE AS p2, x ** 3 - x * (3 * 1600 - 7) / 20.0::DOUBLE AS p3,
          x ** 4 - x * x * (3 * 1600 - 13) / 14.0::DOUBLE + 3.0::DOUBLE * (1600 - 1) * (1600 - 9) / 560 AS p4 FROM q WHERE n = 40)
, co AS (SELECT user_id, {coef} FROM p GROUP BY user_id)
, rs AS (SELECT p.user_id, i, y1 - ({fit1}) AS res1, y2 - ({fit2}) AS res2 FROM p JOIN co USING (user_id))
"""


def _poly(y1: str, y2: str, src: str) -> str:
    coef = ", ".join(f"sum(p{j} * y{c}) / sum(p{j} * p{j}) AS c{c}{j}" for c in (1, 2) for j in range(5))
    fit = {c: " + ".join(f"c{c}{j} * p{j}" for j in range(5)) for c in (1, 2)}
    return POLY_SQL.format(y1=y1, y2=y2, src=src, coef=coef, fit1=fit[1], fit2=fit[2])


GAP_SQL = (
    SERIES_SQL + ", pre AS (SELECT * FROM e WHERE i < 40)"
    + _bracket("reading", "pre")
    + f", ful AS (SELECT user_id, i, k, coalesce(reading, {LINEAR}, {NEAREST}) AS y FROM b)"
    + _poly("y", "k", "ful")
)


@register("poly_detrend", GAP_SQL + "SELECT user_id, i, round(res1, 5) + 0.0 AS res1, round(res2, 5) + 0.0 AS res2 FROM rs")
def poly_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qc.detrended_prefix(event_series(spark, sf_dir), ["reading", "k"], 40)
    return rows.where("_n = 40").select(
        "user_id", "i", rounded(F.col("res_reading"), 5).alias("res1"), rounded(F.col("res_k"), 5).alias("res2")
    )


QC_SQL = GAP_SQL + """
, sd AS (SELECT user_id, stddev_pop(res1) AS s1, stddev_pop(res2) AS s2 FROM rs GROUP BY user_id)
, oc AS (SELECT rs.user_id, s1, s2, CAST(sum(CASE WHEN s1 > 0 AND abs(res1) > 3 * s1 THEN 1 ELSE 0 END) AS BIGINT) AS n1,
           CAST(sum(CASE WHEN s2 > 0 AND abs(res2) > 3 * s2 THEN 1 ELSE 0 END) AS BIGINT) AS n2 FROM rs JOIN sd USING (user_id) GROUP BY ALL)
, rt AS (SELECT *, n1 / 40.0::DOUBLE AS r1, n2 / 40.0::DOUBLE AS r2 FROM oc)
, allu AS (SELECT user_id, count(*) AS n FROM pre GROUP BY user_id)
, ver AS (SELECT allu.user_id, s1, s2, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, r1, r2,
   CASE WHEN n < 40 THEN 'fewer samples than the quality prefix' ELSE
     coalesce(nullif(concat_ws('; ', CASE WHEN s1 > 60 OR s2 > 60 THEN 'STD above limit' END,
       CASE WHEN greatest(s1, s2) / (least(s1, s2) + 1e-12) > 2 THEN 'STD ratio above limit' END,
       CASE WHEN NOT (r1 < 0.03 AND r2 < 0.03) AND greatest(r1, r2) / (least(r1, r2) + 1e-12) > 3 THEN 'outlier ratios unbalanced' END), ''), 'ok') END AS reason
   FROM allu LEFT JOIN rt USING (user_id))
"""


@register(
    "qc_status",
    QC_SQL
    + """SELECT user_id, CASE WHEN reason = 'ok' THEN 'good' ELSE 'bad' END AS status, reason, round(s1, 5) AS std1, round(s2, 5) AS std2, n1 AS outliers1, n2 AS outliers2 FROM ver""",
)
def qc_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = qc.quality(event_series(spark, sf_dir), "reading", "k", 40, max_std=60.0, max_std_ratio=2.0)
    return verdict.select(
        "user_id", "status", "reason", rounded(F.col("std1"), 5).alias("std1"), rounded(F.col("std2"), 5).alias("std2"), "outliers1", "outliers2"
    )


@register(
    "qc_summary",
    QC_SQL + "SELECT CASE WHEN reason = 'ok' THEN 'good' ELSE 'bad' END AS status, reason, count(*) AS n FROM ver GROUP BY ALL",
)
def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = qc.quality(event_series(spark, sf_dir), "reading", "k", 40, max_std=60.0, max_std_ratio=2.0)
    return verdict.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))
