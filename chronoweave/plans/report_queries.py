"""Registered queries: JSON records, parameter choice, importance, redraw and protocol runs."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.columns import rounded
from chronoweave.operators import alignment, experiment, protocol, redraw, segments
from chronoweave.plans.metric_queries import RESULT_SQL, results, trial_history
from chronoweave.plans.series_queries import SEGMENT_SQL, SERIES_SQL, motion_layout
from chronoweave.plans.tables import event_series, table
from chronoweave.sources import sinks
from chronoweave.storage import materialise, new_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


STAGE = "array<struct<sensor_type:string,M:bigint,K:bigint>>"


@register(
    "stage_json_roundtrip",
    """WITH s AS (SELECT event_id, event_type AS sensor_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 8 AS "M",
      CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS "K" FROM events)
    SELECT sensor_type, "M", "K", min(event_id) AS first_event, count(*) AS n FROM s GROUP BY ALL""",
)
def stage_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct stage records of JSON stage lists, with the event of their first appearance."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    stage = F.array(F.struct(F.col("event_type").alias("sensor_type"), (k % 8).alias("M"), (k % 3).alias("K")))
    text = table(spark, sf_dir, "events").select("event_id", F.to_json(stage).alias("stages_json"))
    rows = text.select("event_id", F.inline(F.from_json("stages_json", STAGE)))
    distinct = rows.groupBy("sensor_type", "M", "K").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n"))
    return distinct


@register(
    "json_safe",
    """WITH p AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
    SELECT event_id, CASE WHEN k <> 50 THEN round(value / (k - 50), 9) + 0.0 END AS ratio, k > 50 AS above FROM p""",
)
def json_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records through JSON text: the undefined ratio is written as null and read back as NULL."""
    k = F.get_json_object("props", "$.k").cast("double")
    ratio = F.when(k != 50, F.col("value") / (k - 50)).otherwise(F.lit(float("nan")))
    rows = table(spark, sf_dir, "events").select("event_id", ratio.alias("ratio"), (k > 50).alias("above"))
    text = sinks.as_json(rows, "event_id")
    back = text.select("event_id", F.from_json("json", "ratio double, above boolean").alias("r"))
    return back.select("event_id", rounded(F.col("r.ratio"), 9).alias("ratio"), F.col("r.above").alias("above"))


@register(
    "best_params_pick",
    """WITH p AS (SELECT user_id AS row_id, ['motion_only', 'motion_recovery'][CAST(user_id % 2 + 1 AS INTEGER)] AS target_scope,
        (['ACC3', 'HF2', 'CF2'])[CAST(user_id % 3 + 1 AS INTEGER)] AS cascade_scheme, CASE WHEN user_id % 7 <> 0 THEN avg(value) END AS test_aae, count(*) AS tw
      FROM events GROUP BY user_id),
    q AS (SELECT target_scope, cascade_scheme FROM (SELECT unnest(['motion_only', 'motion_recovery', 'motion_post10']) AS target_scope)
          CROSS JOIN (SELECT unnest(['ACC3', 'HF2', 'CF2', 'HF2_CF2', 'CF2_HF2', 'ACC3_HF2', 'HF2_ACC3']) AS cascade_scheme)),
    b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY target_scope, cascade_scheme ORDER BY test_aae IS NULL, round(test_aae, 9), row_id) = 1),
    f AS (SELECT * FROM p ORDER BY row_id LIMIT 1)
    SELECT q.target_scope, q.cascade_scheme, b.row_id IS NOT NULL AS matched, coalesce(b.row_id, f.row_id) AS row_id,
      round(CASE WHEN b.row_id IS NULL THEN f.test_aae ELSE b.test_aae END, 6) AS test_aae, CASE WHEN b.row_id IS NULL THEN f.tw ELSE b.tw END AS tw
    FROM q LEFT JOIN b USING (target_scope, cascade_scheme) CROSS JOIN f""",
)
def best_params_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (u % n + 1).cast("int"))
    params = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("aae"), F.count(F.lit(1)).alias("tw"))
    params = params.select(
        u.alias("row_id"),
        pick(["motion_only", "motion_recovery"], 2).alias("target_scope"),
        pick(["ACC3", "HF2", "CF2"], 3).alias("cascade_scheme"),
        F.when(u % 7 != 0, F.col("aae")).alias("test_aae"),
        "tw",
    )
    requests = experiment.modes(spark, filters=["lms"]).drop("adaptive_filter")
    got = sinks.pick_params(requests, params, ["target_scope", "cascade_scheme"], "test_aae")
    return got.withColumn("test_aae", rounded(F.col("test_aae")))


@register("param_importance")
def param_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of the trial parameters for the objective (random forest of 50 trees)."""
    history = trial_history(spark, sf_dir).select("width", "step", "objective_value")
    names = ["width", "step"]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(history)
    model = RandomForestRegressor(labelCol="objective_value", numTrees=50, seed=42).fit(data)
    weights = [(n, float(w)) for n, w in zip(names, model.featureImportances.toArray())]
    return spark.createDataFrame(weights, "parameter string, importance double")


SLICE = (dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12))


@register(
    "sample_time_slice",
    "SELECT user_id, count(*) AS n, min(event_id) AS first_event, max(ts) AS last_ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12' GROUP BY user_id",
)
def sample_time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week of every recording, read from a samples table clustered by recording and time."""
    path = new_path(spark, "samples")
    sinks.write_samples(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), path, ["user_id"], "ts")
    part = sinks.time_slice(spark.read.parquet(path), *SLICE, time="ts")
    return part.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("ts").alias("last_ts"))


# --- redraw -------------------------------------------------------------------------------------

REDRAW_SQL = RESULT_SQL + """
, one AS (SELECT *, center_s + CASE WHEN user_id % 3 = 0 THEN 2.0 WHEN user_id % 3 = 1 THEN -1.0 ELSE 0.0 END AS t,
            CASE WHEN user_id % 3 = 0 THEN 2.0 WHEN user_id % 3 = 1 THEN -1.0 ELSE 0.0 END AS bias,
            CASE WHEN user_id % 3 = 0 THEN 'saved_best_params' ELSE 'computed_during_redraw' END AS src
          FROM res WHERE scope = 'motion_recovery')
, iv AS (SELECT user_id, CAST(i AS DOUBLE) AS t0, k AS v0, lead(CAST(i AS DOUBLE)) OVER w AS t1, lead(k) OVER w AS v1 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i))
, ip AS (SELECT one.*, CASE WHEN t = t0 THEN v0 WHEN t1 IS NULL THEN NULL ELSE v0 + (v1 - v0) / (t1 - t0) * (t - t0) END AS ref
         FROM one ASOF LEFT JOIN iv ON one.user_id = iv.user_id AND one.t >= iv.t0)
, g AS (SELECT *, CASE WHEN in_scope THEN adaptive_hr ELSE raw_hr END AS rate FROM ip)
"""


@register(
    "redraw_global_rate",
    REDRAW_SQL
    + """SELECT user_id, w, center_s AS time_s, label AS segment_label, in_scope AS is_filtered_segment, round(rate, 6) AS rate_bpm,
      round(ref, 6) AS ref_hr_after_bpm, bias::DOUBLE AS time_bias_after_s, round(abs(rate - ref), 6) AS abs_err_after_bpm, src AS time_bias_after_source
    FROM g WHERE ref IS NOT NULL""",
)
def redraw_global_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).where("scope = 'motion_recovery'").withColumn("fft_hr", F.col("raw_hr"))
    u = F.col("user_id") % 3
    biases = rows.select("user_id").distinct().select(
        "user_id",
        F.when(u == 0, F.lit(2.0)).alias("saved_bias"),
        F.when(u == 1, F.lit(-1.0)).when(u == 0, F.lit(5.0)).alias("found_bias"),
    )
    reference = event_series(spark, sf_dir).core().select("user_id", F.col("i").cast("double").alias("t"), F.col("k").alias("hr"))
    got = redraw.global_rates(rows, biases, reference, ["user_id"])
    names = ["rate_bpm", "ref_hr_after_bpm", "abs_err_after_bpm"]
    return got.withColumns({n: rounded(F.col(n)) for n in names}).drop("time_bias_after_mode")


# --- the protocol on the events -----------------------------------------------------------------

PROTOCOL_FS, PROTOCOL_TW = 4.0, 4.0
REST = alignment.RestOptions(tw_s=2.0, hop_s=0.25, score_start_s=1.0, delay_step_s=0.25, delay_max_s=1.0, band_bpm=(24.0, 120.0))
PARAMS = {
    "Kstop": 0.3, "max_order": 8, "M_base": 2, "C_scale": 1.2, "K_max": 4, "LMS_Mu_Base": 0.01, "Spec_Penalty_Width": 0.2,
    "Spec_Penalty_Weight": 0.2, "smooth_win_len": 7, "hr_range_hz": 25 / 60, "slew_limit_bpm": 10, "slew_step_bpm": 7, "nfft": 256,
}


def protocol_inputs(spark: SparkSession, sf_dir: str):
    """Events at 4 Hz as recordings with a motion segment; the second channel gives the reference."""
    lay = motion_layout(spark, sf_dir)
    v, k = F.col("value"), F.col("k")
    channels = {
        "ppg_green": v, "hf1": k, "hf2": v + k, "cf1": v - k, "cf2": v * k / 100.0,
        "accx": F.col("ax"), "accy": F.col("ay"), "accz": F.col("az"),
    }
    lay = lay.with_df(lay.df.withColumns(channels))
    _, segs = segments.activity_segments(lay, "mag", PROTOCOL_FS, 1.0, 0.25, 4.0)
    segs = materialise(segs, "segments")
    ref = lay.core().select("user_id", (F.col("i") / PROTOCOL_FS).alias("t"), (60.0 + k / 2.0).alias("hr"))
    return lay, segs, ref, list(channels)


@register("rest_delay_search")
def rest_delay_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score table of the global delay search from tracked rest rates (unit-tested on known delays)."""
    lay, segs, ref, _ = protocol_inputs(spark, sf_dir)
    candidates = alignment.rest_candidates(lay, segs, PROTOCOL_FS, REST, "ppg_green", "accz")
    scores = alignment.delay_scores(alignment.rest_rates(candidates, ["user_id"], PROTOCOL_FS, REST), ref, ["user_id"], REST)
    scores = materialise(scores, "scores")
    best = alignment.best_delays(scores, ["user_id"], REST).select("user_id", F.col("delay").alias("best"))
    table = scores.join(best, "user_id", "left").withColumn("selected", F.coalesce(F.col("delay") == F.col("best"), F.lit(False)))
    return table.drop("best").withColumns({n: rounded(F.col(n)) for n in ("aae", "std", "rmse")})


MOVE_SQL = """, m0 AS (SELECT mag.user_id, i, value * burst AS ax, k * burst AS ay, start_s, end_s FROM mag JOIN (SELECT user_id, start_s, end_s FROM seg WHERE end_s IS NOT NULL) b USING (user_id) WHERE i >= start_s AND i < end_s)
, st AS (SELECT user_id, count(*) AS n, min(i) AS i0, avg(ax) AS mx, avg(ay) AS my, var_pop(ax) AS ex, var_pop(ay) AS ey FROM m0 GROUP BY user_id)
, y AS (SELECT m0.user_id, n, i - i0 AS j, (CASE WHEN round(ex * n, 9) >= round(ey * n, 9) THEN ax - mx ELSE ay - my END) * (0.54 - 0.46 * cos(2 * pi() * (i - i0) / n)) AS y
        FROM m0 JOIN st USING (user_id) WHERE n >= 8)
, sp AS (SELECT user_id, b * 1.0::DOUBLE / n AS hz, sqrt(pow(sum(y * cos(2 * pi() * b * j / n)), 2) + pow(sum(y * sin(2 * pi() * b * j / n)), 2)) AS amp
         FROM y, unnest(generate_series(1, 60)) g(b) WHERE b * 1.0::DOUBLE / n BETWEEN 0.05 AND 0.45 GROUP BY user_id, b, n)
"""


@register(
    "segment_motion_frequency",
    SERIES_SQL + SEGMENT_SQL + MOVE_SQL.replace(", st AS", ", sg AS").replace("JOIN st", "JOIN sg")
    + """SELECT user_id, round(hz, 9) AS move_hz FROM sp QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(amp, 9) DESC, hz) = 1""",
)
def segment_motion_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = motion_layout(spark, sf_dir)
    _, segs = segments.activity_segments(lay, "mag", 1.0, 4.0, 1.0, 16.0)
    found = alignment.motion_frequency(lay, segs, ["ax", "ay"], 1.0, 0.05, 0.45)
    return found.withColumn("move_hz", rounded(F.col("move_hz"), 9))


@register("protocol_trial")
def protocol_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One full trial on the events: delay search, windows, LMS cascade, spectra, trackers, errors."""
    lay, segs, ref, channels = protocol_inputs(spark, sf_dir)
    candidates = alignment.rest_candidates(lay, segs, PROTOCOL_FS, REST, "ppg_green", "accz")
    scores = alignment.delay_scores(alignment.rest_rates(candidates, ["user_id"], PROTOCOL_FS, REST), ref, ["user_id"], REST)
    best = materialise(alignment.best_delays(scores, ["user_id"], REST), "delays")
    moves = alignment.motion_frequency(lay, segs, ["accx", "accy", "accz"], PROTOCOL_FS)
    wins = alignment.training_windows(lay, segs, best, ref, channels, PROTOCOL_FS, PROTOCOL_TW, 0.25, moves)
    done = protocol.run_trial(wins, ["user_id"], PROTOCOL_FS, PARAMS, "HF2_ACC3", "motion_recovery", "lms", tw_s=PROTOCOL_TW)
    return done.select(
        "user_id", "w", "label", "in_scope", rounded(F.col("ref_hr")).alias("ref_hr"),
        rounded(F.col("baseline_hr")).alias("baseline_hr"), rounded(F.col("adaptive_hr")).alias("adaptive_hr"),
    )
