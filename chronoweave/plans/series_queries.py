"""Registered queries over the event series: cleaning, windows, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.columns import as_number, clock_seconds, magnitude, rounded, truthy, window_label
from chronoweave.operators import missing, segments
from chronoweave.plans.tables import event_series, table

FS = 1.0  # one sample per second: the position in the recording is the time axis
WIDTH_S, HOP_S, CALIBRATION_S = 8.0, 1.0, 30.0
FLAG_TEXT = ["click", " Yes ", "view", "TRUE", "error", "0", "signup", "no", "purchase", "2"]

SERIES_SQL = """
WITH e AS (
  SELECT user_id, event_id, ts, event_type, value,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS t,
         CASE WHEN event_type <> 'error' THEN value END AS reading,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i
  FROM events)
"""

BRACKET_SQL = """
, b AS (
  SELECT *,
    last_value(CASE WHEN {v} IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi,
    last_value({v} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
    last_value(CASE WHEN {v} IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
    first_value(CASE WHEN {v} IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni,
    first_value({v} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
    first_value(CASE WHEN {v} IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt
  FROM {src})
"""
LINEAR = "CASE WHEN pi IS NULL OR ni IS NULL THEN NULL WHEN pi = ni THEN pv ELSE pv + (nv - pv) / (ni - pi) * (i - pi) END"
NEAREST = "CASE WHEN pi IS NULL OR (ni IS NOT NULL AND ni - i <= i - pi) THEN nv ELSE pv END"


def _bracket(value: str, src: str = "e") -> str:
    return BRACKET_SQL.format(v=value, src=src)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@register("series_layout", SERIES_SQL + "SELECT user_id, event_id, i, round(i / 100.0, 6) AS time_s, value FROM e")
def series_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_series(spark, sf_dir).core().select(
        "user_id", "event_id", "i", rounded(F.col("i") / 100.0).alias("time_s"), "value"
    )


@register("fill_nearest", SERIES_SQL + _bracket("reading") + f"SELECT user_id, event_id, coalesce(reading, {NEAREST}) AS filled FROM b")
def fill_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.fill_nearest(event_series(spark, sf_dir), "reading").select("user_id", "event_id", "filled")


@register("fill_linear", SERIES_SQL + _bracket("reading") + f"SELECT user_id, event_id, round(coalesce(reading, {LINEAR}), 6) + 0.0 AS filled FROM b")
def fill_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.fill_linear(event_series(spark, sf_dir), "reading").select(
        "user_id", "event_id", rounded(F.col("filled")).alias("filled")
    )


OUTLIER_SQL = """
, m AS (SELECT *, quantile_cont(reading, 0.5) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS med FROM e)
, d AS (SELECT *, abs(reading - med) AS dev FROM m)
, f AS (SELECT *, 1.4826 * quantile_cont(dev, 0.5) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS mad FROM d)
, o AS (SELECT *, coalesce(mad > 0 AND dev > 3 * mad, false) AS outlier FROM f)
, kept AS (SELECT *, CASE WHEN NOT outlier THEN reading END AS kept, bool_or(outlier) OVER (PARTITION BY user_id) AS any_out FROM o)
"""


@register(
    "movmedian_outlier_fill",
    SERIES_SQL + OUTLIER_SQL + _bracket("kept", "kept")
    + f"SELECT user_id, event_id, outlier, round(CASE WHEN any_out THEN coalesce(kept, {LINEAR}, {NEAREST}) ELSE reading END, 6) + 0.0 AS clean FROM b",
)
def movmedian_outlier_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.replace_local_outliers(event_series(spark, sf_dir), "reading", 10).select(
        "user_id", "event_id", "outlier", rounded(F.col("clean")).alias("clean")
    )


@register(
    "mean_sigma_prev_fill",
    SERIES_SQL
    + """
, s AS (SELECT *, avg(reading) OVER (PARTITION BY user_id) AS mu, stddev_samp(reading) OVER (PARTITION BY user_id) AS sd FROM e)
, o AS (SELECT *, coalesce(sd > 0 AND abs(reading - mu) > 3 * sd, false) AS outlier FROM s)
, g AS (SELECT *, last_value(CASE WHEN NOT outlier THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i) AS gi FROM o)
SELECT g.user_id, g.event_id, g.outlier, CASE WHEN g.outlier THEN coalesce(p.reading, g.reading) ELSE g.reading END AS clean
FROM g LEFT JOIN e p ON p.user_id = g.user_id AND p.i = g.gi
""",
)
def mean_sigma_prev_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.replace_global_outliers(event_series(spark, sf_dir), "reading").select(
        "user_id", "event_id", "outlier", "clean"
    )


@register(
    "moving_median_smooth",
    SERIES_SQL
    + """SELECT user_id, event_id,
  round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth5,
  round(quantile_cont(reading, 0.5) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING), 6) AS smooth8
FROM e""",
)
def moving_median_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = event_series(spark, sf_dir)
    return lay.df.select(
        "core",
        "user_id",
        "event_id",
        rounded(missing.moving_median(lay, "value", 5)).alias("smooth5"),
        rounded(missing.moving_median(lay, "reading", 8)).alias("smooth8"),
    ).where("core").drop("core")


@register(
    "ratio_channel",
    SERIES_SQL
    + ", r AS (SELECT *, CASE WHEN abs(k - 50) >= 1e-9 THEN value / (k - 50) END AS raw FROM e)"
    + _bracket("raw", "r")
    + f"SELECT user_id, event_id, round(coalesce(raw, {LINEAR}, {NEAREST}, 0.0), 9) + 0.0 AS ratio FROM b",
)
def ratio_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = event_series(spark, sf_dir)
    lay = lay.with_df(lay.df.withColumn("total", F.col("value") + (F.col("k") - 50.0)))
    return missing.ratio_channel(lay, "value", "total").select("user_id", "event_id", rounded(F.col("ratio"), 9).alias("ratio"))


@register(
    "scalar_parsing",
    """SELECT event_id,
  try_cast(replace(json_extract_string(props, '$.k'), '7', 'x') AS DOUBLE) AS number,
  CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS seconds,
  'TW' || CASE WHEN value * 2 = floor(value * 2) THEN CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'p5' END
               ELSE 'x' END AS tw,
  event_type IN ('click', 'view') AS flag
FROM events""",
)
def scalar_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clock = F.date_format("ts", "HH:mm:ss")
    text = F.replace(F.get_json_object("props", "$.k"), F.lit("7"), F.lit("x"))
    half = F.col("value") * 2 == F.floor(F.col("value") * 2)
    return events.select(
        "event_id",
        as_number(text).alias("number"),
        clock_seconds(clock).alias("seconds"),
        F.when(half, window_label(F.col("value"))).otherwise("TWx").alias("tw"),
        truthy(F.create_map(*[F.lit(x) for x in FLAG_TEXT])[F.col("event_type")]).alias("flag"),
    )


WINDOW_SQL = """
, win AS (
  SELECT *, stddev_samp(value) OVER f AS std, avg(value) OVER f AS mean, max(value) OVER f AS vmax,
         count(*) OVER f AS n, i AS w, i + 4.0 AS center_s
  FROM e WINDOW f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
  QUALIFY n = 8)
"""


@register(
    "sliding_window_std",
    SERIES_SQL + WINDOW_SQL
    + "SELECT user_id, w, center_s, round(std, 6) AS std, round(mean, 6) AS mean, vmax FROM win",
)
def sliding_window_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = {"std": F.stddev_samp("value"), "mean": F.avg("value"), "vmax": F.max("value")}
    win = segments.sliding_windows(event_series(spark, sf_dir), FS, WIDTH_S, HOP_S, aggs)
    return win.core().select(
        "user_id", "w", "center_s", rounded(F.col("std")).alias("std"), rounded(F.col("mean")).alias("mean"), "vmax"
    )


MOTION_WIDTH_S, MOTION_CALIBRATION_S = 4.0, 16.0
SCOPES = ["motion_only", "motion_post10", "motion_recovery"]

# The second third of the month is the exercise: the readings of those days are 40 times as large.
SEGMENT_SQL = """
, mag AS (SELECT *, sqrt(pow(value * burst, 2) + pow(k * burst, 2) + 1) AS mag
          FROM (SELECT *, CASE WHEN day(ts) BETWEEN 11 AND 20 THEN 40.0 ELSE 1.0 END AS burst FROM e))
, base AS (SELECT user_id, 3 * stddev_samp(mag) AS threshold FROM mag WHERE i < 16 GROUP BY user_id)
, mwin AS (SELECT mag.user_id, i AS w, i + 2.0 AS center_s, threshold, stddev_samp(mag) OVER f AS std, count(*) OVER f AS n,
                  avg(value) OVER f AS baseline_hr, avg(k) OVER f AS ref_hr, max(value) OVER f AS raw_hr
           FROM mag JOIN base USING (user_id)
           WINDOW f AS (PARTITION BY mag.user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) QUALIFY n = 4)
, fl AS (SELECT *, CAST(std > threshold AS INTEGER) AS m FROM mwin)
, runs AS (SELECT user_id, w,
             sum(m) OVER a AS m1, count(*) OVER a AS n1, sum(m) OVER b2 AS m2, count(*) OVER b2 AS n2
           FROM fl WINDOW a AS (PARTITION BY user_id ORDER BY w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING),
                          b2 AS (PARTITION BY user_id ORDER BY w ROWS BETWEEN 6 FOLLOWING AND 11 FOLLOWING))
, st AS (SELECT user_id, min(w + 6) AS ws FROM runs WHERE n1 = 6 AND n2 = 6 AND m1 = 0 AND m2 = 6 GROUP BY user_id)
, en AS (SELECT r.user_id, min(w + 6) AS we FROM runs r JOIN st USING (user_id)
         WHERE n1 = 6 AND n2 = 6 AND m1 = 6 AND m2 = 0 AND w >= ws GROUP BY r.user_id)
, cnt AS (SELECT user_id, count(*) AS n_windows FROM fl GROUP BY user_id)
, seg AS (
  SELECT base.user_id, threshold, coalesce(n_windows, 0) AS n_windows,
    CASE WHEN n_windows IS NULL THEN 'signal shorter than one window' WHEN n_windows < 12 THEN 'too few sliding windows'
         WHEN ws IS NULL THEN 'no rest to motion transition' WHEN we IS NULL THEN 'no motion to rest transition' ELSE '' END AS reason,
    CASE WHEN ws IS NOT NULL AND we IS NOT NULL AND n_windows >= 12 THEN 'ok' ELSE 'error' END AS status,
    CASE WHEN we IS NOT NULL THEN CAST(ws AS DOUBLE) END AS start_s, CAST(we AS DOUBLE) AS end_s
  FROM base LEFT JOIN cnt USING (user_id) LEFT JOIN st USING (user_id) LEFT JOIN en USING (user_id))
, lab AS (SELECT fl.*, status, start_s, end_s,
            CASE WHEN status <> 'ok' THEN 'unknown' WHEN center_s < start_s THEN 'rest' WHEN center_s <= end_s THEN 'motion' ELSE 'recovery' END AS label
          FROM fl JOIN seg ON seg.user_id = fl.user_id)
, sc AS (SELECT lab.*, scope, CASE scope WHEN 'motion_only' THEN label = 'motion'
            WHEN 'motion_post10' THEN label = 'motion' OR coalesce(center_s > end_s AND center_s <= end_s + 10, false)
            ELSE label IN ('motion', 'recovery') END AS in_scope
         FROM lab, (VALUES ('motion_only'), ('motion_post10'), ('motion_recovery')) v(scope))
"""


def motion_layout(spark: SparkSession, sf_dir: str):
    lay = event_series(spark, sf_dir)
    burst = F.when(F.dayofmonth("ts").between(11, 20), 40.0).otherwise(1.0)
    df = (
        lay.df.withColumn("ax", F.col("value") * burst)
        .withColumn("ay", F.col("k") * burst)
        .withColumn("az", F.lit(1.0))
        .withColumn("mag", magnitude("ax", "ay", "az"))
    )
    return lay.with_df(df)


def labelled_windows(spark: SparkSession, sf_dir: str):
    """Windows with label, baseline estimate and reference; the ground of the metric queries."""
    lay = motion_layout(spark, sf_dir)
    _, segs = segments.activity_segments(lay, "mag", FS, MOTION_WIDTH_S, HOP_S, MOTION_CALIBRATION_S)
    aggs = {"baseline_hr": F.avg("value"), "ref_hr": F.avg("k"), "raw_hr": F.max("value")}
    win = segments.sliding_windows(lay, FS, MOTION_WIDTH_S, HOP_S, aggs)
    return segments.label_windows(win, segs)


@register("vector_magnitude", SERIES_SQL + SEGMENT_SQL + "SELECT user_id, event_id, round(mag, 6) AS mag FROM mag")
def vector_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion_layout(spark, sf_dir).core().select("user_id", "event_id", rounded(F.col("mag")).alias("mag"))


@register(
    "activity_segments",
    SERIES_SQL + SEGMENT_SQL
    + "SELECT user_id, status, reason, n_windows, start_s, end_s, round(threshold, 6) AS threshold FROM seg",
)
def activity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = motion_layout(spark, sf_dir)
    _, segs = segments.activity_segments(lay, "mag", FS, MOTION_WIDTH_S, HOP_S, MOTION_CALIBRATION_S)
    return segs.select(
        "user_id", "status", "reason", "n_windows", "start_s", "end_s", rounded(F.col("threshold")).alias("threshold")
    )


@register("window_labels", SERIES_SQL + SEGMENT_SQL + "SELECT user_id, w, center_s, label FROM lab")
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_windows(spark, sf_dir).core().select("user_id", "w", "center_s", "label")


@register(
    "scope_masks",
    SERIES_SQL + SEGMENT_SQL
    + """SELECT scope, label, count(*) AS n_windows, CAST(count(*) FILTER (WHERE in_scope) AS BIGINT) AS n_scope,
         count(DISTINCT CASE WHEN in_scope THEN user_id END) AS n_recordings FROM sc GROUP BY scope, label""",
)
def scope_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.scope_masks(labelled_windows(spark, sf_dir).core(), SCOPES)
    per_recording = rows.groupBy("scope", "label", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("in_scope").alias("s")
    )
    return per_recording.groupBy("scope", "label").agg(
        F.sum("n").alias("n_windows"), F.sum("s").alias("n_scope"), F.count_if(F.col("s") > 0).alias("n_recordings")
    )


@register(
    "scope_compact_smooth",
    SERIES_SQL + SEGMENT_SQL
    + """, r AS (SELECT *, CASE WHEN in_scope THEN row_number() OVER (PARTITION BY user_id, scope, in_scope ORDER BY w) - 1 END AS rank FROM sc WHERE scope = 'motion_recovery')
    SELECT user_id, w, coalesce(rank, -1) AS rank,
      CASE WHEN in_scope THEN quantile_cont(raw_hr, 0.5) OVER (PARTITION BY user_id, in_scope ORDER BY w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
           ELSE baseline_hr END AS adaptive_hr FROM r""".replace("ELSE baseline_hr END", "ELSE round(baseline_hr, 6) END"),
)
def scope_compact_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = labelled_windows(spark, sf_dir)
    rows = win.df.withColumn("scope", F.lit("motion_recovery"))
    flag = F.col("label").isin("motion", "recovery")
    return segments.smooth_in_scope(win.with_df(rows.withColumn("in_scope", flag)), "raw_hr", "in_scope", 7, "smooth").select(
        "user_id",
        "w",
        F.coalesce("rank", F.lit(-1)).alias("rank"),
        F.when(F.col("in_scope"), F.col("smooth")).otherwise(rounded(F.col("baseline_hr"))).alias("adaptive_hr"),
    )
