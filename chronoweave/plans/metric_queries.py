"""Registered queries: delay search, grids, error metrics, folds, trials and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions.columns import rounded
from chronoweave.operators import delay, experiment, interpolate, metrics, sampler, segments, trials
from chronoweave.operators.alignment import SCAN_ROWS
from chronoweave.plans.series_queries import SCOPES, SEGMENT_SQL, SERIES_SQL, labelled_windows
from chronoweave.plans.tables import event_rows, event_series, table
from chronoweave.storage import materialise

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# --- windows with estimates ---------------------------------------------------------------------

RESULT_SQL = SERIES_SQL + SEGMENT_SQL + """
, ty AS (SELECT * FROM (VALUES (0, 'bobi'), (1, 'fuwo'), (2, 'kaihe'), (3, 'tiaosheng'), (4, 'wanju')) v(code, motion_type))
, res AS (SELECT sc.*, motion_type, motion_type || CAST(user_id // 5 AS VARCHAR) AS group_id, user_id // 5 AS motion_index,
            (baseline_hr + ref_hr) / 2 AS adaptive_hr,
            round(baseline_hr - ref_hr, 9) AS be, round((baseline_hr + ref_hr) / 2 - ref_hr, 9) AS ae
          FROM sc JOIN ty ON code = user_id % 5)
"""


def motion_type_of(user: str = "user_id"):
    return F.element_at(F.array(*[F.lit(m) for m in experiment.MOTION_TYPES]), (F.col(user) % 5 + 1).cast("int"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window results per scope: baseline and adaptive estimate, reference, motion type and group."""
    rows = segments.scope_masks(labelled_windows(spark, sf_dir).core(), SCOPES)
    return (
        rows.withColumn("motion_type", motion_type_of())
        .withColumn("motion_index", F.expr("user_id div 5"))
        .withColumn("group_id", F.concat("motion_type", F.col("motion_index").cast("string")))
        .withColumn("adaptive_hr", (F.col("baseline_hr") + F.col("ref_hr")) / 2.0)
        .withColumn("err", F.round(F.col("adaptive_hr") - F.col("ref_hr"), 9))
    )


METRIC_COLS = """round(avg(abs(be)) FILTER (WHERE in_scope), 6) AS baseline_aae, round(avg(abs(ae)) FILTER (WHERE in_scope), 6) AS adaptive_aae,
  round(avg(CASE WHEN abs(be) <= 5 THEN 100.0::DOUBLE ELSE 0 END) FILTER (WHERE in_scope), 6) AS baseline_acc,
  round(avg(CASE WHEN abs(ae) <= 5 THEN 100.0::DOUBLE ELSE 0 END) FILTER (WHERE in_scope), 6) AS adaptive_acc,
  CAST(count(*) FILTER (WHERE in_scope) AS BIGINT) AS n_valid"""


def _round_metrics(df: DataFrame) -> DataFrame:
    names = ["baseline_aae", "adaptive_aae", "baseline_acc", "adaptive_acc"]
    return df.withColumns({n: rounded(F.col(n)) for n in names})


@register("error_metrics", RESULT_SQL + f"SELECT user_id, scope, {METRIC_COLS} FROM res GROUP BY user_id, scope")
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_metrics(metrics.scope_metrics(results(spark, sf_dir), ["user_id", "scope"]))


@register("accuracy_by_group", RESULT_SQL + f"SELECT motion_type, scope, label, {METRIC_COLS} FROM res GROUP BY motion_type, scope, label")
def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_metrics(metrics.scope_metrics(results(spark, sf_dir), ["motion_type", "scope", "label"]))


@register(
    "mean_of_means_vs_concat",
    RESULT_SQL
    + """SELECT motion_type, round(sum(s) / sum(n), 6) AS concat_aae, round(avg(s / n), 6) AS mean_of_means, CAST(sum(n) AS BIGINT) AS n_windows
    FROM (SELECT motion_type, user_id, sum(abs(ae)) AS s, count(*) AS n FROM res WHERE scope = 'motion_recovery' AND in_scope GROUP BY ALL)
    GROUP BY motion_type""",
)
def mean_of_means_vs_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = results(spark, sf_dir).where("scope = 'motion_recovery' AND in_scope")
    per = inside.groupBy("motion_type", "user_id").agg(F.sum(F.abs("err")).alias("s"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("motion_type").agg(
        rounded(F.sum("s") / F.sum("n")).alias("concat_aae"),
        rounded(F.avg(F.col("s") / F.col("n"))).alias("mean_of_means"),
        F.sum("n").alias("n_windows"),
    )


# --- folds and splits ---------------------------------------------------------------------------


def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .select("user_id")
        .distinct()
        .withColumn("motion_type", motion_type_of())
        .withColumn("motion_index", F.expr("user_id div 5"))
        .withColumn("group_id", F.concat("motion_type", F.col("motion_index").cast("string")))
    )


GROUP_SQL = """WITH ty AS (SELECT * FROM (VALUES (0, 'bobi'), (1, 'fuwo'), (2, 'kaihe'), (3, 'tiaosheng'), (4, 'wanju')) v(code, motion_type)),
g AS (SELECT DISTINCT user_id, motion_type, user_id // 5 AS motion_index, motion_type || CAST(user_id // 5 AS VARCHAR) AS group_id
      FROM events JOIN ty ON code = user_id % 5)
"""


@register(
    "logo_folds",
    GROUP_SQL
    + """SELECT motion_type, row_number() OVER (PARTITION BY motion_type ORDER BY motion_index, group_id) - 1 AS fold_id,
      group_id AS heldout_group_id, count(*) OVER (PARTITION BY motion_type) - 1 AS n_train,
      CASE WHEN count(*) OVER (PARTITION BY motion_type) < 2 THEN 'failed' ELSE 'ok' END AS status FROM g""",
)
def logo_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.leave_one_out_folds(event_groups(spark, sf_dir))


@register(
    "split_plan",
    GROUP_SQL
    + """, h AS (SELECT *, CAST(('0x' || substr(sha256('42|' || motion_type || '|' || group_id), 9, 8))::BIGINT AS BIGINT) AS h FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY motion_type ORDER BY h, group_id) - 1 AS position, count(*) OVER (PARTITION BY motion_type) AS n FROM h)
    SELECT motion_type, group_id, user_id, motion_index, position,
      CASE WHEN n - 3 - 5 < 1 THEN 'failed' WHEN position < 5 THEN 'test' WHEN position < 8 THEN 'val' ELSE 'train' END AS split FROM r""",
)
def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.split_groups(event_groups(spark, sf_dir), 3, 5, 42)


@register(
    "stable_hash_ids",
    """SELECT event_id, CAST(('0x' || substr(sha256(event_type || '|' || props), 9, 8))::BIGINT AS BIGINT) AS hash,
       ('0x' || substr(sha256(event_type || '|' || props), 9, 8))::BIGINT % 10 AS bucket FROM events""",
)
def stable_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = experiment.stable_hash(F.concat_ws("|", "event_type", "props"))
    return table(spark, sf_dir, "events").select("event_id", h.alias("hash"), (h % 10).alias("bucket"))


LOGO_SQL = RESULT_SQL + """
, own AS (SELECT motion_type, scope, group_id, count(*) AS n, sum(abs(ae)) AS s, count(*) FILTER (WHERE abs(ae) <= 5) AS h
          FROM res WHERE in_scope GROUP BY ALL)
, loo AS (SELECT o.motion_type, o.scope, o.group_id,
            o.s / o.n AS test_aae, 100.0 * o.h / o.n AS test_acc, o.n AS n_test,
            sum(p.s) / sum(p.n) AS train_aae, 100.0 * sum(p.h) / sum(p.n) AS train_acc, coalesce(CAST(sum(p.n) AS BIGINT), 0) AS n_train
          FROM own o LEFT JOIN own p ON p.motion_type = o.motion_type AND p.scope = o.scope AND p.group_id <> o.group_id
          GROUP BY o.motion_type, o.scope, o.group_id, o.s, o.n, o.h)
"""


@register(
    "logo_fold_metrics",
    LOGO_SQL
    + """SELECT motion_type, scope, group_id, n_test, n_train, round(test_aae, 6) AS test_aae, round(test_acc, 6)::DOUBLE AS test_acc,
         round(train_aae, 6) AS train_aae, round(train_acc, 6)::DOUBLE AS train_acc FROM loo""",
)
def logo_fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = results(spark, sf_dir).where("in_scope")
    folds = experiment.leave_one_out_metrics(inside, ["motion_type", "scope"], "group_id", "err")
    names = ["test_aae", "test_acc", "train_aae", "train_acc"]
    return folds.withColumns({n: rounded(F.col(n)) for n in names})


@register(
    "logo_aggregate",
    LOGO_SQL
    + """SELECT motion_type, scope, round(sum(test_aae * n_test) / sum(n_test), 6) AS test_aae,
         round(sum(test_acc * n_test) / sum(n_test), 6)::DOUBLE AS test_acc, CAST(sum(n_test) AS BIGINT) AS n_windows, count(*) AS n_folds,
         arg_min(group_id, (round(test_aae, 9), CAST(regexp_extract(group_id, '[0-9]+') AS BIGINT))) AS representative
       FROM loo GROUP BY motion_type, scope""",
)
def logo_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalisation error: all held-out windows together; the representative fold has the best test error."""
    inside = results(spark, sf_dir).where("in_scope")
    own = inside.groupBy("motion_type", "scope", "group_id", "motion_index").agg(
        F.count("err").alias("n"), F.sum(F.abs("err")).alias("s"), F.count_if(F.abs("err") <= 5.0).alias("h")
    )
    order = F.struct(F.round(F.col("s") / F.col("n"), 9), "motion_index")
    return own.groupBy("motion_type", "scope").agg(
        rounded(F.sum("s") / F.sum("n")).alias("test_aae"),
        rounded(F.sum("h") * 100.0 / F.sum("n")).alias("test_acc"),
        F.sum("n").alias("n_windows"),
        F.count(F.lit(1)).alias("n_folds"),
        F.min_by("group_id", order).alias("representative"),
    )


# --- modes, trials and summaries ----------------------------------------------------------------

MODE_SQL = RESULT_SQL + """
, mode AS (SELECT target_scope, cascade_scheme, adaptive_filter
           FROM (SELECT unnest(['motion_only', 'motion_recovery', 'motion_post10']) AS target_scope)
           CROSS JOIN (SELECT unnest(['ACC3', 'HF2', 'CF2', 'HF2_CF2', 'CF2_HF2', 'ACC3_HF2', 'HF2_ACC3']) AS cascade_scheme)
           CROSS JOIN (SELECT unnest(['lms', 'volterra', 'rff_lms']) AS adaptive_filter))
, sm AS (SELECT motion_type, scope, avg(abs(ae)) AS aae, avg(CASE WHEN abs(ae) <= 5 THEN 100.0::DOUBLE ELSE 0 END) AS acc, count(*) AS n
         FROM res WHERE in_scope GROUP BY ALL)
"""


def scope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = results(spark, sf_dir).where("in_scope")
    return inside.groupBy("motion_type", "scope").agg(
        metrics.aae(F.col("err")).alias("aae"), metrics.accuracy(F.col("err")).alias("acc"), F.count("err").alias("n")
    )


def complete_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every motion type x mode, also those without any evaluated window (they get a reason).

    The type ``absent`` has no recordings at all.
    """
    types = F.explode(F.array(*[F.lit(m) for m in [*experiment.MOTION_TYPES, "absent"]])).alias("motion_type")
    dim = experiment.modes(spark).select(types, "*")
    found = scope_summary(spark, sf_dir).withColumnRenamed("scope", "target_scope")
    return dim.join(found, ["motion_type", "target_scope"], "left")


@register(
    "mode_cross_summary",
    MODE_SQL
    + """SELECT ty.motion_type, target_scope, cascade_scheme, adaptive_filter,
       target_scope || '__' || cascade_scheme || '__' || adaptive_filter || '__aae__leave_one_group_out' AS run_name,
       round(aae, 6) AS adaptive_aae, round(acc, 6) AS adaptive_acc, coalesce(n, 0) AS n_valid, n IS NOT NULL AS success,
       CASE WHEN n IS NULL THEN 'no evaluated windows' ELSE '' END AS reason
     FROM mode CROSS JOIN (SELECT motion_type FROM ty UNION ALL SELECT 'absent') ty LEFT JOIN sm ON sm.motion_type = ty.motion_type AND sm.scope = target_scope""",
)
def mode_cross_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = experiment.run_name(
        F.col("target_scope"), F.col("cascade_scheme"), F.col("adaptive_filter"), F.lit("aae"), F.lit("leave_one_group_out")
    )
    return complete_modes(spark, sf_dir).select(
        "motion_type",
        "target_scope",
        "cascade_scheme",
        "adaptive_filter",
        name.alias("run_name"),
        rounded(F.col("aae")).alias("adaptive_aae"),
        rounded(F.col("acc")).alias("adaptive_acc"),
        F.coalesce("n", F.lit(0)).alias("n_valid"),
        F.col("n").isNotNull().alias("success"),
        F.when(F.col("n").isNull(), "no evaluated windows").otherwise("").alias("reason"),
    )


@register(
    "final_summary",
    MODE_SQL
    + """SELECT target_scope, metric, ty.motion_type, cascade_scheme, adaptive_filter, 'aggregate' AS result_level,
       'logo_window_concat' AS aggregation, round(CASE metric WHEN 'aae' THEN aae ELSE acc END, 6) AS metric_value, n IS NOT NULL AS success
     FROM mode CROSS JOIN (SELECT motion_type FROM ty UNION ALL SELECT 'absent') ty CROSS JOIN (VALUES ('aae'), ('accuracy')) m(metric)
     LEFT JOIN sm ON sm.motion_type = ty.motion_type AND sm.scope = target_scope""",
)
def final_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.inline(
        F.array(
            F.struct(F.lit("aae").alias("metric"), F.col("aae").alias("metric_value")),
            F.struct(F.lit("accuracy").alias("metric"), F.col("acc").alias("metric_value")),
        )
    )
    rows = complete_modes(spark, sf_dir).withColumn("success", F.col("n").isNotNull())
    return rows.select("target_scope", "motion_type", "cascade_scheme", "adaptive_filter", "success", pairs).select(
        "target_scope",
        "metric",
        "motion_type",
        "cascade_scheme",
        "adaptive_filter",
        F.lit("aggregate").alias("result_level"),
        F.lit("logo_window_concat").alias("aggregation"),
        rounded(F.col("metric_value")).alias("metric_value"),
        "success",
    )


@register(
    "metric_matrix",
    RESULT_SQL
    + """SELECT scope || ':' || label AS row_name, round(avg(abs(ae)) FILTER (WHERE motion_type = 'bobi'), 6) AS bobi,
       round(avg(abs(ae)) FILTER (WHERE motion_type = 'fuwo'), 6) AS fuwo, round(avg(abs(ae)) FILTER (WHERE motion_type = 'kaihe'), 6) AS kaihe,
       round(avg(abs(ae)) FILTER (WHERE motion_type = 'tiaosheng'), 6) AS tiaosheng, round(avg(abs(ae)) FILTER (WHERE motion_type = 'wanju'), 6) AS wanju
     FROM res GROUP BY scope, label""",
)
def metric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).withColumn("row_name", F.concat_ws(":", "scope", "label"))
    wide = rows.groupBy("row_name").pivot("motion_type", experiment.MOTION_TYPES).agg(metrics.aae(F.col("err")))
    return wide.select("row_name", *[rounded(F.col(m)).alias(m) for m in experiment.MOTION_TYPES])


TRIALS = experiment.sample_trials("lms", 20, 3, 42)
TRIAL_SQL = ", ".join(f"({t['repeat_idx']}, {t['trial_idx']}, {t['smooth_win_len']}, {t['slew_step_bpm']})" for t in TRIALS)
WIDTHS = experiment.SEARCH_SPACE["smooth_win_len"]
WIDTH_SQL = ", ".join(
    f"quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING) AS m{w}"
    for w in WIDTHS
)
HISTORY_SQL = SERIES_SQL + f"""
, trial AS (SELECT * FROM (VALUES {TRIAL_SQL}) v(repeat_idx, trial_idx, width, step))
, sm AS (SELECT *, {WIDTH_SQL} FROM e)
, obj AS (UNPIVOT (SELECT user_id % 5 AS code, {", ".join(f"avg(abs(m{w} - k)) AS m{w}" for w in WIDTHS)} FROM sm GROUP BY ALL) ON {", ".join(f"m{w}" for w in WIDTHS)} INTO NAME width_name VALUE aae)
, hist AS (SELECT code AS motion_code, repeat_idx, trial_idx, width, step, round(aae + step / 100.0::DOUBLE, 6) AS objective_value
           FROM trial JOIN obj ON width_name = 'm' || width)
"""


def trial_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objective of every sampled trial per motion type.

    The evaluation is factored: each distinct smoothing width is computed once on the series, and
    only its aggregated error meets the trials that use it.
    """
    from chronoweave.operators.missing import moving_median

    lay = event_series(spark, sf_dir)
    per_width = F.array(*[
        F.struct(F.lit(float(w)).alias("width"), (moving_median(lay, "value", w) - F.col("k")).alias("err")) for w in WIDTHS
    ])
    rows = lay.df.select("core", (F.col("user_id") % 5).alias("motion_code"), per_width.alias("_p")).where("core")
    errors = rows.select("motion_code", F.inline("_p"))
    scores = errors.groupBy("motion_code", "width").agg(metrics.aae(F.col("err")).alias("aae"))
    trials = experiment.trials_frame(spark, TRIALS).select(
        "repeat_idx",
        "trial_idx",
        F.col("params")["smooth_win_len"].alias("width"),
        F.col("params")["slew_step_bpm"].alias("step"),
    )
    objective = F.col("aae") + F.col("step") / 100.0
    return trials.join(scores, "width").select(
        "motion_code",
        "repeat_idx",
        "trial_idx",
        F.col("width").cast("int").alias("width"),
        F.col("step").cast("int").alias("step"),
        rounded(objective).alias("objective_value"),
    )


@register(
    "trial_history_best",
    HISTORY_SQL
    + """SELECT *, min(objective_value) OVER (PARTITION BY motion_code ORDER BY repeat_idx, trial_idx) AS best_so_far FROM hist""",
)
def trial_history_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.best_so_far(trial_history(spark, sf_dir), ["motion_code"])


@register(
    "winning_trials",
    HISTORY_SQL
    + """SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY motion_code ORDER BY round(objective_value, 9), repeat_idx, trial_idx) = 1""",
)
def winning_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.winning_trial(trial_history(spark, sf_dir), ["motion_code"])


# --- trials as data -----------------------------------------------------------------------------

GRAPH_SCHEMES = ["HF2", "CF2"]
GRAPH_ROWS = [
    {**t, "target_scope": scope, "cascade_scheme": scheme, "adaptive_filter": "lms"} for t in TRIALS for scope in SCOPES for scheme in GRAPH_SCHEMES
]
WIDTH_LIST = ", ".join(
    f"quantile_cont(adaptive_hr, 0.5) OVER (PARTITION BY user_id, scope ORDER BY w ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING) AS s{w}" for w in WIDTHS
)
GRAPH_SQL = RESULT_SQL + f"""
, tried AS (SELECT * FROM (VALUES {", ".join(f"({t['repeat_idx']}, {t['trial_idx']}, {t['smooth_win_len']})" for t in TRIALS)}) v(repeat_idx, trial_idx, width))
, smoothed AS (SELECT motion_type, scope, ref_hr, {WIDTH_LIST} FROM res WHERE in_scope)
, each AS (UNPIVOT smoothed ON {", ".join(f"s{w}" for w in WIDTHS)} INTO NAME width_name VALUE rate)
, node AS (SELECT motion_type, scope, CAST(substr(width_name, 2) AS INTEGER) AS width, count(*) AS n, sum(round(abs(rate - ref_hr), 9)) AS total,
             count(*) FILTER (round(abs(rate - ref_hr), 9) <= 5) AS hits FROM each GROUP BY ALL)
, graph AS (SELECT motion_type, scope AS target_scope, cascade_scheme, repeat_idx, trial_idx, width, n, total / n AS aae, 100.0 * hits / n AS acc
            FROM tried JOIN node USING (width) CROSS JOIN (SELECT unnest(['HF2', 'CF2']) AS cascade_scheme))
"""


def trial_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of every trial of every mode per motion type; equal tuples are evaluated once."""
    stages = {"track": ["target_scope"], "smooth": ["smooth_win_len"]}
    tried, nodes = trials.graph(trials.trial_frame(spark, GRAPH_ROWS), stages)
    rows = results(spark, sf_dir).select("user_id", "motion_type", "w", "scope", "in_scope", "baseline_hr", "adaptive_hr", "ref_hr")
    rates = rows.join(nodes["track"].select("track_id", F.col("target_scope").alias("scope")), "scope").drop("scope")
    sums = trials.smoothed_sums(rates.withColumn("blk", F.expr(f"w div {SCAN_ROWS}")), nodes, ["user_id"])
    per = sums.withColumn("motion_type", motion_type_of()).groupBy("motion_type", "smooth_id").agg(*[F.sum(c).alias(c) for c in ("n", "abs_sum", "hits")])
    return tried.join(per.where("n > 0"), "smooth_id")


@register(
    "trial_graph_sums",
    GRAPH_SQL + "SELECT motion_type, target_scope, cascade_scheme, repeat_idx, trial_idx, width, n, round(aae, 6) AS aae, round(acc, 6)::DOUBLE AS acc FROM graph",
)
def trial_graph_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trial_graph(spark, sf_dir).select(
        "motion_type", "target_scope", "cascade_scheme", "repeat_idx", "trial_idx", F.col("smooth_win_len").alias("width"), "n",
        rounded(F.col("abs_sum") / F.col("n")).alias("aae"), rounded(F.col("hits") * 100.0 / F.col("n")).alias("acc"),
    )


DRAWS = [
    (t["repeat_idx"], t["trial_idx"], name, experiment.SEARCH_SPACE[name].index(t["LMS_Mu_Base" if name == "RFF_LMS_Mu_Base" else name]))
    for t in TRIALS for name in experiment.names_for_filter("lms")
]
STUDY_SQL = GRAPH_SQL + f"""
, drawn AS (SELECT * FROM (VALUES {", ".join(f"({r}, {t}, {o}, '{p}')" for r, t, p, o in DRAWS)}) v(repeat_idx, trial_idx, option, parameter))
, size AS (SELECT * FROM (VALUES {", ".join(f"({len(experiment.SEARCH_SPACE[n])}, '{n}')" for n in experiment.names_for_filter("lms"))}) v(n_options, parameter))
, history AS (SELECT motion_type || '|' || target_scope || '|' || cascade_scheme || '|' || CAST(repeat_idx AS VARCHAR) AS study, repeat_idx, trial_idx AS trial, aae AS value FROM graph)
, marked AS (SELECT study, repeat_idx, trial, row_number() OVER (PARTITION BY study ORDER BY round(value, 9), trial)
               <= greatest(1, least(25, ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY study)))) AS good FROM history)
, used AS (SELECT study, parameter, option, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad
           FROM marked m JOIN drawn d ON d.repeat_idx = m.repeat_idx AND d.trial_idx = m.trial GROUP BY ALL)
, options AS (SELECT study, parameter, n_options, unnest(range(n_options)) AS option FROM (SELECT DISTINCT study FROM history), size)
, counts AS (SELECT study, parameter, n_options, CAST(o.option AS INTEGER) AS option, coalesce(n_good, 0) AS n_good, coalesce(n_bad, 0) AS n_bad
             FROM options o LEFT JOIN used u USING (study, parameter, option))
, favours AS (SELECT *, ((n_good + 1) / (sum(n_good) OVER w + n_options)) / ((n_bad + 1) / (sum(n_bad) OVER w + n_options)) AS favour,
               sum(n_good + 1) OVER (PARTITION BY study, parameter ORDER BY option) AS ending, sum(n_good + 1) OVER w AS total
             FROM counts WINDOW w AS (PARTITION BY study, parameter))
"""


def study_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """History, draws and studies of the uniform trials of ``trial_graph``."""
    study = F.concat_ws("|", "motion_type", "target_scope", "cascade_scheme", "repeat_idx").alias("study")
    history = materialise(trial_graph(spark, sf_dir).select(study, "adaptive_filter", "repeat_idx", F.col("trial_idx").alias("trial"), (F.col("abs_sum") / F.col("n")).alias("value")), "history")
    drawn = spark.createDataFrame(DRAWS, "repeat_idx int, trial int, parameter string, option int")
    studies = history.select("study", "adaptive_filter", "repeat_idx").distinct()
    return history, studies.join(drawn, "repeat_idx").select("study", "trial", "parameter", "option"), studies


@register("trial_densities", STUDY_SQL + "SELECT study, parameter, option, n_good, n_bad, round(favour, 6) AS favour FROM favours")
def trial_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the good trials of each study favour each option of each parameter."""
    history, draws, _ = study_history(spark, sf_dir)
    rows = sampler.densities(history, draws, sampler.space_frame(spark, ("lms",)))
    return rows.withColumn("favour", rounded(F.col("favour")))


@register(
    "trial_proposals",
    STUDY_SQL
    + f""", spots AS (SELECT study, trial, parameter, c, total, CAST(('0x' || substr(sha256('42|' || study || '|' || CAST(trial AS VARCHAR) || '|' || parameter || '|' || CAST(c AS VARCHAR)), 9, 8)) AS BIGINT) AS h
             FROM (SELECT DISTINCT study, parameter, total FROM favours), range(20, 30) t(trial), range({sampler.CANDIDATES}) r(c))
    , picked AS (SELECT s.study, s.trial, s.parameter, c, f.option, favour FROM spots s JOIN favours f ON f.study = s.study AND f.parameter = s.parameter
             AND floor(h * s.total / 4294967296) < ending AND floor(h * s.total / 4294967296) >= ending - n_good - 1)
    SELECT study, CAST(trial AS INTEGER) AS trial, parameter, option FROM picked QUALIFY row_number() OVER (PARTITION BY study, trial, parameter ORDER BY favour DESC, c) = 1""",
)
def trial_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next ten trials of each study, learned from the first twenty."""
    history, draws, studies = study_history(spark, sf_dir)
    space = sampler.space_frame(spark, ("lms",))
    known = materialise(sampler.densities(history, draws, space), "densities")
    return sampler.propose(studies, space, known, 20, 10, 42)


SHARE_SQL = "CASE WHEN total > 1e-12 THEN between_ss / total ELSE 0 END"


@register(
    "param_effects",
    STUDY_SQL
    + f""", centred AS (SELECT study, repeat_idx, trial, value - avg(value) OVER (PARTITION BY study) AS c FROM history),
    turned AS (SELECT *, row_number() OVER (PARTITION BY study, shuffle ORDER BY trial) AS from_place,
        row_number() OVER (PARTITION BY study, shuffle ORDER BY CAST(('0x' || substr(sha256('7|' || study || '|' || CAST(trial AS VARCHAR) || '|' || CAST(shuffle AS VARCHAR)), 9, 8)) AS BIGINT), trial) AS to_place
      FROM centred, range(5) r(shuffle)),
    dealt AS (SELECT b.study, b.repeat_idx, b.shuffle, b.trial, a.c FROM turned a JOIN turned b ON a.study = b.study AND a.shuffle = b.shuffle AND a.from_place = b.to_place
      UNION ALL SELECT study, repeat_idx, -1, trial, c FROM centred),
    opt AS (SELECT study, shuffle, parameter, option, sum(c) AS s, count(*) AS n FROM dealt d JOIN drawn w ON w.repeat_idx = d.repeat_idx AND w.trial_idx = d.trial GROUP BY ALL),
    bet AS (SELECT study, shuffle, parameter, sum(s * s / n) AS between_ss FROM opt GROUP BY ALL),
    tot AS (SELECT study, shuffle, sum(c * c) AS total FROM dealt GROUP BY ALL),
    sh AS (SELECT study, shuffle, parameter, {SHARE_SQL} AS share FROM bet JOIN tot USING (study, shuffle))
    SELECT study, parameter, round(max(share) FILTER (shuffle = -1), 6) AS share, round(avg(share) FILTER (shuffle >= 0), 6) AS null_share FROM sh GROUP BY study, parameter""",
)
def param_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the objective each of the fourteen parameters explains, beside what chance would."""
    history, draws, _ = study_history(spark, sf_dir)
    rows = sampler.effects(history, materialise(draws, "drawn"), 7)
    return rows.select("study", "parameter", rounded(F.col("share")).alias("share"), rounded(F.col("null_share")).alias("null_share"))


# --- delays and biases --------------------------------------------------------------------------

DAILY_SQL = """WITH d AS (
  SELECT user_id, dayofmonth(ts) AS day, sum(value) FILTER (WHERE event_type = 'click') AS click,
    sum(value) FILTER (WHERE event_type = 'view') AS view, sum(value) FILTER (WHERE event_type = 'purchase') AS purchase,
    sum(value) FILTER (WHERE event_type = 'signup') AS signup
  FROM events GROUP BY ALL),
grid AS (SELECT DISTINCT user_id, unnest(generate_series(1, 31)) AS day FROM events),
s AS (SELECT g.user_id, g.day, coalesce(click, 0) AS click, coalesce(view, 0) AS view, coalesce(purchase, 0) AS purchase, coalesce(signup, 0) AS signup
      FROM grid g LEFT JOIN d ON d.user_id = g.user_id AND d.day = g.day),
u AS (UNPIVOT s ON view, purchase, signup INTO NAME channel VALUE y),
p AS (SELECT a.user_id, b.channel, CAST(lag AS INTEGER) AS lag, a.click AS x, b.y AS y
      FROM s a, unnest(generate_series(-5, 5)) l(lag), u b WHERE b.user_id = a.user_id AND b.day = a.day - lag),
c AS (SELECT user_id, channel, lag, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 1e-9 AND stddev_pop(y) > 1e-9 THEN corr(x, y) ELSE 0 END AS r
      FROM p GROUP BY ALL),
b AS (SELECT user_id, channel, lag, r FROM c QUALIFY row_number() OVER (PARTITION BY user_id, channel ORDER BY round(abs(r), 9) DESC, lag) = 1),
best AS (SELECT user_id, channel, CASE WHEN round(abs(r), 9) = 0 THEN 0 ELSE lag END AS lag, CASE WHEN round(abs(r), 9) = 0 THEN 0.0 ELSE r END AS r FROM b)
"""
CHANNELS = ["view", "purchase", "signup"]


def daily_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense daily sums per user and channel; a user has one row per calendar day, whatever its size."""
    events = table(spark, sf_dir, "events")
    daily = (
        events.groupBy("user_id", F.dayofmonth("ts").alias("day"))
        .pivot("event_type", ["click", *CHANNELS])
        .agg(F.sum("value"))
    )
    grid = daily.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(1), F.lit(31))).alias("day"))
    return grid.join(daily, ["user_id", "day"], "left").fillna(0.0)


def best_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_day = Window.partitionBy("user_id").orderBy("day")  # at most one row per calendar day
    return delay.best_lag(daily_channels(spark, sf_dir), ["user_id"], "click", CHANNELS, 5, by_day)


@register(
    "best_lag_corr",
    DAILY_SQL
    + """SELECT user_id, channel, CAST(lag AS INTEGER) AS lag, round(r, 6) AS r,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(abs(r), 9) DESC, list_position(['view', 'purchase', 'signup'], channel)) AS INTEGER) AS rank FROM best""",
)
def best_lag_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = delay.rank_channels(best_lags(spark, sf_dir), ["user_id"], CHANNELS)
    return ranked.withColumn("r", rounded(F.col("r")))


@register(
    "filter_design",
    DAILY_SQL
    + """SELECT user_id, channel,
      CAST(CASE WHEN lag > 0 THEN least(greatest(1, floor(abs(lag) * 1.2::DOUBLE)), 16) ELSE 2 END AS INTEGER) AS "M",
      CAST(CASE WHEN lag < 0 THEN least(12, floor(abs(lag) * 1.2::DOUBLE)) ELSE 0 END AS INTEGER) AS "K",
      round(greatest(1e-6, 0.01 - abs(r) / 100), 9) AS mu,
      CASE WHEN lag > 0 THEN 'causal' WHEN lag < 0 THEN 'noncausal' ELSE 'zero_delay' END AS mode FROM best""",
)
def filter_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_lags(spark, sf_dir)
    design = best.select("user_id", "channel", *delay.filter_design(F.col("lag"), F.col("r")))
    return design.withColumn("mu", rounded(F.col("mu"), 9))


@register(
    "shift_pad_series",
    SERIES_SQL
    + """SELECT user_id, event_id, lead(value, 3) OVER w AS ahead3, coalesce(lag(value, 3) OVER w, first_value(value) OVER w) AS behind3
    FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)""",
)
def shift_pad_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = event_series(spark, sf_dir)
    cols = [delay.shifted(lay, "value", 3).alias("ahead3"), delay.shifted(lay, "value", -3).alias("behind3")]
    return lay.df.select("core", "user_id", "event_id", *cols).where("core").drop("core")


@register(
    "tdelay_grid",
    SERIES_SQL
    + """, sh AS (SELECT user_id, i, k, CAST(d AS INTEGER) AS delay,
             CASE WHEN d >= 0 THEN list_extract(vals, CAST(i + d + 1 AS BIGINT)) ELSE list_extract(vals, CAST(greatest(i + d, 0) + 1 AS BIGINT)) END AS pred
           FROM e JOIN (SELECT user_id, list(value ORDER BY i) AS vals FROM e GROUP BY user_id) USING (user_id), unnest(generate_series(-4, 5)) g(d)),
    sc AS (SELECT user_id, delay, count(pred - k) AS n_valid, avg(abs(pred - k)) AS aae, stddev_pop(pred - k) AS std, sqrt(avg((pred - k) * (pred - k))) AS rmse
           FROM sh GROUP BY ALL)
    SELECT user_id, delay, n_valid, round(aae, 6) AS aae, round(std, 6) AS std, round(rmse, 6) AS rmse FROM sc
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(aae, 9), abs(delay), round(rmse, 9), round(std, 9), delay) = 1""",
)
def tdelay_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = event_series(spark, sf_dir)
    grid = F.array(*[
        F.struct(F.lit(d).alias("delay"), (delay.shifted(lay, "value", d) - F.col("k")).alias("err")) for d in range(-4, 6)
    ])
    rows = lay.df.select("core", "user_id", grid.alias("_p")).where("core").select("user_id", F.inline("_p"))
    scores = interpolate.bias_scores(rows, ["user_id"], "delay", "err")
    best = metrics.pick_best(scores, ["user_id"], "delay", "aae", ["rmse", "std"])
    return best.select("user_id", "delay", "n_valid", *[rounded(F.col(c)).alias(c) for c in ("aae", "std", "rmse")])


POINT_SQL = SERIES_SQL + """
, iv AS (SELECT user_id, t AS t0, reading AS v0, lead(t) OVER w AS t1, lead(reading) OVER w AS v1
         FROM e WHERE reading IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY i))
, pt AS (SELECT user_id, event_id, value AS pred, CAST(b AS INTEGER) AS bias_h, t + b * 3600.0::DOUBLE AS t
         FROM e, unnest(generate_series({lo}, {hi})) g(b) WHERE reading IS NULL)
, ip AS (SELECT pt.*, CASE WHEN t1 IS NULL THEN CASE WHEN t = t0 THEN v0 END ELSE v0 + (v1 - v0) / (t1 - t0) * (t - t0) END AS ref
         FROM pt ASOF LEFT JOIN iv ON pt.user_id = iv.user_id AND pt.t >= iv.t0)
"""


def interpolated_points(spark: SparkSession, sf_dir: str, lo: int, hi: int) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    points = rows.where("reading IS NULL").select(
        "user_id",
        "event_id",
        F.col("value").alias("pred"),
        F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("bias_h"),
        "t",
    )
    points = points.withColumn("t", F.col("t") + F.col("bias_h") * 3600.0)
    samples = rows.where("reading IS NOT NULL").select("user_id", "t", "reading")
    return interpolate.interpolate_at(samples, points, ["user_id"], "t", "reading", derived=False).withColumnRenamed("reading", "ref")


@register(
    "interp_join",
    POINT_SQL.format(lo=0, hi=0) + "SELECT user_id, event_id, pred, round(ref, 6) + 0.0 AS ref FROM ip",
)
def interp_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_points(spark, sf_dir, 0, 0).select("user_id", "event_id", "pred", rounded(F.col("ref")).alias("ref"))


@register(
    "time_bias_search",
    POINT_SQL.format(lo=-5, hi=5)
    + """, sc AS (SELECT user_id, bias_h, count(ref) AS n_valid, avg(abs(pred - ref)) AS aae, stddev_pop(pred - ref) AS std, sqrt(avg((pred - ref) * (pred - ref))) AS rmse
          FROM ip GROUP BY ALL)
    SELECT user_id, bias_h, n_valid, round(aae, 6) AS aae, round(std, 6) AS std, round(rmse, 6) AS rmse FROM sc WHERE n_valid >= 2
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(aae, 9), abs(bias_h), round(rmse, 9), round(std, 9), bias_h) = 1""",
)
def time_bias_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interpolated_points(spark, sf_dir, -5, 5).withColumn("err", F.col("pred") - F.col("ref"))
    scores = interpolate.bias_scores(rows, ["user_id"], "bias_h", "err")
    best = metrics.pick_best(scores, ["user_id"], "bias_h", "aae", ["rmse", "std"])
    return best.where("n_valid >= 2").select(
        "user_id", "bias_h", "n_valid", *[rounded(F.col(c)).alias(c) for c in ("aae", "std", "rmse")]
    )


@register(
    "posthoc_aggregate",
    RESULT_SQL
    + """, run AS (SELECT *, CASE WHEN motion_type = 'bobi' THEN 2.0 WHEN motion_type = 'kaihe' THEN -1.0 WHEN motion_type = 'tiaosheng' THEN CAST(user_id % 2 AS DOUBLE) ELSE CAST(user_id % 3 AS DOUBLE) END AS bias FROM res WHERE scope = 'motion_recovery')
    SELECT motion_type, CASE WHEN count(DISTINCT bias) = 1 THEN min(bias) END AS time_bias_s,
      CASE WHEN count(DISTINCT bias) = 0 THEN '' WHEN count(DISTINCT bias) = 1 THEN 'posthoc_oracle_alignment' ELSE 'per_run_posthoc_oracle_alignment' END AS mode,
      round(avg(abs(ae - coalesce(bias, 0))) FILTER (WHERE in_scope AND bias IS NOT NULL), 6) AS posthoc_aae,
      CAST(count(*) FILTER (WHERE in_scope AND bias IS NOT NULL) AS BIGINT) AS n_valid FROM run GROUP BY motion_type""",
)
def posthoc_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("motion_type")
    bias = F.when(kind == "bobi", 2.0).when(kind == "kaihe", -1.0).when(kind == "tiaosheng", (F.col("user_id") % 2).cast("double"))
    bias = bias.otherwise((F.col("user_id") % 3).cast("double"))
    rows = results(spark, sf_dir).where("scope = 'motion_recovery'").withColumn("bias", bias)
    rows = rows.withColumn("err_after", F.when(F.col("bias").isNotNull() & F.col("in_scope"), F.col("err") - F.col("bias")))
    return experiment.posthoc_summary(rows, ["motion_type"])


@register(
    "stable_unique_ids",
    """SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM events GROUP BY user_id""",
)
def stable_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n")
    )
