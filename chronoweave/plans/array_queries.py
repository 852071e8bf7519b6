"""Registered queries over ``embeddings``: each vector is one window of 64 samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import adaptive, arrays, iir
from chronoweave.functions.columns import rounded, steady_mean
from chronoweave.operators import windows
from chronoweave.operators.delay import filter_design
from chronoweave.plans.filter_sql import zero_phase_sql
from chronoweave.plans.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


FS = 16.0
SALTS = 64
ROLES = ["ppg_green", "hf1", "hf2", "cf1", "cf2", "accx", "accy", "accz"]
BASE_SQL = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)\n"
POINT_SQL = BASE_SQL + ", p AS (SELECT vec_id, unnest(a) AS x, unnest(generate_series(0, 63)) AS n FROM v)\n"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", arrays.doubles("embedding").alias("a"))


def role_windows(spark: SparkSession, sf_dir: str, roles: list[str]) -> DataFrame:
    """Windows of several channels: vector ``v + r`` is channel ``r`` of window ``v``.

    One shuffle brings all channels together; a window has at most one vector per role.
    """
    targets = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), (F.col("vec_id") - F.lit(j)).alias("win")) for j, r in enumerate(roles)]))
    rows = vectors(spark, sf_dir).select("a", targets.alias("t"))
    wide = rows.groupBy(F.col("t.win").alias("win")).agg(*[F.first(F.when(F.col("t.role") == r, F.col("a")), ignorenulls=True).alias(r) for r in roles])
    complete = F.lit(True)
    for r in roles:
        complete = complete & F.col(r).isNotNull()
    return wide.where(complete)


def per_sample(df: DataFrame, key: str, array: str, name: str, places: int = 6) -> DataFrame:
    return df.select(key, F.posexplode(array).alias("n", name)).withColumn(name, rounded(F.col(name), places))


@register(
    "minmax_normalise",
    BASE_SQL
    + """SELECT vec_id, list_transform(a, lambda x: round(CAST((x - list_min(a)) / (list_max(a) - list_min(a)) AS FLOAT)::DOUBLE, 5) + 0.0) AS scaled FROM v""",
)
def minmax_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = arrays.doubles(arrays.minmax(F.col("a")))
    return vectors(spark, sf_dir).select("vec_id", arrays.rounded_array(scaled, 5).alias("scaled"))


Z_SQL = """SELECT p.vec_id, n, round((x - mu) / sd0, 6) + 0.0 AS z_pop, round((x - mu) / sd1, 6) + 0.0 AS z_sample
FROM p JOIN (SELECT vec_id, avg(x) AS mu, stddev_pop(x) AS sd0, stddev_samp(x) AS sd1 FROM p GROUP BY vec_id) s USING (vec_id)"""


@register("zscore_window", POINT_SQL + Z_SQL)
def zscore_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = vectors(spark, sf_dir).select(
        "vec_id", arrays.standardise(F.col("a"), 0).alias("z0"), arrays.standardise(F.col("a"), 1).alias("z1")
    )
    zipped = both.select("vec_id", F.posexplode(F.arrays_zip("z0", "z1")).alias("n", "z"))
    return zipped.select(
        "vec_id", F.col("n").cast("long").alias("n"), rounded(F.col("z.z0")).alias("z_pop"), rounded(F.col("z.z1")).alias("z_sample")
    )


@register(
    "energy_argmax",
    POINT_SQL
    + """, en AS (SELECT vec_id, CAST(n // 16 AS INTEGER) AS axis, count(*) * var_pop(x) AS energy FROM p GROUP BY ALL)
    SELECT vec_id, axis, round(energy, 6) AS energy FROM en QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(energy, 9) DESC, axis) = 1""",
)
def energy_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis of the largest energy, the window being four axes of 16 samples."""
    axes = [F.struct(F.round(arrays.energy(F.slice("a", 1 + 16 * j, 16)), 9).alias("energy"), F.lit(-j).alias("m")) for j in range(4)]
    best = F.array_max(F.array(*axes))
    return vectors(spark, sf_dir).select("vec_id", (-best["m"]).alias("axis"), rounded(best["energy"]).alias("energy"))


@register(
    "shift_pad",
    BASE_SQL + "SELECT vec_id, a[6:] AS ahead, list_concat([a[1], a[1], a[1]], a[:61]) AS behind FROM v",
)
def shift_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(
        "vec_id", arrays.shift_pad(F.col("a"), 5).alias("ahead"), arrays.shift_pad(F.col("a"), -3).alias("behind")
    )


@register(
    "tap_matrix",
    BASE_SQL
    + "SELECT vec_id, CAST(n AS INTEGER) AS n, [a[n + 3], a[n + 2], a[n + 1], a[n], a[n - 1]] AS taps FROM v, unnest(generate_series(2, 61)) g(n)",
)
def tap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.inline(arrays.tap_rows(F.col("a"), 3, 2)))


@register(
    "near_biggest",
    """WITH
 d AS (SELECT user_id, dayofmonth(ts) AS day, list(value ORDER BY value DESC, event_id)[:5] AS c, avg(value) AS prev FROM events GROUP BY ALL),
    f AS (SELECT *, coalesce(list_position(list_transform(c, lambda x: abs(x - prev) < 10), true), 0) AS place FROM d)
    SELECT user_id, CAST(day AS INTEGER) AS day, CAST(place AS INTEGER) AS place, round(CASE WHEN place > 0 THEN c[place] ELSE prev END, 6) AS value FROM f""",
)
def near_biggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest candidates of a user's day near the day's mean."""
    day = day_candidates(spark, sf_dir)
    found = arrays.near_biggest(F.col("ranked"), F.col("prev"), F.lit(10.0))
    return day.select("user_id", "day", found.alias("f")).select(
        "user_id", "day", F.col("f.place").alias("place"), rounded(F.col("f.value")).alias("value")
    )


def day_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five largest values of each user and day, and the day's mean.

    Ranks are taken per salt first and only five rows per salt pass, before and after the shuffle,
    so a hot day is split over many tasks and its final group holds a few hundred rows at most.
    """
    events = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("day"), "value", "event_id")
    mean = events.groupBy("user_id", "day").agg(steady_mean("value").alias("prev"))
    salted = events.withColumn("_salt", F.pmod(F.hash("event_id"), F.lit(SALTS)))
    strongest = Window.partitionBy("user_id", "day", "_salt").orderBy(F.desc("value"), "event_id")
    item = F.struct("value", (-F.col("event_id")).alias("k"))
    top = (
        salted.withColumn("_r", F.row_number().over(strongest))
        .where("_r <= 5")
        .groupBy("user_id", "day")
        .agg(F.sort_array(F.collect_list(item), asc=False).alias("top"))
    )
    ranked = F.transform(F.slice("top", 1, 5), lambda c: c["value"])
    return top.join(mean, ["user_id", "day"]).select("user_id", "day", "prev", ranked.alias("ranked"))


# --- adaptive filters ---------------------------------------------------------------------------

PAIR_SQL = POINT_SQL.replace("WITH v", "WITH RECURSIVE v") + """
, st AS (SELECT vec_id, avg(x) AS mu, stddev_samp(x) AS sd FROM p GROUP BY vec_id)
, z AS (SELECT v.vec_id, list_transform(a, lambda x: (x - mu) / sd) AS z FROM v JOIN st USING (vec_id))
, w AS (SELECT d.vec_id AS win, d.z AS d, u.z AS u FROM z d JOIN z u ON u.vec_id = d.vec_id + 1)
"""


def _recursion(size: int, features: str, gains: str) -> str:
    """SQL of the recursive weight update with ``size`` features per step (M=2, K=1, 64 samples)."""
    zeros = ", ".join(f"0.0::DOUBLE AS w{j}" for j in range(size))
    weights = ", ".join(f"w{j}" for j in range(size))
    update = ", ".join(f"w{j} + g{j} * f{j} * err AS w{j}" for j in range(size))
    guess = " + ".join(f"w{j} * f{j}" for j in range(size))
    return f"""
, rec AS (
  SELECT win, 0 AS n, 0.0::DOUBLE AS err, {zeros} FROM w
  UNION ALL
  SELECT win, n, err, {update} FROM (
    SELECT *, {gains} FROM (
      SELECT *, dn - ({guess}) AS err FROM (
        SELECT *, {features} FROM (
          SELECT rec.win, rec.n + 1 AS n, {weights}, w.d[rec.n + 2] AS dn, w.u[rec.n + 3] AS x0, w.u[rec.n + 2] AS x1, w.u[rec.n + 1] AS x2
          FROM rec JOIN w ON w.win = rec.win WHERE rec.n < 62))))
)
SELECT win, CAST(n AS INTEGER) AS n, round(err, 6) + 0.0 AS residual FROM rec WHERE n > 0
UNION ALL SELECT win, e AS n, round(d[e + 1], 6) + 0.0 AS residual FROM w, (VALUES (0), (63)) g(e)"""


def _filtered(spark: SparkSession, sf_dir: str, kind: str, mu: float, **options) -> DataFrame:
    pairs = role_windows(spark, sf_dir, ["d", "u"])
    done = pairs.select("win", windows.adaptive_filter("u", "d", kind, 2, 1, mu, **options).alias("out"))
    return per_sample(done, "win", "out", "residual")


@register(
    "nlms_filter",
    PAIR_SQL
    + _recursion(
        3,
        "x0 AS f0, x1 AS f1, x2 AS f2",
        ", ".join(f"0.01 / (f0 * f0 + f1 * f1 + f2 * f2 + 1e-9) AS g{j}" for j in range(3)),
    ),
)
def nlms_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "lms", 0.01)


@register(
    "volterra_filter",
    PAIR_SQL
    + _recursion(
        6,
        "x0 AS f0, x1 AS f1, x2 AS f2, x1 * x1 AS f3, x1 * x2 AS f4, x2 * x2 AS f5",
        ", ".join(f"0.01 / (f0 * f0 + f1 * f1 + f2 * f2 + 1e-9) AS g{j}" for j in range(3))
        + ", "
        + ", ".join(f"0.001 / (f3 * f3 + f4 * f4 + f5 * f5 + 1e-9) AS g{j}" for j in range(3, 6)),
    ),
)
def volterra_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "volterra", 0.01, alpha_u=0.1, M2=2, LMS_Mu_Min=1e-6)


RFF_SIZE, RFF_SEED = 6, 11


def _rff_features() -> str:
    weights, phase = adaptive.fourier_weights(RFF_SIZE, 3, 1.0, RFF_SEED)
    scale = repr(float(np.sqrt(2.0 / RFF_SIZE)))
    terms = [" + ".join(f"({float(w)!r}) * x{i}" for i, w in enumerate(row)) for row in weights]
    return ", ".join(f"{scale} * cos({t} + {float(b)!r}) AS f{j}" for j, (t, b) in enumerate(zip(terms, phase)))


@register("rff_lms", PAIR_SQL + _recursion(RFF_SIZE, _rff_features(), ", ".join(f"0.01 AS g{j}" for j in range(RFF_SIZE))))
def rff_lms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "rff_lms", 0.01, rff_D=RFF_SIZE, rff_sigma=1.0, rff_seed=RFF_SEED)


# --- spectra ------------------------------------------------------------------------------------

DFT_SQL = POINT_SQL + """
, h AS (SELECT vec_id, n, (x - avg(x) OVER (PARTITION BY vec_id)) * (0.54 - 0.46 * cos(2 * pi() * n / {den})) AS y FROM p)
, f AS (SELECT vec_id, CAST(k AS INTEGER) AS k, sqrt(pow(sum(y * cos(2 * pi() * k * n / 64)), 2) + pow(sum(y * sin(2 * pi() * k * n / 64)), 2)) AS amp
        FROM h, unnest(generate_series(0, 32)) g(k) GROUP BY ALL)
"""


@register("magnitude_spectrum", DFT_SQL.format(den=64) + "SELECT vec_id, k, round(amp, 6) + 0.0 AS amp FROM f")
def magnitude_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = vectors(spark, sf_dir).select("vec_id", windows.magnitude_spectrum("a", FS, 64).alias("amp"))
    return per_sample(done.withColumnRenamed("amp", "s"), "vec_id", "s", "amp").withColumnRenamed("n", "k")


@register(
    "dominant_frequency",
    DFT_SQL.format(den=64)
    + """, q AS (SELECT *, lag(amp) OVER w AS before, lead(amp) OVER w AS after FROM f WHERE k BETWEEN 2 AND 16 WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
    s AS (SELECT *, coalesce(amp > before AND amp > after, false) AS peak FROM q)
    SELECT vec_id, k * 0.25::DOUBLE AS peak_hz, (SELECT arg_max(k, amp) FROM q m WHERE m.vec_id = s.vec_id) * 0.25::DOUBLE AS max_hz
    FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY peak DESC, amp DESC) = 1""",
)
def dominant_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(
        "vec_id",
        windows.dominant_frequency("a", FS, 0.5, 4.0, 64).alias("peak_hz"),
        windows.band_maximum([F.col("a")], FS, 0.5, 4.0, 64).alias("max_hz"),
    )


@register(
    "fft_peaks",
    DFT_SQL.format(den=63)
    + """, o AS (SELECT vec_id, k, amp / 64 * CASE WHEN k = 0 THEN 1 ELSE 2 END AS amp FROM f WHERE k < 32),
    q AS (SELECT *, lag(amp) OVER w AS before, lead(amp) OVER w AS after FROM o WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
    c AS (SELECT vec_id, k, amp, max(amp) OVER (PARTITION BY vec_id) AS top FROM q WHERE amp > before AND amp > after AND k BETWEEN 2 AND 16)
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY amp DESC) AS place, k * 0.25::DOUBLE AS freq, round(amp, 6) + 0.0 AS amp FROM c WHERE amp > 0.3 * top""",
)
def fft_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = windows.peak_list("a", FS, 0.5, 4.0, 0.3, nfft=64)
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode(peaks).alias("p", "c"))
    return rows.select("vec_id", (F.col("p") + 1).cast("long").alias("place"), F.col("c.freq").alias("freq"), rounded(F.col("c.amp")).alias("amp"))


# --- delays and cascades on windows -------------------------------------------------------------

LAG_SQL = POINT_SQL + """
, l AS (SELECT a.vec_id AS win, c.ch AS channel, CAST(d AS INTEGER) AS lag, corr(a.x, b.x) AS r
        FROM p a, unnest(generate_series(-8, 8)) g(d), (VALUES ('hf1', 1), ('hf2', 2)) c(ch, step), p b
        WHERE b.vec_id = a.vec_id + c.step AND b.n = a.n - d AND a.vec_id + 2 IN (SELECT vec_id FROM v) GROUP BY ALL)
"""


@register(
    "window_lag_corr",
    LAG_SQL
    + """SELECT win, channel, lag, round(r, 6) + 0.0 AS r FROM l
    QUALIFY row_number() OVER (PARTITION BY win, channel ORDER BY round(abs(r), 9) DESC, lag) = 1""",
)
def window_lag_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = role_windows(spark, sf_dir, ["ppg_green", "hf1", "hf2"])
    found = wide.select("win", F.inline(windows.window_delays("ppg_green", ["hf1", "hf2"], FS)))
    return found.withColumn("r", rounded(F.col("r")))


def filtered_windows(spark: SparkSession, sf_dir: str, scheme: str, kind: str, mode: str, **options) -> DataFrame:
    others = [c for g in windows.GROUPS.values() for c in g]
    wide = role_windows(spark, sf_dir, ROLES)
    found = wide.withColumn("delays", windows.window_delays("ppg_green", others, FS, mode=mode))
    design = lambda lag, r: filter_design(lag, r)
    return windows.cascade(found, "ppg_green", scheme, kind, "delays", design, **options)


@register("cascade_filter")
def cascade_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-group LMS cascade in envelope mode (unit-tested against plain loops)."""
    done = filtered_windows(spark, sf_dir, "HF2_ACC3", "lms", "envelope")
    return per_sample(done, "win", "filtered", "residual")


@register("cascade_stages")
def cascade_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage records of the Volterra cascade as JSON, and back."""
    done = filtered_windows(spark, sf_dir, "CF2", "volterra", "direct", alpha_u=0.1, M2=3)
    text = done.select("win", F.to_json("stages").alias("stages_json"))
    schema = done.schema["stages"].dataType
    return text.select("win", F.posexplode(F.from_json("stages_json", schema)).alias("stage", "s")).select("win", "stage", "s.*")


ENVELOPE_SQL = (
    POINT_SQL.replace("WITH v", "WITH RECURSIVE v")
    + """, c AS (SELECT vec_id, n, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM p)
    , hb AS (SELECT a.vec_id, a.n, a.x, sum(CASE WHEN (a.n - b.n) % 2 <> 0 THEN b.x * 2 / 64.0::DOUBLE / tan(pi() * (a.n - b.n) / 64) ELSE 0 END) AS h
             FROM c a JOIN c b ON b.vec_id = a.vec_id GROUP BY ALL)
    , ev AS (SELECT vec_id, n AS i, sqrt(x * x + h * h) AS v FROM hb)"""
    + zero_phase_sql("ev", "vec_id", iir.butter_lowpass(2, 0.3 / (FS / 2.0)), "q")
    + """SELECT o.vec_id, CAST(o.i AS INTEGER) AS n, round((o.v - mu) / sd, 6) + 0.0 AS envelope
    FROM q_out o JOIN (SELECT vec_id, avg(v) AS mu, stddev_pop(v) AS sd FROM q_out GROUP BY vec_id) s ON s.vec_id = o.vec_id"""
)


@register("window_envelope", ENVELOPE_SQL)
def window_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = vectors(spark, sf_dir).select("vec_id", windows.envelope("a", FS).alias("env"))
    return per_sample(done, "vec_id", "env", "envelope")


@register(
    "motion_frequency",
    POINT_SQL
    + """, ax AS (SELECT vec_id, n // 16 AS axis, n % 16 AS j, x FROM p),
    en AS (SELECT vec_id, axis, count(*) * var_pop(x) AS energy FROM ax GROUP BY ALL),
    b AS (SELECT vec_id, axis FROM en QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(energy, 9) DESC, axis) = 1),
    h AS (SELECT vec_id, j, (x - avg(x) OVER (PARTITION BY vec_id)) * (0.54 - 0.46 * cos(2 * pi() * j / 16)) AS y FROM ax JOIN b USING (vec_id, axis)),
    f AS (SELECT vec_id, k, sqrt(pow(sum(y * cos(2 * pi() * k * j / 16)), 2) + pow(sum(y * sin(2 * pi() * k * j / 16)), 2)) AS amp FROM h, unnest(generate_series(1, 5)) g(k) GROUP BY ALL)
    SELECT vec_id, arg_max(k, amp)::DOUBLE AS move_hz FROM f GROUP BY vec_id""",
)
def motion_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main frequency of the axis with the most energy, four axes of 16 samples."""
    axes = [F.slice("a", 1 + 16 * j, 16) for j in range(4)]
    return vectors(spark, sf_dir).select("vec_id", windows.band_maximum(axes, FS, 0.2, 5.0, 16).alias("move_hz"))
