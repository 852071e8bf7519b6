"""Registered queries: ordered trackers, band-pass and resampling of whole recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions import arrays, iir
from chronoweave.functions.columns import rounded
from chronoweave.operators import filtering, tracking
from chronoweave.operators.blocks import block_arrays, stateful_scan, unpack
from chronoweave.operators.series import lay_out
from chronoweave.plans.array_queries import day_candidates
from chronoweave.plans.filter_sql import zero_phase_sql
from chronoweave.plans.series_queries import SERIES_SQL
from chronoweave.plans.tables import event_series

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@register(
    "slew_limit",
    SERIES_SQL.replace("WITH e", "WITH RECURSIVE e")
    + """, r AS (
      SELECT user_id, i, event_id, reading AS v FROM e WHERE i = 0
      UNION ALL
      SELECT e.user_id, e.i, e.event_id,
        CASE WHEN r.v IS NULL THEN e.reading WHEN e.reading IS NULL THEN r.v WHEN abs(e.reading - r.v) <= 6 THEN e.reading
             WHEN e.reading > r.v THEN r.v + 4 ELSE r.v - 4 END
      FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, event_id, round(v, 6) + 0.0 AS limited FROM r""",
)
def slew_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = event_series(spark, sf_dir)
    done = tracking.slew_limited(lay, "reading", keep=["event_id"])
    return done.select("user_id", "event_id", rounded(F.col("limited")).alias("limited"))


@register(
    "rest_tracker",
    """WITH RECURSIVE d AS (SELECT user_id, dayofmonth(ts) AS day, list(value ORDER BY value DESC, event_id)[:5] AS c FROM events GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i FROM d),
    r AS (
      SELECT user_id, day, i, c[1] / 60 * 60 AS v FROM n WHERE i = 0
      UNION ALL
      SELECT user_id, day, i, CASE WHEN abs(cand - prev) <= 6 THEN cand WHEN cand > prev THEN prev + 4 ELSE prev - 4 END AS v FROM (
        SELECT n.user_id, n.day, n.i, r.v AS prev,
          coalesce(list_filter(n.c, lambda x: abs(x / 60 - r.v / 60) < 30.0::DOUBLE / 60)[1] / 60 * 60, r.v / 60 * 60) AS cand
        FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1))
    SELECT user_id, CAST(day AS INTEGER) AS day, round(v, 6) + 0.0 AS tracked,
      round(quantile_cont(v, 0.5) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) + 0.0 AS smooth FROM r""",
)
def rest_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked rate per user and day from the day's strongest candidates, then smoothed over three days."""
    from chronoweave.operators.missing import smooth_short

    days = day_candidates(spark, sf_dir).select("user_id", "day", F.transform("ranked", lambda c: c / 60.0).alias("freqs"))
    lay = lay_out(days, ["user_id"], ["day"], label="days", derived=True)

    def fold(block: dict, carry: list | None):
        return tracking.track_rest(block["freqs"], carry, band=30.0, limit=6.0, step=4.0)

    blocks = block_arrays(lay, ["freqs"])
    done = stateful_scan(blocks, ["user_id"], ["freqs"], fold, T.DoubleType(), spans_blocks=lay.spans_blocks)
    rows = unpack(done, lay, {"out": "tracked"})
    tracked = lay.with_df(lay.df.join(rows.select("user_id", "i", "tracked"), ["user_id", "i"]))
    return smooth_short(tracked, "tracked", 3).select(
        "user_id", "day", rounded(F.col("tracked")).alias("tracked"), rounded(F.col("smooth")).alias("smooth")
    )


@register(
    "bandpass_series",
    SERIES_SQL.replace("WITH e", "WITH RECURSIVE e")
    + ", sv AS (SELECT user_id, i, value AS v FROM e), sk AS (SELECT user_id, i, k AS v FROM e)"
    + zero_phase_sql("sv", "user_id", filtering.band_sections(10.0, 0.5, 5.0), "v")
    + zero_phase_sql("sk", "user_id", filtering.band_sections(10.0, 0.1, 5.0), "k")
    + "SELECT a.user_id, a.i, round(a.v, 4) + 0.0 AS value, round(b.v, 4) + 0.0 AS k FROM v_out a JOIN k_out b ON b.user_id = a.user_id AND b.i = a.i",
)
def bandpass_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-phase band-pass of two channels at 10 Hz (unit-tested against a plain recursion)."""
    lay = event_series(spark, sf_dir)
    done = filtering.bandpass(lay, {"value": (0.5, 5.0), "k": (0.1, 5.0)}, 10.0)
    return done.select("user_id", "i", rounded(F.col("value"), 4).alias("value"), rounded(F.col("k"), 4).alias("k"))


def _taps_sql(fs_in: int, fs_out: int) -> str:
    up, down, taps = iir.resample_taps(fs_in, fs_out)
    half = len(taps) // 2
    rows = ", ".join(f"({j - half}, {float(t)!r})" for j, t in enumerate(taps))
    return f""", tap AS (SELECT * FROM (VALUES {rows}) v(lag, h))
    , n AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id)
    , o AS (SELECT user_id, unnest(generate_series(0, CAST(ceil(n * {up} / {down}.0) AS BIGINT) - 1)) AS j FROM n)
    SELECT o.user_id, o.j, round(o.j / {fs_out}.0, 6) AS t, round(coalesce(sum(e.value * h), 0), 6) + 0.0 AS value
    FROM o JOIN tap ON (o.j * {down} - lag) % {up} = 0
    LEFT JOIN e ON e.user_id = o.user_id AND e.i = (o.j * {down} - lag) // {up}
    GROUP BY o.user_id, o.j"""


@register("resample_series", SERIES_SQL + _taps_sql(4, 2))
def resample_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = filtering.resample(event_series(spark, sf_dir), "value", 4, 2)
    return done.select("user_id", "j", rounded(F.col("t")).alias("t"), rounded(F.col("value")).alias("value"))


@register("resample_up", SERIES_SQL + _taps_sql(2, 3))
def resample_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = filtering.resample(event_series(spark, sf_dir), "value", 2, 3)
    return done.select("user_id", "j", rounded(F.col("t")).alias("t"), rounded(F.col("value")).alias("value"))
