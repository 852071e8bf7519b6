"""Interpolating as-of join of points with the samples of the same recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.metrics import score_columns
from chronoweave.operators.missing import linear_between
from chronoweave.operators.series import bracket, lay_out


def interpolate_at(samples: DataFrame, points: DataFrame, key: list[str], x: str, v: str, *, derived: bool = True, **layout_options) -> DataFrame:
    """Linear interpolation of ``samples(key, x, v)`` at ``points(key, x, ...)``; NULL outside.

    Samples and points form one ordered series that is laid out in blocks; each point then sees the
    sample before and after it.  Neither a range join nor a hot recording can grow a task.
    ``derived=False`` says that both inputs are cheap to read again (plain table scans).
    """
    payload = [c for c in points.columns if c not in (*key, x)]
    pts = points.select(*key, x, F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_kind"), F.struct(*payload).alias("_p"))
    none = F.lit(None).cast(pts.schema["_p"].dataType)
    smp = samples.where(F.col(v).isNotNull() & F.col(x).isNotNull()).select(
        *key, x, F.col(v).alias("_v"), F.lit(0).alias("_kind"), none.alias("_p")
    )
    lay = lay_out(smp.unionByName(pts), key, [x, "_kind"], label="interp", derived=derived, **layout_options)
    rows = bracket(lay, lay.core(), "_v", x)
    return rows.where("_kind = 1").select(*key, x, linear_between(x).alias(v), "_p.*")


def bias_scores(rows: DataFrame, key: list[str], candidate: str, err: str, min_valid: int = 2) -> DataFrame:
    """Score every candidate shift of a recording."""
    return rows.groupBy(*key, candidate).agg(*score_columns(F.col(err), min_valid))
