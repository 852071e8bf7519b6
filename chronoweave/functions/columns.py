"""Column helpers with the missing-value rules of the library: missing is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(col: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = F.col(col) if isinstance(col, str) else col
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(c) & (c != inf) & (c != -inf), c)


def as_number(col: Column | str) -> Column:
    """Text to DOUBLE; text that is no finite number becomes NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return finite(F.trim(c).try_cast("double"))


HALF_UP_NUDGE = 2.7e-10


def rounded(col: Column, places: int = 6) -> Column:
    """Rounded value for reports, without negative zero.

    Means of two-decimal readings often end exactly on a half.  The nudge, far below the last
    digit shown, sends such halves up whatever order the parts were summed in.
    """
    return F.round(col + HALF_UP_NUDGE if places == 6 else col, places) + F.lit(0.0)


def steady_mean(col: Column | str) -> Column:
    """Mean (an aggregate) that does not follow the order in which the rows come.

    Readings that 20 decimals hold exactly are added as decimals, so a comparison with the mean
    has one outcome on any partitioning.  Groups with others get the plain mean.
    """
    c = F.col(col) if isinstance(col, str) else col
    exact = c.try_cast("decimal(38,20)")
    held = F.count_if(exact.cast("double") == c) == F.count(c)
    return F.coalesce(F.when(held, F.try_sum(exact).cast("double") / F.nullif(F.count(c), F.lit(0))), F.avg(c))


def magnitude(*cols: str) -> Column:
    total = F.col(cols[0]) * F.col(cols[0])
    for name in cols[1:]:
        total = total + F.col(name) * F.col(name)
    return F.sqrt(total)


def guarded_corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from sums; 0 for fewer than 3 points or a constant side."""
    vx = sxx - sx * sx / F.nullif(n, F.lit(0))
    vy = syy - sy * sy / F.nullif(n, F.lit(0))
    cov = sxy - sx * sy / F.nullif(n, F.lit(0))
    ok = (n >= 3) & (vx > 1e-12) & (vy > 1e-12)
    return F.when(ok, cov / F.sqrt(vx * vy)).otherwise(F.lit(0.0))


def clock_seconds(col: Column | str) -> Column:
    """``HH:MM:SS`` text to seconds; NULL for any other text."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.transform(F.split(F.trim(c), ":"), lambda p: p.try_cast("double"))
    folded = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60.0 + p)
    return F.when(F.size(parts) == 3, folded)


def segment_label(center: Column, start: Column, end: Column) -> Column:
    return F.when(center < start, "rest").when(center <= end, "motion").otherwise("recovery")


def in_scope(label: Column, scope: Column, center: Column, end: Column, after_s: float = 10.0) -> Column:
    """Is a window inside the target scope (motion, motion plus 10 s, motion plus recovery)?"""
    motion = label == "motion"
    return (
        F.when(scope == "motion_only", motion)
        .when(scope == "motion_post10", motion | F.coalesce((center > end) & (center <= end + after_s), F.lit(False)))
        .when(scope == "motion_recovery", label.isin("motion", "recovery"))
        .otherwise(F.lit(False))
    )


def truthy(col: Column) -> Column:
    return F.lower(F.trim(col.cast("string"))).isin("true", "1", "yes", "y")


def window_label(seconds: Column) -> Column:
    """``8.0`` -> ``TW8``, ``8.5`` -> ``TW8p5``."""
    whole = seconds == F.floor(seconds)
    return F.concat(
        F.lit("TW"),
        F.when(whole, F.floor(seconds).cast("string")).otherwise(F.replace(seconds.cast("string"), F.lit("."), F.lit("p"))),
    )
