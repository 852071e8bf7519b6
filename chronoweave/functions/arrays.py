"""Array columns: higher-order functions for windows, and helpers to hand a batch of windows to numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("array<double>")


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``fn``, also in nested lambdas."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def array_sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(col: Column) -> Column:
    return array_sum(col) / F.nullif(F.size(col).cast("double"), F.lit(0.0))


def known(col: Column) -> Column:
    """Finite samples; the others are NULL."""
    inf = F.lit(float("inf"))
    return F.transform(col, lambda x: F.when(~F.isnan(x) & (F.abs(x) != inf), x))


def minmax(col: Column) -> Column:
    """Scale a window to 0..1 in single precision; no range or nothing known gives zeros."""
    finite = known(col)
    span = F.struct(F.array_min(F.array_compact(finite)).alias("lo"), F.array_max(F.array_compact(finite)).alias("hi"))

    def scale(s: Column) -> Column:
        flat = s["lo"].isNull() | (s["hi"] - s["lo"] <= 1e-12)
        share = lambda x: (F.coalesce(x, s["lo"]) - s["lo"]) / (s["hi"] - s["lo"])
        return F.transform(finite, lambda x: F.when(flat, F.lit(0.0)).otherwise(share(x)).cast("float"))

    return bind(span, scale)


def energy(col: Column) -> Column:
    """Sum of squared deviations from the mean."""
    return bind(array_mean(col), lambda mean: F.aggregate(col, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)))


def standardise(col: Column, ddof: int) -> Column:
    """Z-score of a window; a constant window is only centred."""
    sd = F.sqrt(energy(col) / F.nullif((F.size(col) - ddof).cast("double"), F.lit(0.0)))
    stats = F.struct(array_mean(col).alias("mean"), F.when(sd > 1e-12, sd).otherwise(F.lit(1.0)).alias("sd"))
    return bind(stats, lambda s: F.transform(col, lambda x: (x - s["mean"]) / s["sd"]))


def shift_pad(col: Column, delay: int) -> Column:
    """Positive delay drops the head, a negative one repeats the first sample and drops the tail."""
    n = F.size(col)
    if delay > 0:
        return F.slice(col, F.lit(delay + 1), F.greatest(n - delay, F.lit(0)))
    if delay < 0:
        return F.slice(F.concat(F.array_repeat(F.get(col, F.lit(0)), -delay), col), F.lit(1), n)
    return col


def tap_rows(col: Column, m: int, k: int) -> Column:
    """Array of (n, taps) with ``u[n+k] .. u[n-m+1]`` for every complete position."""
    positions = F.when(F.size(col) >= m + k, F.sequence(F.lit(m - 1), F.size(col) - 1 - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        positions, lambda n: F.struct(n.alias("n"), F.reverse(F.slice(col, n - m + 2, F.lit(m + k))).alias("taps"))
    )


def near_biggest(candidates: Column, previous: Column, reach: Column) -> Column:
    """First of the five strongest candidates strictly within ``reach`` of the previous value.

    Returns a struct (value, place); place 0 means none fits and the previous value holds.
    """
    top = F.slice(candidates, 1, 5)
    place = F.array_position(F.transform(top, lambda c: F.abs(c - previous) < reach), True)
    return F.struct(
        F.when(place > 0, F.get(top, (place - 1).cast("int"))).otherwise(previous).alias("value"), place.cast("int").alias("place")
    )


def rounded_array(col: Column, places: int = 6) -> Column:
    return F.transform(col, lambda x: F.round(x, places) + F.lit(0.0))


def matrix(column: pd.Series) -> np.ndarray:
    """Equally long arrays of a batch as a float matrix; missing samples become NaN."""
    return np.stack([np.asarray(a, dtype=float) for a in column]) if len(column) else np.empty((0, 0))


def by_length(column: pd.Series, fn: Callable[[np.ndarray], list], at_once: int = 2048) -> list:
    """Apply ``fn`` to the positions of equally long windows and put the results back in order.

    ``fn`` sees at most ``at_once`` windows, so what it makes of them does not grow with the batch.
    """
    lengths = column.map(len).to_numpy()
    out: list = [None] * len(column)
    for n in np.unique(lengths):
        same = np.flatnonzero(lengths == n)
        for start in range(0, len(same), at_once):
            at = same[start : start + at_once]
            for pos, value in zip(at, fn(at)):
                out[pos] = value
    return out
