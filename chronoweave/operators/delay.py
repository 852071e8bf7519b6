"""Delay search by correlation, grid searches over shifts, and the filter design they feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.columns import guarded_corr
from chronoweave.operators.series import Layout


def lag_pairs(primary: str, others: list[str], lags: range, window) -> Column:
    """Array of (channel, lag, x, y): the primary sample with the other channel ``lag`` steps back."""
    items = []
    for name in others:
        for d in lags:
            y = F.lag(name, d).over(window) if d >= 0 else F.lead(name, -d).over(window)
            items.append(F.struct(F.lit(name).alias("channel"), F.lit(d).alias("lag"), F.col(primary).alias("x"), y.alias("y")))
    return F.array(*items)


def best_lag(rows: DataFrame, key: list[str], primary: str, others: list[str], max_lag: int, window) -> DataFrame:
    """Lag of the largest absolute correlation per recording and channel.

    Shifted copies come from lag/lead, so there is no self join.  The six sums per (recording,
    channel, lag) combine before the shuffle.  On ties the most negative lag wins; a recording
    whose correlations are all zero gets lag 0.
    """
    lags = range(-max_lag, max_lag + 1)
    pairs = rows.select(*key, lag_pairs(primary, others, lags, window).alias("_p")).select(*key, F.inline("_p"))
    x, y = F.col("x"), F.col("y")
    both = pairs.where(x.isNotNull() & y.isNotNull())
    sums = both.groupBy(*key, "channel", "lag").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"),
        F.sum(x * y).alias("sxy"),
    )
    cols = [F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    scored = sums.withColumn("r", guarded_corr(*cols))
    best = scored.groupBy(*key, "channel").agg(
        F.max_by(F.struct("lag", "r"), F.struct(F.round(F.abs("r"), 9), -F.col("lag"))).alias("_b")
    )
    zero = F.round(F.abs("_b.r"), 9) == 0
    return best.select(
        *key,
        "channel",
        F.when(zero, 0).otherwise(F.col("_b.lag")).alias("lag"),
        F.when(zero, 0.0).otherwise(F.col("_b.r")).alias("r"),
    )


def rank_channels(best: DataFrame, key: list[str], declared: list[str]) -> DataFrame:
    """Rank the few channels of a recording by absolute correlation; ties keep the declared order."""
    position = F.array_position(F.array(*[F.lit(c) for c in declared]), F.col("channel"))
    w = Window.partitionBy(*key).orderBy(F.round(F.abs("r"), 9).desc(), position)
    return best.withColumn("rank", F.row_number().over(w))


def filter_design(
    lag: Column,
    r: Column,
    *,
    max_order: int = 16,
    m_base: int = 2,
    c_scale: float = 1.2,
    k_max: int = 12,
    mu_base: float = 0.01,
    mu_min: float = 1e-6,
) -> list[Column]:
    """Order ``M``, future taps ``K``, step ``mu`` and mode of the adaptive filter for a delay."""
    steps = F.floor(F.abs(lag) * c_scale).cast("int")
    m = F.when(lag > 0, F.least(F.greatest(F.lit(1), steps), F.lit(max_order))).otherwise(F.lit(max(1, m_base)))
    k = F.when(lag < 0, F.least(F.lit(k_max), steps)).otherwise(F.lit(0))
    mu = F.greatest(F.lit(mu_min), mu_base - F.abs(r) / 100.0)
    mode = F.when(lag > 0, "causal").when(lag < 0, "noncausal").otherwise("zero_delay")
    return [m.alias("M"), k.alias("K"), mu.alias("mu"), mode.alias("mode")]


def shifted(layout: Layout, value: str, delay: int) -> Column:
    """Series moved by ``delay`` samples: a positive delay drops the head, a negative one repeats
    the first sample and drops the tail."""
    layout.check_reach(abs(delay))
    w = layout.window()
    if delay == 0:
        return F.col(value)
    if delay > 0:
        return F.lead(value, delay).over(w)
    head = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(F.col("i") < -delay, head).otherwise(F.lag(value, -delay).over(w))
