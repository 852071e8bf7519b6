"""Error metrics.  Aggregates are sums over windows, so partial aggregation removes skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT_BPM = 5.0  # fixed value: an absolute error up to this counts as a hit


def aae(err: Column, where: Column | None = None) -> Column:
    e = F.abs(err)
    return F.avg(e if where is None else F.when(where, e))


def accuracy(err: Column, where: Column | None = None, hit: float = HIT_BPM) -> Column:
    ok = (F.abs(err) <= hit).cast("double") * 100.0
    return F.avg(ok if where is None else F.when(where, ok))


def rmse(err: Column) -> Column:
    return F.sqrt(F.avg(err * err))


def score_columns(err: Column, min_valid: int = 2) -> list[Column]:
    """AAE, STD, RMSE and count of one candidate; no score below ``min_valid`` samples."""
    n = F.count(err)
    return [
        n.alias("n_valid"),
        F.when(n >= min_valid, F.avg(F.abs(err))).alias("aae"),
        F.when(n >= min_valid, F.stddev_pop(err)).alias("std"),
        F.when(n >= min_valid, rmse(err)).alias("rmse"),
    ]


def scope_metrics(results: DataFrame, by: list[str], *, scope: str = "in_scope", ref: str = "ref_hr") -> DataFrame:
    """Baseline and adaptive error of the windows in scope, aggregated over all windows of a group.

    All windows of a group count alike (no mean of means); errors are compared on 9 decimals.
    """
    base = F.round(F.col("baseline_hr") - F.col(ref), 9)
    adap = F.round(F.col("adaptive_hr") - F.col(ref), 9)
    inside = F.col(scope)
    return results.groupBy(*by).agg(
        aae(base, inside).alias("baseline_aae"),
        aae(adap, inside).alias("adaptive_aae"),
        accuracy(base, inside).alias("baseline_acc"),
        accuracy(adap, inside).alias("adaptive_acc"),
        F.count(F.when(inside, adap)).alias("n_valid"),
    )


def objective(metric_aae: Column, metric_acc: Column, mode: Column, penalty: float = 999.0) -> Column:
    """Value to minimise; a missing metric costs the penalty."""
    return F.coalesce(F.when(mode == "accuracy", 100.0 - metric_acc).otherwise(metric_aae), F.lit(penalty))


def pick_best(scores: DataFrame, by: list[str], candidate: str, primary: str, others: list[str]) -> DataFrame:
    """Best candidate per group: smallest primary score, then smallest absolute candidate, then the
    remaining scores.  Keys are compared on 9 decimals; ``min_by`` combines before the shuffle."""
    keys = [F.round(primary, 9), F.round(F.abs(candidate), 9)] + [F.round(c, 9) for c in others] + [F.col(candidate)]
    valid = F.col(primary).isNotNull()
    packed = F.struct(*[F.col(c) for c in scores.columns if c not in by])
    best = scores.groupBy(*by).agg(F.min_by(F.when(valid, packed), F.when(valid, F.struct(*keys))).alias("_b"))
    return best.select(*by, "_b.*")
