"""Quality control of recordings on their first seconds."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.missing import fill_many
from chronoweave.operators.series import Layout

# Limits of the quality rules.
MAX_STD = 2.5
MAX_STD_RATIO = 3.0
MIN_OUTLIER_SHARE = 0.03
MAX_OUTLIER_BALANCE = 3.0
EPS = 1e-12


def gram_basis(i: Column, n: int) -> list[Column]:
    """Orthogonal polynomials of degree 0..4 on the positions 0..n-1.

    On a full grid they do not depend on the data, so a polynomial fit is five sums per recording.
    """
    x = i - (n - 1) / 2.0
    m = float(n * n)
    return [
        F.lit(1.0),
        x,
        x * x - (m - 1) / 12.0,
        x * x * x - x * ((3 * m - 7) / 20.0),
        x * x * x * x - x * x * ((3 * m - 13) / 14.0) + 3.0 * (m - 1) * (m - 9) / 560.0,
    ]


def detrended_prefix(layout: Layout, channels: list[str], n: int) -> DataFrame:
    """First ``n`` samples with the residuals ``res_<channel>`` of a degree-4 fit.

    The prefix filter reaches the scan.  Gaps are interpolated inside the prefix first, its ends are
    repeated.  ``_n`` is the length of the prefix, ``_known_<channel>`` its number of known samples.
    """
    if n > layout.block_rows:
        raise ValueError("the quality prefix must fit into the first block")
    head = layout.core().where((F.col("blk") == 0) & (F.col("i") < n)).select(*layout.block_key, "i", *channels)
    filled = fill_many(replace(layout, last_block=0), head.withColumns({f"_raw_{c}": F.col(c) for c in channels}), channels)
    basis = gram_basis(F.col("i"), n)
    sums = [F.count(F.lit(1)).alias("_n")]
    for c in channels:
        sums.append(F.count(f"_raw_{c}").alias(f"_known_{c}"))
        sums += [(F.sum(p * F.col(c)) / F.sum(p * p)).alias(f"_c_{c}_{j}") for j, p in enumerate(basis)]
    fits = filled.groupBy(*layout.block_key).agg(*sums)
    rows = filled.join(fits, layout.block_key)
    for c in channels:
        fit = sum((F.col(f"_c_{c}_{j}") * p for j, p in enumerate(basis)), F.lit(0.0))
        rows = rows.withColumn(f"res_{c}", F.col(c) - fit)
    keep = [f"res_{c}" for c in channels] + [f"_known_{c}" for c in channels]
    return rows.select(*layout.block_key, "i", "_n", *keep)


def quality(
    layout: Layout, first: str, second: str, n: int, *, max_std: float = MAX_STD, max_std_ratio: float = MAX_STD_RATIO
) -> DataFrame:
    """Status and reason per recording from two voltage channels.

    Bad: too short, too few known samples, a large residual deviation, unequal deviations, or
    clearly unequal shares of residuals beyond three deviations.
    """
    rows = detrended_prefix(layout, [first, second], n)
    full = F.col("_n") == n
    r1, r2 = F.when(full, F.col(f"res_{first}")), F.when(full, F.col(f"res_{second}"))
    stds = rows.groupBy(*layout.block_key).agg(F.stddev_pop(r1).alias("std1"), F.stddev_pop(r2).alias("std2"))
    counted = (
        rows.join(stds, layout.block_key)
        .groupBy(*layout.key)
        .agg(
            F.max("_n").alias("_n"),
            F.min(F.least(f"_known_{first}", f"_known_{second}")).alias("_known"),
            F.max("std1").alias("std1"),
            F.max("std2").alias("std2"),
            F.count_if((F.col("std1") > 0) & (F.abs(r1) > 3.0 * F.col("std1"))).alias("outliers1"),
            F.count_if((F.col("std2") > 0) & (F.abs(r2) > 3.0 * F.col("std2"))).alias("outliers2"),
        )
    )
    s1, s2 = F.col("std1"), F.col("std2")
    o1, o2 = F.col("outliers1") / float(n), F.col("outliers2") / float(n)
    reasons = F.concat_ws(
        "; ",
        F.when((s1 > max_std) | (s2 > max_std), "STD above limit"),
        F.when(F.greatest(s1, s2) / (F.least(s1, s2) + EPS) > max_std_ratio, "STD ratio above limit"),
        F.when(
            ~((o1 < MIN_OUTLIER_SHARE) & (o2 < MIN_OUTLIER_SHARE))
            & (F.greatest(o1, o2) / (F.least(o1, o2) + EPS) > MAX_OUTLIER_BALANCE),
            "outlier ratios unbalanced",
        ),
    )
    reason = (
        F.when(F.col("_n") < n, "fewer samples than the quality prefix")
        .when(F.col("_known") < 5, "invalid voltage data")
        .when(reasons == "", "ok")
        .otherwise(reasons)
    )
    return counted.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "ok", "good").otherwise("bad"))
