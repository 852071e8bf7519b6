"""Missing samples and outliers on a series layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.series import Layout, attach, bracket, bracket_many

MAD_SCALE = 1.4826  # fixed value: MAD to sigma for normal data


def linear_between(axis: str, name: str = "") -> Column:
    """Straight line between the bracketing samples; NULL outside them."""
    p, n, x = F.col(f"prev{name}"), F.col(f"next{name}"), F.col(axis)
    inside = p.isNotNull() & n.isNotNull()
    return F.when(p.x == x, p.v).when(
        inside, p.v + (n.v - p.v) / F.nullif((n.x - p.x).cast("double"), F.lit(0.0)) * (x - p.x)
    )


def nearest_of(axis: str, name: str = "") -> Column:
    """Closest sample; on a tie the later one."""
    p, n, x = F.col(f"prev{name}"), F.col(f"next{name}"), F.col(axis)
    later = p.isNull() | (n.isNotNull() & ((n.x - x) <= (x - p.x)))
    return F.when(later, n.v).otherwise(p.v)


def _fill(layout: Layout, rows: DataFrame, value: str, out: str, *rules: Column) -> DataFrame:
    filled = bracket(layout, rows, value)
    return filled.withColumn(out, F.coalesce(F.col(value), *rules)).drop("prev", "next")


def fill_nearest(layout: Layout, value: str, out: str = "filled") -> DataFrame:
    """Fill every gap with the closest sample by position."""
    return _fill(layout, layout.core(), value, out, nearest_of("i"))


def fill_linear(layout: Layout, value: str, out: str = "filled", *, clamp_ends: bool = False) -> DataFrame:
    """Fill interior gaps on a straight line; ``clamp_ends`` repeats the first and last sample."""
    rules = [linear_between("i")] + ([nearest_of("i")] if clamp_ends else [])
    return _fill(layout, layout.core(), value, out, *rules)


def fill_rows(layout: Layout, rows: DataFrame, value: str, out: str) -> DataFrame:
    """Linear, then nearest at the ends, for core rows that already carry ``value``."""
    return _fill(layout, rows, value, out, linear_between("i"), nearest_of("i"))


def fill_many(
    layout: Layout, rows: DataFrame, columns: list[str], *, with_halo: bool = False, linear: bool = True
) -> DataFrame:
    """Fill the gaps of several columns in place (linear, nearest at the ends; or nearest only) with
    one set of block summaries."""
    samples = {f"_{c}": (c, "i", F.col(c).isNotNull()) for c in columns}
    rows = bracket_many(layout, rows, samples, with_halo=with_halo)
    line = lambda c: [linear_between("i", f"_{c}")] if linear else []
    filled = {c: F.coalesce(F.col(c), *line(c), nearest_of("i", f"_{c}")) for c in columns}
    return rows.withColumns(filled).drop(*[f"{side}_{c}" for c in columns for side in ("prev", "next")])


def moving_median(layout: Layout, value: str, width: int) -> Column:
    """Centred moving median with shrinking ends."""
    if width <= 1:
        return F.col(value)
    return F.percentile(F.col(value), F.lit(0.5)).over(layout.centred(width))


def smooth_short(layout: Layout, value: str, width: int, out: str = "smooth") -> DataFrame:
    """Moving median of the short-sequence kind: even widths grow by one, widths above the length
    of the recording shrink to its largest odd part, recordings of fewer than 3 points stay."""
    if width <= 1:
        return layout.core().withColumn(out, F.col(value))
    odd = width + 1 - width % 2
    sizes = layout.core().groupBy(*layout.key).agg(F.count(F.lit(1)).alias("_n"))
    rows = attach(layout, layout.df, sizes)
    result = F.col(value)
    for w in range(3, odd + 1, 2):
        fits = F.col("_n") >= w if w == odd else F.col("_n").isin(w, w + 1)
        result = F.when(fits, moving_median(layout, value, w)).otherwise(result)
    return rows.withColumn(out, result).where("core").drop("core", "_n")


def flag_local_outliers(layout: Layout, flags: dict[str, str], width: int, threshold: float = 3.0) -> Layout:
    """Add a flag per value (``flags`` maps value to flag name): further from the moving median than
    ``threshold`` scaled moving MADs."""
    layout.check_reach(2 * (width // 2) + 1)
    frame, half = layout.centred(width), F.lit(0.5)
    median = {f"_med_{v}": F.percentile(v, half).over(frame) for v in flags}
    deviation = {f"_dev_{v}": F.abs(F.col(v) - F.col(f"_med_{v}")) for v in flags}
    scale = {f"_mad_{v}": F.percentile(f"_dev_{v}", half).over(frame) * MAD_SCALE for v in flags}
    flag = {
        out: F.coalesce((F.col(f"_mad_{v}") > 0) & (F.col(f"_dev_{v}") > threshold * F.col(f"_mad_{v}")), F.lit(False))
        for v, out in flags.items()
    }
    df = layout.df.withColumns(median).withColumns(deviation).withColumns(scale).withColumns(flag)
    return layout.with_df(df.drop(*median, *deviation, *scale))


def replace_local_outliers(layout: Layout, value: str, width: int, out: str = "clean") -> DataFrame:
    """Moving-median outliers become gaps, then linear, then nearest filling.

    A recording without outliers keeps its gaps, as there is nothing to repair.
    """
    if width <= 1:
        return layout.core().withColumn(out, F.col(value)).withColumn("outlier", F.lit(False))
    flagged = flag_local_outliers(layout, {value: "outlier"}, width)
    rows = flagged.core().withColumn("_kept", F.when(~F.col("outlier"), F.col(value)))
    any_outlier = rows.groupBy(*layout.key).agg(F.bool_or("outlier").alias("_any"))
    filled = fill_rows(flagged, rows, "_kept", "_filled")
    return (
        attach(layout, filled, any_outlier)
        .withColumn(out, F.when(F.col("_any"), F.col("_filled")).otherwise(F.col(value)))
        .drop("_kept", "_filled", "_any")
    )


def replace_global_outliers(layout: Layout, value: str, threshold: float = 3.0, out: str = "clean") -> DataFrame:
    """Samples beyond mean +- threshold * sigma repeat the last good sample; leading ones stay.

    When the last good sample is itself missing, the outlier stays.
    """
    core = layout.core()
    stats = core.groupBy(*layout.key).agg(
        F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd")
    )
    rows = attach(layout, core, stats).withColumn(
        "outlier",
        F.coalesce((F.col("_sd") > 0) & (F.abs(F.col(value) - F.col("_mu")) > threshold * F.col("_sd")), F.lit(False)),
    )
    rows = bracket(layout, rows, value, valid=~F.col("outlier"))
    return rows.withColumn(
        out, F.when(F.col("outlier"), F.coalesce(F.col("prev.v"), F.col(value))).otherwise(F.col(value))
    ).drop("_mu", "_sd", "prev", "next")


def ratio_channel(layout: Layout, num: str, total: str, out: str = "ratio") -> DataFrame:
    """``num / (total - num)``; undefined points are filled along the series, then with 0."""
    den = F.col(total) - F.col(num)
    raw = F.when(F.abs(den) >= 1e-9, F.col(num) / den)
    rows = layout.core().withColumn("_raw", raw)
    return (
        fill_rows(layout, rows, "_raw", "_filled").withColumn(out, F.coalesce("_filled", F.lit(0.0))).drop("_raw", "_filled")
    )
