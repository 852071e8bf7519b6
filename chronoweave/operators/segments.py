"""Sliding windows, activity segmentation and scope masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.columns import in_scope, segment_label
from chronoweave.operators.series import Layout, attach

RUN_WINDOWS = 6  # fixed value: equal flags needed on each side of a transition
CALIBRATION_S = 30  # fixed value: length of the rest calibration


def sliding_windows(layout: Layout, fs: float, width_s: float, hop_s: float, aggregates: dict[str, Column]) -> Layout:
    """Full windows of ``width_s`` seconds, one every ``hop_s`` seconds, with their aggregates.

    The result keeps halo windows, so that run-length rules can look over a block edge.
    Columns: key, blk, core, i (first row), w, start_s, center_s and the aggregates.
    """
    width, hop = round(width_s * fs), max(1, round(hop_s * fs))
    frame = layout.frame(0, width - 1)
    cols = [agg.over(frame).alias(name) for name, agg in aggregates.items()]
    rows = layout.df.select(*layout.block_key, "i", "core", F.count(F.lit(1)).over(frame).alias("_n"), *cols)
    rows = (
        rows.where((F.col("_n") == width) & (F.col("i") % hop == 0))
        .withColumn("w", F.expr(f"i div {hop}"))
        .withColumn("start_s", F.col("i") / fs)
        .withColumn("center_s", F.col("i") / fs + width_s / 2.0)
        .drop("_n")
    )
    return layout.with_df(rows)


def _mark_transitions(windows: Layout, flag: str, hop: int) -> DataFrame:
    """Add ``up`` and ``down``: the first window of the new state where ``RUN_WINDOWS`` windows at
    rest are followed by as many in motion, and the other way round."""
    windows.check_reach(2 * RUN_WINDOWS * hop)
    w = windows.window()
    first, second = w.rowsBetween(0, RUN_WINDOWS - 1), w.rowsBetween(RUN_WINDOWS, 2 * RUN_WINDOWS - 1)
    return (
        windows.df.withColumn("_m1", F.count_if(flag).over(first))
        .withColumn("_m2", F.count_if(flag).over(second))
        .withColumn("_r1", F.count_if(~F.col(flag)).over(first))
        .withColumn("_r2", F.count_if(~F.col(flag)).over(second))
        .withColumn("up", F.when((F.col("_r1") == RUN_WINDOWS) & (F.col("_m2") == RUN_WINDOWS), F.col("w") + RUN_WINDOWS))
        .withColumn("down", F.when((F.col("_m1") == RUN_WINDOWS) & (F.col("_r2") == RUN_WINDOWS), F.col("w") + RUN_WINDOWS))
        .drop("_m1", "_m2", "_r1", "_r2")
    )


def activity_segments(
    layout: Layout, magnitude: str, fs: float, width_s: float, hop_s: float = 1.0, calibration_s: float = CALIBRATION_S
) -> tuple[Layout, DataFrame]:
    """Windows with a motion flag, and one row per recording with its motion start and end.

    A window moves when its sample deviation exceeds three times that of the calibration.
    Status ``error`` carries the reason, as a recording without motion is no failure of the job.
    """
    hop = max(1, round(hop_s * fs))
    calibration_rows = round(calibration_s * fs)
    base = (
        layout.core()
        .where(F.col("i") < calibration_rows)
        .groupBy(*layout.key)
        .agg((F.stddev_samp(magnitude) * 3.0).alias("threshold"))
    )
    windows = sliding_windows(layout, fs, width_s, hop_s, {"std": F.stddev_samp(magnitude)})
    windows = windows.with_df(
        attach(layout, windows.df, base).withColumn("moving", F.coalesce(F.col("std") > F.col("threshold"), F.lit(False)))
    )
    # One summary per block: ``downs`` is bounded, as two transitions are 12 windows apart.
    blocks = (
        _mark_transitions(windows, "moving", hop)
        .where("core")
        .groupBy(*layout.block_key)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("up").alias("_up"), F.collect_list("down").alias("_downs"))
    )
    whole = Window.partitionBy(*layout.key)
    found = (
        blocks.withColumn("w_start", F.min("_up").over(whole))
        .withColumn("_end", F.array_min(F.filter("_downs", lambda d: d - RUN_WINDOWS >= F.col("w_start"))))
        .groupBy(*layout.key)
        .agg(F.sum("_n").alias("n_windows"), F.min("w_start").alias("w_start"), F.min("_end").alias("w_end"))
    )
    segments = (
        base.join(found, list(layout.key), "left")
        .withColumn("n_windows", F.coalesce("n_windows", F.lit(0)))
        .withColumn(
            "reason",
            F.when(F.col("n_windows") == 0, "signal shorter than one window")
            .when(F.col("n_windows") < 2 * RUN_WINDOWS, "too few sliding windows")
            .when(F.col("w_start").isNull(), "no rest to motion transition")
            .when(F.col("w_end").isNull(), "no motion to rest transition")
            .otherwise(""),
        )
        .withColumn("status", F.when(F.col("reason") == "", "ok").otherwise("error"))
        .withColumn("start_s", F.when(F.col("status") == "ok", F.col("w_start") * hop / fs))
        .withColumn("end_s", F.when(F.col("status") == "ok", F.col("w_end") * hop / fs))
        .drop("w_start", "w_end")
    )
    return windows, segments


def label_windows(windows: Layout, segments: DataFrame) -> Layout:
    """Rest, motion or recovery by window centre; ``unknown`` where no segment was found."""
    spans = segments.select(*windows.key, "status", F.col("start_s").alias("motion_start"), F.col("end_s").alias("motion_end"))
    labelled = attach(windows, windows.df, spans).withColumn(
        "label",
        F.when(F.col("status") == "ok", segment_label(F.col("center_s"), F.col("motion_start"), F.col("motion_end"))).otherwise("unknown"),
    )
    return windows.with_df(labelled)


def scope_masks(labelled: DataFrame, scopes: list[str]) -> DataFrame:
    """One row per window and target scope with the membership flag."""
    dim = F.explode(F.array(*[F.lit(s) for s in scopes])).alias("scope")
    rows = labelled.select("*", dim)
    return rows.withColumn("in_scope", in_scope(F.col("label"), F.col("scope"), F.col("center_s"), F.col("motion_end")))


def compact_rank(layout: Layout, rows: DataFrame, flag: str, out: str = "rank") -> DataFrame:
    """Position of each flagged row among the flagged rows of its recording (gaps closed).

    Ranks inside a block come from the window, the offset of the block from the block counts.
    """
    inside = F.sum(F.col(flag).cast("long")).over(layout.window().rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.withColumn(out, inside)
    if layout.spans_blocks:
        counts = rows.groupBy(*layout.block_key).agg(F.sum(F.col(flag).cast("long")).alias("_c"))
        base = Window.partitionBy(*layout.key).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*layout.block_key, F.coalesce(F.sum("_c").over(base), F.lit(0)).alias("_off"))
        ranked = ranked.join(offsets, layout.block_key, "left").withColumn(out, F.col(out) + F.col("_off")).drop("_off")
    return ranked.withColumn(out, F.when(F.col(flag), F.col(out) - 1))


def smooth_in_scope(windows: Layout, value: str, flag: str, width: int, out: str) -> DataFrame:
    """Moving median over the compacted sequence of flagged windows; other windows get NULL.

    The flagged windows are laid out by their rank, so a gap of any length between two flagged
    windows costs nothing and the frame is exact across blocks.
    """
    return smooth_many(windows, value, flag, {out: width})


def smooth_many(windows: Layout, value: str, flag: str, widths: dict[str, int]) -> DataFrame:
    """``smooth_in_scope`` for several widths in one pass: output column -> width."""
    core = windows.core()
    ranked = compact_rank(windows, core, flag)
    median = lambda frame, w: F.percentile(F.col(value), F.lit(0.5)).over(frame.rowsBetween(-(w // 2), w - 1 - w // 2))
    if not windows.spans_blocks:
        frame = Window.partitionBy(*windows.block_key, flag).orderBy("i")
        return ranked.withColumns({out: F.when(F.col(flag), median(frame, w)) for out, w in widths.items()})
    near = re_block(ranked.where(flag).select(*windows.key, "rank", value, "i"), list(windows.key), "rank", windows.block_rows, max(widths.values()))
    frame = Window.partitionBy(*windows.key, "_rb").orderBy("rank")
    smooth = near.withColumns({out: median(frame, w) for out, w in widths.items()}).where("core")
    smooth = smooth.withColumn("blk", F.expr(f"i div {windows.block_rows}")).select(*windows.block_key, "i", *widths)
    return ranked.join(smooth, [*windows.block_key, "i"], "left")


def re_block(rows: DataFrame, key: list[str], position: str, block_rows: int, halo: int) -> DataFrame:
    """Blocks by another dense position: adds ``_rb`` and ``core``, repeating ``halo`` rows."""
    lo = F.expr(f"greatest({position} - {halo}, 0) div {block_rows}")
    hi = F.expr(f"({position} + {halo}) div {block_rows}")
    return (
        rows.withColumn("_rb", F.explode(F.sequence(lo, hi)))
        .withColumn("core", F.col("_rb") == F.expr(f"{position} div {block_rows}"))
    )
