"""Full-length rate curve of a recording with the reference moved by its post-hoc bias."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.interpolate import bias_scores, interpolate_at
from chronoweave.operators.metrics import HIT_BPM, pick_best
from chronoweave.operators.series import lay_out

BIAS_BLOCK_S = 600.0  # seconds of windows that share one cut of the reference
BIAS_SUMS = ["n", "abs_sum", "sq_sum", "err_sum", "hits", "base_sum", "base_hits"]


def posthoc_bias(results: DataFrame, reference: DataFrame, key: list[str], low: int = -5, high: int = 5, step_s: float = 1.0) -> DataFrame:
    """Bias of each recording that brings its in-scope rates closest to the reference.

    The reference is read at ``time + bias`` for every bias of the grid; ties go to the smaller
    absolute bias, then RMSE, then STD.
    """
    grid = F.transform(F.sequence(F.lit(round(low / step_s)), F.lit(round(high / step_s))), lambda n: n * step_s)
    points = (
        results.where("in_scope")
        .select(*key, "w", "adaptive_hr", "center_s", F.explode(grid).alias("bias_s"))
        .withColumn("t", F.col("center_s") + F.col("bias_s"))
        .drop("center_s")
    )
    rows = interpolate_at(reference, points, key, "t", "hr").withColumn("err", F.col("adaptive_hr") - F.col("hr"))
    best = pick_best(bias_scores(rows, key, "bias_s", "err"), key, "bias_s", "aae", ["rmse", "std"])
    return best.select(
        *key,
        F.coalesce("bias_s", F.lit(0.0)).alias("bias_s"),
        F.when(F.col("bias_s").isNull(), "failed").otherwise("ok").alias("bias_status"),
        F.coalesce("n_valid", F.lit(0)).alias("bias_n_valid"),
    )


def global_rates(results: DataFrame, biases: DataFrame, reference: DataFrame, key: list[str], *, enabled: bool = True) -> DataFrame:
    """Adaptive rate in scope and plain spectrum rate elsewhere, against the moved reference.

    ``biases(key, saved_bias, found_bias)``: a saved bias wins, then the one found now, else none.
    Points without a rate or a reference are left out.
    """
    source = (
        F.when(F.col("saved_bias").isNotNull(), "saved_best_params")
        .when(F.lit(enabled), "computed_during_redraw")
        .otherwise("disabled")
    )
    bias = F.when(F.col("saved_bias").isNotNull(), F.col("saved_bias")).when(F.lit(enabled), F.col("found_bias"))
    chosen = biases.select(*key, F.coalesce(bias, F.lit(0.0)).alias("time_bias_after_s"), source.alias("time_bias_after_source"))
    rate = F.when(F.col("in_scope"), F.col("adaptive_hr")).otherwise(F.col("fft_hr"))
    points = results.join(chosen, key).select(
        *key,
        "w",
        F.col("center_s").alias("time_s"),
        F.col("label").alias("segment_label"),
        F.col("in_scope").alias("is_filtered_segment"),
        rate.alias("rate_bpm"),
        "time_bias_after_s",
        "time_bias_after_source",
        (F.col("center_s") + F.col("time_bias_after_s")).alias("t"),
    )
    rows = interpolate_at(reference, points, key, "t", "hr").withColumnRenamed("hr", "ref_hr_after_bpm").drop("t")
    return (
        rows.where(F.col("rate_bpm").isNotNull() & F.col("ref_hr_after_bpm").isNotNull())
        .withColumn("abs_err_after_bpm", F.abs(F.col("rate_bpm") - F.col("ref_hr_after_bpm")))
        .withColumn("time_bias_after_mode", F.lit("posthoc_oracle_alignment"))
    )


def bias_grid(low: int = -5, high: int = 5, step_s: float = 1.0) -> list[float]:
    return [n * step_s for n in range(round(low / step_s), round(high / step_s) + 1)]


def reference_pieces(reference: DataFrame, key: list[str], low: float, high: float) -> DataFrame:
    """Straight pieces of each reference, collected for every block of windows that a bias can bring there.

    A piece runs from a sample to the next one and is given to all blocks it reaches, so gaps of any
    length are bridged; the last sample is a piece without length.
    """
    lay = lay_out(reference.where("hr IS NOT NULL AND t IS NOT NULL").select(*key, "t", "hr"), key, ["t", "hr"], label="reference", derived=True)
    after = F.lead(F.struct("t", "hr")).over(lay.window())
    rows = lay.df.withColumn("_n", F.coalesce(after, F.struct("t", "hr"))).where("core")
    block = lambda t: F.floor(t / BIAS_BLOCK_S)
    rows = rows.withColumn("blk", F.explode(F.sequence(block(F.col("t") - high), block(F.col("_n.t") - low))))
    return rows.groupBy(*key, "blk").agg(F.array_sort(F.collect_list(F.struct("t", "hr", F.col("_n.t").alias("t2"), F.col("_n.hr").alias("hr2")))).alias("pieces"))


def bias_sums(results: DataFrame, reference: DataFrame, key: list[str], node: list[str], grid: list[float]) -> DataFrame:
    """Error sums of every bias: ``key, node, bias_s`` and ``BIAS_SUMS``.

    ``results(key, node, center_s, adaptive_hr, baseline_hr)`` are windows in scope.  Each block of windows
    is read against its cut of the reference at all biases together and leaves one vector of sums per bias;
    neither windows nor reference are copied for the grid.
    """
    rows = results.select(*key, *node, "center_s", "adaptive_hr", "baseline_hr").withColumn("blk", F.floor(F.col("center_s") / BIAS_BLOCK_S))
    packed = rows.groupBy(*key, *node, "blk").agg(F.collect_list(F.struct("center_s", "adaptive_hr", "baseline_hr")).alias("_w"))
    packed = packed.select(*key, *node, "blk", *[F.col(f"_w.{c}").alias(c) for c in ("center_s", "adaptive_hr", "baseline_hr")])
    pieces = reference_pieces(reference, key, min(grid), max(grid))
    pieces = pieces.select(*key, "blk", *[F.col(f"pieces.{c}").alias(c) for c in ("t", "hr", "t2", "hr2")])
    schema = rows.select(*key, *node).schema.simpleString()[7:-1].replace(":", " ")

    def run(parts):
        for pdf in parts:
            sums = [sums_at(*(np.asarray(row[c], float) for c in ("center_s", "adaptive_hr", "baseline_hr", "t", "hr", "t2", "hr2")), np.array(grid)) for row in pdf.to_dict("records")]
            yield pdf[[*key, *node]].assign(sums=[list(s) for s in sums])

    parts = packed.join(pieces, [*key, "blk"]).drop("blk").mapInPandas(run, f"{schema}, sums array<array<double>>")
    each = parts.select(*key, *node, F.posexplode("sums").alias("_b", "_s"))
    total = [F.sum(F.get("_s", F.lit(i))).alias(c) for i, c in enumerate(BIAS_SUMS)]
    bias = F.element_at(F.array(*[F.lit(b) for b in grid]), F.col("_b") + 1).alias("bias_s")
    return each.groupBy(*key, *node, "_b").agg(*total).select(*key, *node, bias, *BIAS_SUMS)


def sums_at(center, adaptive, baseline, t, hr, t2, hr2, grid: np.ndarray) -> np.ndarray:
    """``BIAS_SUMS`` per bias of one block of windows against sorted pieces of the reference."""
    at = center[:, None] + grid
    place = np.maximum(np.searchsorted(t, at, "right") - 1, 0)
    known = (t[place] <= at) & (at <= t2[place])
    span = t2[place] - t[place]
    ref = hr[place] + np.where(span > 0, (hr2[place] - hr[place]) * (at - t[place]) / np.where(span > 0, span, 1.0), 0.0)
    out = np.zeros((len(grid), len(BIAS_SUMS)))
    for rate, columns in ((adaptive, (1, 4)), (baseline, (5, 6))):
        ok = known & np.isfinite(rate)[:, None]
        err = np.where(ok, rate[:, None] - ref, 0.0)
        size = np.round(np.abs(err), 9)
        out[:, columns[0]], out[:, columns[1]] = size.sum(0), (ok & (size <= HIT_BPM)).sum(0)
        if rate is adaptive:
            out[:, 0], out[:, 2], out[:, 3] = ok.sum(0), (err * err).sum(0), err.sum(0)
    return out


def best_bias(sums: DataFrame, by: list[str], min_valid: int = 2) -> DataFrame:
    """Bias with the smallest (AAE, absolute bias, RMSE, STD) and its sums; groups without one are left out."""
    n = F.col("n")
    scored = sums.where(n >= min_valid).withColumns({"aae": F.col("abs_sum") / n, "rmse": F.sqrt(F.col("sq_sum") / n)})
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("sq_sum") / n - F.pow(F.col("err_sum") / n, 2)))
    return pick_best(scored.withColumn("std", spread), by, "bias_s", "aae", ["rmse", "std"])
