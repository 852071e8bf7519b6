"""Clean channels of a sensor recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.missing import fill_many, flag_local_outliers
from chronoweave.operators.series import Layout, attach

# Channel groups of a recording.
PPG = ["ppg_green", "ppg_red", "ppg_ir"]
BRIDGE = ["hf1", "hf2"]
INERTIAL = ["accx", "accy", "accz", "gyrox", "gyroy", "gyroz"]
CHANNELS = ["ppg_green", "ppg_red", "ppg_ir", "hf1", "hf2", "cf1", "cf2", "accx", "accy", "accz", "gyrox", "gyroy", "gyroz"]
BANDS_HZ = {"ppg": (0.5, 5.0), "hf": (0.1, 5.0), "cf": (0.1, 5.0), "acc": (0.5, 10.0), "gyro": (0.5, 10.0)}


def band_of(channel: str) -> tuple[float, float]:
    return next(band for prefix, band in BANDS_HZ.items() if channel.startswith(prefix))


def raw_recording(layout: Layout) -> DataFrame:
    """The 13 channels as recorded, before any repair; undefined ratios are NULL."""
    ratio = {f"cf{n}": F.try_divide(F.col(f"uc{n}"), F.col(f"hf{n}") - F.col(f"uc{n}")) for n in ("1", "2")}
    return layout.core().withColumns(ratio).select(*layout.block_key, "i", *CHANNELS)


def despike(layout: Layout, names: list[str], width: int, gaps: dict[str, Column] | None = None) -> DataFrame:
    """Replace moving-median outliers of filled channels; core rows.

    ``gaps`` are further columns with gaps that are filled in the same pass.  A recording without
    outliers in a channel keeps that channel as it is.
    """
    rows = flag_local_outliers(layout, {n: f"_out_{n}" for n in names}, width).core()
    any_out = rows.groupBy(*layout.key).agg(*[F.bool_or(f"_out_{n}").alias(f"_any_{n}") for n in names])
    holes = {f"_fix_{n}": F.when(~F.col(f"_out_{n}"), F.col(n)) for n in names} | (gaps or {})
    rows = attach(layout, fill_many(layout, rows.withColumns(holes), list(holes)), any_out)
    return rows.withColumns({n: F.when(F.col(f"_any_{n}"), F.col(f"_fix_{n}")).otherwise(F.col(n)) for n in names})


def clean_recording(layout: Layout, width: int) -> DataFrame:
    """The 13 clean channels of each core row.

    Gaps are filled on every channel; optical channels lose spikes against a moving median of
    ``width`` rows; the ratio channels divide the bridge voltages and fill undefined points.
    """
    filled = layout.with_df(fill_many(layout, layout.df, [*PPG, *BRIDGE, "uc1", "uc2", *INERTIAL], with_halo=True))
    ratios = {}
    for n in ("1", "2"):
        den = F.col(f"hf{n}") - F.col(f"uc{n}")
        ratios[f"cf{n}"] = F.when(F.abs(den) >= 1e-9, F.col(f"uc{n}") / den)
    rows = despike(filled, PPG, width, ratios)
    rows = rows.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in ratios})
    return rows.select(*layout.block_key, "i", *CHANNELS)


def clean_legacy(layout: Layout, names: list[str], width: int) -> DataFrame:
    """Older cleaning of raw channels: nearest filling, negative optical samples interpolated, then
    spikes of every channel replaced.  The band-pass of all channels at 0.5 to 5 Hz follows it."""
    filled = fill_many(layout, layout.df, names, with_halo=True, linear=False)
    optical = [n for n in names if n.startswith("ppg")]
    if optical:
        filled = filled.withColumns({n: F.when(F.col(n) >= 0, F.col(n)) for n in optical})
        filled = fill_many(layout, filled, optical, with_halo=True)
    return despike(layout.with_df(filled), names, width).select(*layout.block_key, "i", *names)
