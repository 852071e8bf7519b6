"""Zero-phase band-pass and polyphase resampling of whole recordings, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions import iir
from chronoweave.functions.arrays import by_length
from chronoweave.operators.blocks import block_arrays, unpack
from chronoweave.operators.series import Layout, attach
from chronoweave.storage import materialise

MIN_SAMPLES = 8
DOUBLES = T.ArrayType(T.DoubleType())


def band_sections(fs: float, low_hz: float, high_hz: float, order: int = 4) -> np.ndarray | None:
    """Band-pass sections with the edges kept inside the valid range; ``None`` for an empty band."""
    nyquist, high, low = fs / 2.0, min(high_hz, 0.45 * fs), max(low_hz, 1e-3)
    if not 0 < low < high < nyquist:
        return None
    return iir.butter_bandpass(order, low / nyquist, high / nyquist)


def bandpass(layout: Layout, channels: dict[str, tuple[float, float]], fs: float) -> DataFrame:
    """Band-passed channels of every core row; ``channels`` maps a column to its band in Hz.

    A recording that is too short for the filter, or an empty band, is only centred.  Where a
    recording spans blocks, the filter state is carried exactly: a linear filter's state after a
    block is its state without history plus a fixed matrix times the state before the block.
    """
    stats = layout.core().groupBy(*layout.key).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_mean_{c}") for c in channels]
    )
    blocks = attach(layout, block_arrays(layout, list(channels), with_halo=True), stats)
    if not layout.spans_blocks:
        done = _filter_whole(blocks, layout, channels, fs)
        return unpack(done, layout, {c: c for c in channels}, "first_i")
    result = None
    for name, band in channels.items():
        rows = unpack(_filter_carried(blocks, layout, name, band_sections(fs, *band)), layout, {name: name})
        result = rows if result is None else result.join(rows, [*layout.block_key, "i"])
    return result


def _filter_whole(blocks: DataFrame, layout: Layout, channels: dict[str, tuple[float, float]], fs: float) -> DataFrame:
    """Every recording is one block: filter equally long recordings together."""
    sections = {c: band_sections(fs, *band) for c, band in channels.items()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, sec in sections.items():
                column = pdf[name]

                def one_length(at: np.ndarray, column=column, sec=sec) -> list:
                    x = np.stack(column.iloc[at].to_numpy()).astype(float)
                    if sec is None or x.shape[1] < MIN_SAMPLES or x.shape[1] <= iir.pad_length(sec):
                        return list(x - np.nanmean(x, axis=1, keepdims=True))
                    return list(iir.zero_phase(sec, x))

                pdf[name] = by_length(column, one_length)
            yield pdf

    cols = [*layout.block_key, "first_i", *channels]
    return blocks.select(*cols).mapInPandas(run, blocks.select(*cols).schema)


def _carry_states(rows: DataFrame, layout: Layout, sections: np.ndarray, *, reverse: bool) -> DataFrame:
    """State before each block from the history-free end states; a recording has one short row per block."""
    key = list(layout.key)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk", ascending=not reverse)
        matrices = {m: iir.carry_matrix(sections, int(m)) for m in pdf["m"].unique()}
        state, before = np.zeros(2 * len(sections)), []
        for m, end in zip(pdf["m"], pdf["end_state"]):
            before.append(state.tolist())
            state = np.asarray(end) + matrices[m] @ state
        return pdf[[*key, "blk"]].assign(state=before)

    small = rows.select(*key, "blk", "m", "end_state")
    schema = rows.select(*key, "blk").schema.add("state", DOUBLES)
    return small.groupBy(*key).applyInPandas(scan, schema)


def _filter_carried(blocks: DataFrame, layout: Layout, name: str, sections: np.ndarray | None) -> DataFrame:
    pad = 0 if sections is None else iir.pad_length(sections)
    layout.check_reach(pad + 1)
    size, rest = layout.block_rows, None if sections is None else iir.steady_state(sections)
    key = layout.block_key

    def parts_of(row: dict) -> tuple[np.ndarray, bool, bool]:
        """Core samples with the odd extension at the ends of the recording."""
        x = np.asarray(row[name], dtype=float)[None]
        at = row["blk"] * size - row["first_i"]
        core = x[:, at : at + size]
        head, tail = row["blk"] == 0, (row["blk"] + 1) * size >= row["_n"]
        pieces = [core]
        if head:
            pieces.insert(0, iir.odd_pad(x[:, : pad + 1], pad, "head"))
        if tail:
            pieces.append(iir.odd_pad(x[:, -(pad + 1) :], pad, "tail"))
        return np.hstack(pieces), head, tail

    def too_short(row: dict) -> bool:
        return sections is None or row["_n"] < MIN_SAMPLES or row["_n"] <= pad

    def ahead(parts: Iterator[pd.DataFrame], keep: bool) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for row in pdf.to_dict("records"):
                if too_short(row):
                    x = np.asarray(row[name], dtype=float)
                    at = row["blk"] * size - row["first_i"]
                    out.append(((x[at : at + size] - row[f"_mean_{name}"]).tolist(), 0, [0.0] * (0 if rest is None else rest.size)))
                    continue
                x, head, tail = parts_of(row)
                if keep:
                    start = np.asarray(row["state"]).reshape(1, *rest.shape)
                    start = x[:, :1, None] * rest if head else start
                    y, _ = iir.run_filter(sections, x, start)
                    begin = y[:, -1:, None] * rest if tail else np.zeros((1, *rest.shape))
                    _, end = iir.run_filter(sections, y[:, ::-1], begin)
                    out.append((y[0].tolist(), x.shape[1], end.ravel().tolist()))
                else:
                    start = x[:, :1, None] * rest if head else np.zeros((1, *rest.shape))
                    _, end = iir.run_filter(sections, x, start)
                    out.append(([], x.shape[1], end.ravel().tolist()))
            y, m, end = zip(*out) if out else ((), (), ())
            yield pdf[[*key, "_n", f"_mean_{name}"]].assign(y=list(y), m=list(m), end_state=list(end))

    def back(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for row in pdf.to_dict("records"):
                y = np.asarray(row["y"], dtype=float)
                if not too_short(row):
                    head, tail = row["blk"] == 0, (row["blk"] + 1) * size >= row["_n"]
                    begin = y[-1] * rest if tail else np.asarray(row["state"]).reshape(rest.shape)
                    y = iir.run_filter(sections, y[None, ::-1], begin[None])[0][0, ::-1]
                    y = y[pad if head else 0 : -pad if tail else None]
                out.append(y.tolist())
            yield pdf[key].assign(**{name: out})

    base = blocks.select(*key, "first_i", "_n", f"_mean_{name}", name)
    schema = blocks.select(*key, "_n", f"_mean_{name}").schema.add("y", DOUBLES).add("m", T.LongType()).add("end_state", DOUBLES)
    first = base.mapInPandas(lambda p: ahead(p, False), schema)
    if sections is None:
        done = first.select(*key, F.col("y").alias(name))
    else:
        forward = _carry_states(first, layout, sections, reverse=False)
        middle = materialise(base.join(forward, key).mapInPandas(lambda p: ahead(p, True), schema), "forward")
        backward = _carry_states(middle, layout, sections, reverse=True)
        out_schema = blocks.select(*key).schema.add(name, DOUBLES)
        done = middle.join(backward, key).mapInPandas(back, out_schema)
    return done


def resample(layout: Layout, value: str, fs_in: int, fs_out: int) -> DataFrame:
    """Rational rate change with a windowed low-pass; rows ``key, j, t, value``.

    An output sample needs a fixed number of input samples around it, so blocks with their halo are
    enough.  Outside the recording the signal counts as zero.
    """
    if fs_in == fs_out:
        return layout.core().select(*layout.key, F.col("i").alias("j"), (F.col("i") / fs_out).alias("t"), value)
    up, down, taps = iir.resample_taps(fs_in, fs_out)
    half, size, key = len(taps) // 2, layout.block_rows, layout.block_key
    if layout.spans_blocks:
        layout.check_reach(half // up + 1)
    stats = layout.core().groupBy(*layout.key).agg(F.count(F.lit(1)).alias("_n"))
    blocks = attach(layout, block_arrays(layout, [value], with_halo=True), stats)
    schema = blocks.select(*layout.block_key).schema.add("j0", T.LongType()).add(value, DOUBLES)

    def one(x: np.ndarray, blk: int, first_i: int, n: int) -> tuple[int, list]:
        begin = -(-blk * size * up // down)
        end = min(-(-min((blk + 1) * size, n) * up // down), -(-n * up // down))
        m = np.arange(begin, max(begin, end))
        k = (m * down - half + up - 1) // up
        k = k[:, None] + np.arange(2 * half // up + 1)
        lag = (m * down)[:, None] - k * up + half
        inside = (k >= first_i) & (k < first_i + len(x)) & (lag >= 0) & (lag <= 2 * half)
        picked = np.where(inside, x[np.clip(k - first_i, 0, len(x) - 1)] * taps[np.clip(lag, 0, 2 * half)], 0.0)
        return begin, picked.sum(axis=1).tolist()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            done = [
                one(np.asarray(x, dtype=float), int(b), int(f), int(n))
                for x, b, f, n in zip(pdf[value], pdf["blk"], pdf["first_i"], pdf["_n"])
            ]
            yield pdf[key].assign(j0=[d[0] for d in done], **{value: [d[1] for d in done]})

    done = blocks.select(*layout.block_key, "first_i", "_n", value).mapInPandas(run, schema)
    rows = unpack(done, layout, {value: value}, first="j0")
    return rows.select(*layout.key, F.col("i").alias("j"), (F.col("i") / float(fs_out)).alias("t"), value)
