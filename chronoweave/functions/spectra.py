"""Spectra of matrices of windows (one row per window)."""

from __future__ import annotations

import numpy as np


def hamming(n: int, symmetric: bool) -> np.ndarray:
    if n == 1:
        return np.ones(1)
    return 0.54 - 0.46 * np.cos(2.0 * np.pi * np.arange(n) / (n - 1 if symmetric else n))


def prepare(x: np.ndarray, *, window: bool = True, symmetric: bool = False) -> np.ndarray:
    """Non-finite samples to 0, mean removed, Hamming weighted."""
    x = np.where(np.isfinite(x), x, 0.0)
    x = x - x.mean(axis=1, keepdims=True)
    return x * hamming(x.shape[1], symmetric) if window else x


def fft_length(n: int) -> int:
    return max(8192, 1 << int(np.ceil(np.log2(max(n, 1)))))


def magnitude(x: np.ndarray, fs: float, nfft: int | None = None, **how) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and magnitude spectrum (not power) of each row."""
    nfft = nfft or fft_length(x.shape[1])
    return np.fft.rfftfreq(nfft, 1.0 / fs), np.abs(np.fft.rfft(prepare(x, **how), nfft, axis=1))


def local_peaks(amp: np.ndarray) -> np.ndarray:
    """Mask of strict local maxima of each row; a flat top counts once, in its middle."""
    mask = np.zeros(amp.shape, bool)
    up = amp[:, 1:-1] > amp[:, :-2]
    mask[:, 1:-1] = up & (amp[:, 1:-1] > amp[:, 2:])
    for r, c in zip(*np.nonzero(up & (amp[:, 1:-1] == amp[:, 2:]))):
        start = end = c + 1
        while end + 1 < amp.shape[1] and amp[r, end + 1] == amp[r, start]:
            end += 1
        if end + 1 < amp.shape[1] and amp[r, end + 1] < amp[r, start]:
            mask[r, (start + end) // 2] = True
    return mask


def dominant(x: np.ndarray, fs: float, low: float, high: float, nfft: int | None = None) -> np.ndarray:
    """Frequency of the highest local peak inside the band, else of the band maximum."""
    freq, amp = magnitude(x, fs, nfft)
    band = (freq >= low) & (freq <= high)
    if not band.any():
        return np.full(len(x), np.nan)
    inside = amp[:, band]
    peaks = local_peaks(inside)
    score = np.where(peaks | ~peaks.any(axis=1, keepdims=True), inside, -1.0)
    return freq[band][score.argmax(axis=1)]


def peak_candidates(
    x: np.ndarray, fs: float, low: float, high: float, share: float, nfft: int = 8192
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Frequencies and amplitudes of in-band local peaks above ``share`` of the largest, per row.

    ``x`` is prepared already; amplitudes are one-sided (doubled except at zero).
    """
    half = nfft // 2
    amp = np.abs(np.fft.rfft(x, nfft, axis=1))[:, :half] / max(x.shape[1], 1)
    amp[:, 1:] *= 2.0
    freq = fs * np.arange(half) / nfft
    keep = local_peaks(amp) & (freq >= low) & (freq <= high)
    limit = np.where(keep, amp, 0.0).max(axis=1, keepdims=True) * share
    keep &= amp > limit
    return [(freq[k], a[k]) for k, a in zip(keep, amp)]


def strongest(candidates: list[np.ndarray]) -> np.ndarray:
    """Row-wise the candidate window with the largest energy, the first of equals."""
    energy = [np.round(((c - c.mean(axis=1, keepdims=True)) ** 2).sum(axis=1), 9) for c in candidates]
    return np.stack(candidates)[np.argmax(energy, axis=0), np.arange(len(candidates[0]))]
