"""Adaptive filters on matrices of windows: one row per window, all rows advance together."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

EPS = 1e-9


def zscore(x: np.ndarray, ddof: int) -> np.ndarray:
    """Row-wise z-score; non-finite samples count as 0, a constant row is only centred."""
    x = np.where(np.isfinite(x), x, 0.0)
    centred = x - x.mean(axis=1, keepdims=True)
    sd = x.std(axis=1, ddof=ddof, keepdims=True) if x.shape[1] > ddof else np.zeros((len(x), 1))
    return centred / np.where(sd > 1e-12, sd, 1.0)


def taps(u: np.ndarray, m: int, k: int) -> np.ndarray:
    """``[row, position, tap]``: samples ``u[n+k] .. u[n-m+1]`` for every complete position."""
    if u.shape[1] < m + k:
        return np.empty((len(u), 0, m + k))
    return np.lib.stride_tricks.sliding_window_view(u, m + k, axis=1)[:, :, ::-1]


def nearest_taps(m: int, k: int, count: int) -> np.ndarray:
    """Tap positions closest to the present sample; of equal distances the past one first."""
    offset = np.arange(k, -m, -1)
    order = np.lexsort((offset > 0, np.abs(offset)))
    return np.sort(order[: max(1, min(count, len(offset)))])


@lru_cache(maxsize=64)
def fourier_weights(size: int, span: int, sigma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed % 2**32)
    weights = rng.normal(0.0, 1.0 / sigma, size=(size, span))
    return weights, rng.uniform(0.0, 2.0 * np.pi, size=size)


def _learn(d: np.ndarray, first: int, parts: list[tuple[np.ndarray, np.ndarray, bool]]) -> np.ndarray:
    """Subtract the running prediction from ``d``.

    ``parts`` are (features ``[row, position, f]``, step per row, normalised step?); the error at a
    position updates the weights of every part before the next position.
    """
    out = d.copy()
    weights = [np.zeros((len(d), f.shape[2])) for f, _, _ in parts]
    for t in range(parts[0][0].shape[1]):
        now = [f[:, t, :] for f, _, _ in parts]
        err = d[:, first + t] - sum((w * x).sum(axis=1) for w, x in zip(weights, now))
        out[:, first + t] = err
        for w, x, (_, step, normalised) in zip(weights, now, parts):
            gain = step / ((x * x).sum(axis=1) + EPS) if normalised else step
            w += (gain * err)[:, None] * x
    return out


def lms(u: np.ndarray, d: np.ndarray, m: int, k: int, mu: np.ndarray) -> np.ndarray:
    """Normalised LMS residual of ``d`` given the reference ``u``; edges keep the z-scored ``d``."""
    return _learn(zscore(d, 1), m - 1, [(taps(zscore(u, 1), m, k), mu, True)])


def volterra(
    u: np.ndarray, d: np.ndarray, m: int, k: int, mu: np.ndarray, alpha: float, m2: int, mu_min: float
) -> np.ndarray:
    """LMS with additional products of the taps nearest to the present sample."""
    x = taps(zscore(u, 1), m, k)
    near = x[:, :, nearest_taps(m, k, m2)]
    rows, cols = np.triu_indices(near.shape[2])
    mu1 = np.maximum(mu, mu_min)
    mu2 = np.maximum(alpha * mu1, mu_min * max(alpha, 1e-6))
    out = _learn(zscore(d, 1), m - 1, [(x, mu1, True), (near[:, :, rows] * near[:, :, cols], mu2, True)])
    return np.where(np.isfinite(out), out, 0.0)


def fourier_lms(
    u: np.ndarray, d: np.ndarray, m: int, k: int, mu: np.ndarray, size: int, sigma: float, seed: int, mu_min: float
) -> np.ndarray:
    """LMS on fixed random Fourier features of the taps."""
    weights, phase = fourier_weights(size, m + k, max(sigma, 1e-6), seed)
    features = np.sqrt(2.0 / size) * np.cos(taps(zscore(u, 1), m, k) @ weights.T + phase)
    out = _learn(zscore(d, 1), m - 1, [(features, np.maximum(mu, mu_min), False)])
    return np.where(np.isfinite(out), out, 0.0)


def adapt(kind: str, u: np.ndarray, d: np.ndarray, m: np.ndarray, k: np.ndarray, mu: np.ndarray, p: dict) -> np.ndarray:
    """Apply one filter kind where order and future taps differ by row: equal designs run together."""
    out = np.empty_like(d, dtype=float)
    designs = np.stack([m, k], axis=1)
    for mm, kk in np.unique(designs, axis=0):
        pick = (m == mm) & (k == kk)
        args = (u[pick], d[pick], int(mm), int(kk), mu[pick])
        if kind == "lms":
            out[pick] = lms(*args)
        elif kind == "volterra":
            out[pick] = volterra(*args, p.get("alpha_u", 0.1), int(p.get("M2", 3)), p.get("LMS_Mu_Min", 1e-6))
        elif kind == "rff_lms":
            out[pick] = fourier_lms(
                *args, int(p.get("rff_D", 100)), p.get("rff_sigma", 1.0), int(p.get("rff_seed", 0)), p.get("LMS_Mu_Min", 1e-6)
            )
        else:
            raise ValueError(f"unknown adaptive filter: {kind}")
    return out
