"""Small numpy helpers for digital filters.  Signals are rows of a matrix, so a whole Arrow batch of
windows or blocks is filtered at once."""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np

CHUNK = 64


def _sections(prototype_zeros: int, poles: np.ndarray, gain: float, numerator: list[float]) -> np.ndarray:
    """Second-order sections ``b0 b1 b2 a1 a2`` by the bilinear transform at a sampling rate of 2.

    Poles come in conjugate pairs (even orders only); the gain is spread evenly over the sections.
    """
    fs2 = 4.0
    digital = (fs2 + poles) / (fs2 - poles)
    gain = gain * fs2**prototype_zeros / np.real(np.prod(fs2 - poles))
    upper = digital[digital.imag > 0]
    scale = gain ** (1.0 / len(upper))
    return np.array([[*(scale * np.array(numerator)), -2.0 * p.real, abs(p) ** 2] for p in upper])


def _prototype(order: int) -> np.ndarray:
    if order % 2:
        raise ValueError("only even filter orders")
    k = np.arange(1, order + 1)
    return np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))


@lru_cache(maxsize=64)
def butter_bandpass(order: int, low: float, high: float) -> np.ndarray:
    """Sections of a Butterworth band-pass; edges as fractions of the Nyquist frequency."""
    lo, hi = 4.0 * np.tan(np.pi * np.array([low, high]) / 2.0)
    width, centre = hi - lo, np.sqrt(lo * hi)
    half = _prototype(order) * width / 2.0
    root = np.sqrt(half**2 - centre**2 + 0j)
    return _sections(order, np.concatenate([half + root, half - root]), width**order, [1.0, 0.0, -1.0])


@lru_cache(maxsize=64)
def butter_lowpass(order: int, cut: float) -> np.ndarray:
    warped = 4.0 * np.tan(np.pi * cut / 2.0)
    return _sections(0, _prototype(order) * warped, warped**order, [1.0, 2.0, 1.0])


def _state_space(section: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition matrix and input vector of one section (output = first state + b0 * input)."""
    b0, b1, b2, a1, a2 = section
    return np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])


def steady_state(sections: np.ndarray) -> np.ndarray:
    """States ``[section, 2]`` after an endless input of ones."""
    states, level = [], 1.0
    for sec in sections:
        step, feed = _state_space(sec)
        states.append(level * np.linalg.solve(np.eye(2) - step, feed))
        level *= sec[:3].sum() / (1.0 + sec[3] + sec[4])
    return np.array(states)


@lru_cache(maxsize=256)
def _section_parts(section: tuple[float, ...], m: int) -> tuple[np.ndarray, ...]:
    """Matrices that carry ``m`` samples and a state to ``m`` outputs and the next state."""
    step, feed = _state_space(np.array(section))
    powers = [np.eye(2)]
    for _ in range(m):
        powers.append(powers[-1] @ step)
    impulse = np.array([section[0]] + [(p @ feed)[0] for p in powers[:-1]])
    lag = np.subtract.outer(np.arange(m), np.arange(m))
    inner = np.where(lag >= 0, impulse[np.abs(lag)], 0.0).T
    from_state = np.array([powers[t][0] for t in range(m)]).T
    to_state = np.array([powers[m - 1 - t] @ feed for t in range(m)])
    return inner, from_state, to_state, powers[m].T


def _run_section(section: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = x.shape[1]
    out = np.empty_like(x, dtype=float)
    for start in range(0, n, CHUNK):
        part = x[:, start : start + CHUNK]
        m = part.shape[1]
        inner, from_state, to_state, onward = _section_parts(tuple(section), m)
        out[:, start : start + m] = state @ from_state + part @ inner
        state = state @ onward + part @ to_state
    return out, state


def run_filter(sections: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter the rows of ``x`` from the states ``[row, section, 2]``; returns output and final states.

    Each section advances ``CHUNK`` samples per matrix product instead of one sample per step.
    """
    final = np.empty(state.shape)
    for j, section in enumerate(sections):
        x, final[:, j] = _run_section(section, x, state[:, j])
    return x, final


def carry_matrix(sections: np.ndarray, n: int) -> np.ndarray:
    """How the flattened state moves over ``n`` samples of silence."""
    size = 2 * len(sections)
    one = np.eye(size).reshape(size, len(sections), 2)
    _, after = run_filter(sections, np.zeros((size, n)), one)
    return after.reshape(size, size).T


def pad_length(sections: np.ndarray) -> int:
    return 3 * (2 * len(sections) + 1)


def odd_pad(x: np.ndarray, pad: int, side: str) -> np.ndarray:
    """Samples that extend the rows point-symmetrically before the head or behind the tail."""
    if side == "head":
        return 2.0 * x[:, :1] - x[:, pad:0:-1]
    return 2.0 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering of complete rows with odd extension."""
    pad = pad_length(sections)
    ext = np.hstack([odd_pad(x, pad, "head"), x, odd_pad(x, pad, "tail")])
    rest = steady_state(sections)
    ahead, _ = run_filter(sections, ext, ext[:, :1, None] * rest)
    back, _ = run_filter(sections, ahead[:, ::-1], ahead[:, -1:, None] * rest)
    return back[:, ::-1][:, pad:-pad]


def analytic_magnitude(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal of each row."""
    n = x.shape[1]
    weight = np.zeros(n)
    weight[0] = 1.0
    weight[1 : (n + 1) // 2] = 2.0
    if n % 2 == 0:
        weight[n // 2] = 1.0
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * weight, axis=1))


@lru_cache(maxsize=16)
def resample_taps(rate_in: int, rate_out: int) -> tuple[int, int, np.ndarray]:
    """Factors and low-pass taps (Kaiser window, beta 5) of a rational rate change."""
    g = gcd(rate_in, rate_out)
    up, down = rate_out // g, rate_in // g
    widest = max(up, down)
    half = 10 * widest
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / widest) * np.kaiser(2 * half + 1, 5.0)
    return up, down, taps / taps.sum() * up
