"""Matrix helpers against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from chronoweave.functions import adaptive, spectra
from chronoweave.operators.windows import lag_search, shape_for_delay
from chronoweave.operators.tracking import near_previous, pick_rate, track_rest

RNG = np.random.default_rng(3)
DESIGNS = [(1, 0), (2, 0), (2, 3), (8, 0), (8, 4)]


def z(x):
    return (x - x.mean()) / x.std(ddof=1)


def loop(u, d, m, k, predict):
    u, d = z(u), z(d)
    out = d.copy()
    for n in range(m - 1, len(u) - k):
        x = np.array([u[n + k - j] for j in range(m + k)])
        out[n] = predict(x, d[n])
    return out


def nlms_loop(u, d, m, k, mu):
    w = np.zeros(m + k)

    def predict(x, target):
        nonlocal w
        err = target - w @ x
        w = w + mu * err * x / (x @ x + 1e-9)
        return err

    return loop(u, d, m, k, predict)


def volterra_loop(u, d, m, k, mu, alpha, m2):
    offsets = [k - j for j in range(m + k)]
    near = sorted(sorted(range(m + k), key=lambda j: (abs(offsets[j]), offsets[j] > 0))[:m2])
    w1, w2 = np.zeros(m + k), np.zeros(len(near) * (len(near) + 1) // 2)

    def predict(x, target):
        nonlocal w1, w2
        q = np.array([x[a] * x[b] for i, a in enumerate(near) for b in near[i:]])
        err = target - w1 @ x - w2 @ q
        w1 = w1 + mu * err * x / (x @ x + 1e-9)
        w2 = w2 + alpha * mu * err * q / (q @ q + 1e-9)
        return err

    return loop(u, d, m, k, predict)


def rff_loop(u, d, m, k, mu, size, sigma, seed):
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1 / sigma, (size, m + k))
    b = rng.uniform(0, 2 * np.pi, size)
    theta = np.zeros(size)

    def predict(x, target):
        nonlocal theta
        f = np.sqrt(2 / size) * np.cos(w @ x + b)
        err = target - theta @ f
        theta = theta + mu * err * f
        return err

    return loop(u, d, m, k, predict)


@pytest.mark.parametrize("m,k", DESIGNS)
def test_adaptive_filters_equal_loops(m, k):
    u, d = RNG.normal(size=(2, 4, 128))
    mu = np.array([0.01, 0.02, 0.005, 0.5])
    got = [
        adaptive.lms(u, d, m, k, mu),
        adaptive.volterra(u, d, m, k, mu, 0.1, 3, 1e-6),
        adaptive.fourier_lms(u, d, m, k, mu, 20, 1.0, 7, 1e-6),
    ]
    for r in range(4):
        np.testing.assert_allclose(got[0][r], nlms_loop(u[r], d[r], m, k, mu[r]), atol=1e-12)
        np.testing.assert_allclose(got[1][r], volterra_loop(u[r], d[r], m, k, mu[r], 0.1, 3), atol=1e-12)
        np.testing.assert_allclose(got[2][r], rff_loop(u[r], d[r], m, k, mu[r], 20, 1.0, 7), atol=1e-12)


def test_mixed_designs_equal_single_ones():
    u, d = RNG.normal(size=(2, 6, 64))
    m, k, mu = np.array([1, 2, 2, 8, 2, 1]), np.array([0, 3, 0, 4, 3, 0]), np.full(6, 0.01)
    got = adaptive.adapt("lms", u, d, m, k, mu, {})
    for r in range(6):
        np.testing.assert_allclose(got[r], nlms_loop(u[r], d[r], m[r], k[r], 0.01), atol=1e-12)
    with pytest.raises(ValueError, match="unknown adaptive filter"):
        adaptive.adapt("other", u, d, m, k, mu, {})


def test_taps_and_short_windows():
    x = adaptive.taps(np.arange(20.0)[None], 3, 2)
    assert x[0, 0].tolist() == [4, 3, 2, 1, 0] and x.shape == (1, 16, 5)
    assert adaptive.nearest_taps(2, 3, 2).tolist() == [3, 4]
    short = RNG.normal(size=(1, 5))
    np.testing.assert_allclose(adaptive.lms(short, short, 8, 4, np.array([0.1])), adaptive.zscore(short, 1))


def test_lag_search_finds_shifts():
    a = RNG.normal(size=(1, 200))
    for shift in (5, -7, 0):
        lag, r = lag_search(a, np.roll(a, -shift, axis=1), 10)
        assert lag[0] == shift and r[0] > 0.99
    lag, r = lag_search(np.ones((1, 32)), a[:, :32], 4)
    assert lag[0] == 0 and r[0] == 0.0


def test_envelope_follows_amplitude():
    t = np.arange(800) / 100
    slow = 1.0 + 0.5 * np.sin(2 * np.pi * 0.25 * t)
    env = shape_for_delay((slow * np.sin(2 * np.pi * 8 * t))[None], 100.0, 0.5, 4.0, "envelope")[0]
    assert np.corrcoef(env, slow)[0, 1] > 0.98
    with pytest.raises(ValueError, match="delay mode"):
        shape_for_delay(np.ones((1, 4)), 1.0, 1.0, 1.0, "none")


def test_spectra():
    t = np.arange(800) / 100
    x = np.sin(2 * np.pi * 1.5 * t)[None] + 0.2 * np.sin(2 * np.pi * 3 * t)
    assert spectra.dominant(x, 100.0, 0.5, 4.0)[0] == pytest.approx(1.5, abs=0.02)
    freq, amp = spectra.peak_candidates(spectra.prepare(x, symmetric=True), 100.0, 0.5, 4.0, 0.1)[0]
    assert len(freq) >= 2 and freq[np.argmax(amp)] == pytest.approx(1.5, abs=0.02)
    flat = np.array([[0, 1, 1, 1, 0, 2, 0, 3, 3]], dtype=float)
    assert np.flatnonzero(spectra.local_peaks(flat)[0]).tolist() == [2, 5]
    assert np.isnan(spectra.dominant(x, 100.0, 60.0, 70.0)[0])
    np.testing.assert_allclose(spectra.hamming(5, True), [0.08, 0.54, 1.0, 0.54, 0.08])


def test_trackers():
    assert near_previous(np.array([9.0, 2.4, 2.0]), 2.2, 0.5) == (2.4, 2)
    assert near_previous(np.array([9.0, 8, 7, 6, 5, 2.2]), 2.2, 0.5) == (2.2, 0)
    out, carry = track_rest([[1.2], [], [2.5, 1.25]], None, band=30.0, limit=6.0, step=4.0)
    assert out == [pytest.approx(72.0), None, pytest.approx(75.0)] and carry == [out[2]]
    freq = np.array([1.0, 1.2, 1.4, 3.0])
    how = {"reach_hz": 0.25, "limit": 10.0, "step": 7.0}
    assert pick_rate(freq, np.array([1, 2, 3, 9.0]), None, **how) == pytest.approx(180.0)
    assert pick_rate(freq, np.array([1, 2, 3, 9.0]), 72.0, **how) == pytest.approx(79.0)
    assert pick_rate(freq, np.array([1, 2, 3, 9.0]), 300.0, **how) == pytest.approx(300.0)


def test_low_passes_that_differ_by_row_run_together():
    x, move = RNG.normal(size=(40, 64)), RNG.choice([0.2, 0.7, 1.5, 3.0], 40)
    together = shape_for_delay(x, 16.0, 0.3, move, "envelope")
    alone = np.vstack([shape_for_delay(row[None], 16.0, 0.3, float(f), "envelope") for row, f in zip(x, move)])
    assert np.allclose(together, alone, rtol=0, atol=1e-12)
