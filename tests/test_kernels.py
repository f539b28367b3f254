"""Kernels against definitions, brute force and analytic signals."""

from itertools import permutations

import numpy as np
import pytest

from carillon.operators.kernels import amplitude_spectrum, analytic_envelope, assign, find_peaks


def test_on_bin_sine_has_its_amplitude():
    t = np.arange(1024) / 1024
    mag = amplitude_spectrum(0.7 * np.sin(2 * np.pi * 64 * t))
    assert mag.argmax() == 64
    assert mag[64] == pytest.approx(0.7, rel=1e-5)


def test_two_sines_and_padding():
    t = np.arange(1024) / 1024
    x = 0.8 * np.sin(2 * np.pi * 50 * t) + 0.25 * np.sin(2 * np.pi * 150 * t)
    mag = amplitude_spectrum(x, n_fft=4096)
    assert mag[200] == pytest.approx(0.8, rel=1e-2) and mag[600] == pytest.approx(0.25, rel=1e-2)


def test_envelope_of_a_sine_is_flat():
    x = np.sin(2 * np.pi * 8 * np.arange(256) / 256)
    assert analytic_envelope(x) == pytest.approx(np.ones(256), abs=1e-9)


def test_peaks_plateau_prominence_and_width():
    y = np.array([0, 1, 3, 3, 3, 1, 2, 0.5, 5, 0.0])
    found = find_peaks(y)
    assert [p for p, _, _ in found] == [3, 6, 8]
    assert [q for _, q, _ in found] == pytest.approx([2.5, 1.0, 5.0])
    assert find_peaks(y, distance=3)[-1][0] == 8 and len(find_peaks(y, prominence=2.0)) == 2


@pytest.mark.parametrize("shape", [(3, 3), (2, 4), (4, 2), (1, 1), (4, 4)])
def test_assignment_is_cheapest(shape):
    rng = np.random.default_rng(shape[0] * 10 + shape[1])
    for _ in range(20):
        costs = rng.integers(0, 30, shape).astype(float)
        pairs = assign(costs)
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == min(shape)
        tall = costs if shape[0] <= shape[1] else costs.T
        best = min(sum(tall[i, c] for i, c in enumerate(p)) for p in permutations(range(tall.shape[1]), tall.shape[0]))
        assert sum(costs[r, c] for r, c in pairs) == best
