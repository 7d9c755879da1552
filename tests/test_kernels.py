"""Hand-worked vectors and properties of the numeric kernels and the discrete operators."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tachygraph.functions import fractal, peaks, point_process, spectral
from tachygraph.functions.registry import FEATURES, NAMES, POSITIONS
from tachygraph.functions.scalars import check_windows
from tachygraph.operators.quality import match_peaks
from tachygraph.sources import matfile

V = [800, 810, 790, 1000, 805, 795, 700, 812, 799, 803]


def test_registry():
    assert len(FEATURES) == 38 and all(POSITIONS[NAMES[k]] == k for k in range(38))
    with pytest.raises(KeyError):
        POSITIONS["nothing"]


def test_spline_is_exact_on_cubics():
    x = np.sort(np.random.default_rng(0).random(12)) * 10
    f = lambda t: 2 * t**3 - t**2 + 3 * t - 1
    at = np.linspace(x[0], x[-1], 50)
    assert np.allclose(spectral.not_a_knot(x, f(x), at), f(at))


def test_spectrum_finds_a_tone():
    t = np.arange(400)
    rr = 800 + 50 * np.sin(2 * np.pi * 0.1 * t * 0.8)
    got = spectral.spectral_features(rr)
    assert got["lf"] > got["hf"] and np.isclose(got["total_power"], got["ulf"] + got["vlf"] + got["lf"] + got["hf"])
    assert all(np.isnan(v) for v in spectral.spectral_features(np.array([800.0, 800.0])).values())


def plain_spectrum(rr):
    """From the definitions: a dense system for the spline's pieces, and the transform's sums written out."""
    x = np.cumsum(rr / 1000) - rr[0] / 1000
    n = len(x)
    a, b = np.zeros((4 * (n - 1), 4 * (n - 1))), np.zeros(4 * (n - 1))
    powers = lambda t, d: [t**3, t**2, t, 1.0] if d == 0 else [3 * t**2, 2 * t, 1.0, 0.0] if d == 1 else [6 * t, 2.0, 0.0, 0.0]
    r = 0
    for k in range(n - 1):
        for t, y in ((0.0, rr[k]), (x[k + 1] - x[k], rr[k + 1])):
            a[r, 4 * k : 4 * k + 4], b[r] = powers(t, 0), y
            r += 1
    for k in range(n - 2):
        for d in (1, 2):
            a[r, 4 * k : 4 * k + 4] = powers(x[k + 1] - x[k], d)
            a[r, 4 * k + 4 : 4 * k + 8] = [-v for v in powers(0.0, d)]
            r += 1
    for k in (0, n - 3):
        a[r, 4 * k], a[r, 4 * k + 4] = 1.0, -1.0
        r += 1
    c = np.linalg.solve(a, b).reshape(n - 1, 4)
    grid = np.arange(0, x[-1], 1 / 7.0)
    y = np.array([np.polyval(c[(k := min(int(np.searchsorted(x, t, side="right")) - 1, n - 2))], t - x[k]) for t in grid])
    y = np.round(y / 1000, 4)
    y = (y - y.mean()) / y.std()
    size = 2 ** int(np.ceil(np.log2(len(y))))
    k = np.arange(size // 2 + 1)
    spectrum = 2 * np.abs(np.exp(-2j * np.pi * np.outer(k, np.arange(len(y))) / size) @ y) / len(y)
    out = {name: spectrum[(k * 7.0 / size >= lo) & (k * 7.0 / size <= hi)].sum() for name, (lo, hi) in spectral.BANDS.items()}
    return out | {"total_power": sum(out.values()), "lf_hf_ratio": round(out["lf"] / out["hf"] * 100) / 100}


def plain_fractal(x):
    """Segment by segment, with numpy's polynomial fits."""
    profile, rows, used = np.cumsum(x - x.mean()), [], []
    for lag in sorted({int(v) for v in np.linspace(1, (len(x) - 1) / 4, 10)}):
        if lag <= 2:
            continue
        n, t = len(profile) // lag, np.arange(lag)
        parts = [profile[k * lag : (k + 1) * lag] for k in range(n)] + [profile[len(profile) - (k + 1) * lag : len(profile) - k * lag] for k in range(n)]
        var = np.array([np.mean((p - np.polyval(np.polyfit(t, p, 1), t)) ** 2) for p in parts])
        rows.append([np.mean(var ** (q / 2)) ** (1 / q) for q in np.linspace(-10, 10, 20)])
        used.append(lag)
    h = np.array([np.polyfit(np.log(used), np.log(f), 1)[0] for f in np.array(rows).T])[4:]
    q = np.linspace(-10, 10, 20)[4:]
    return [h.max(), *(np.polyfit(q[a:b], h[a:b], 1)[0] for a, b in ((0, 5), (5, 10), (10, 16)))]


def test_shape_kernels_against_the_definitions():
    rng = np.random.default_rng(6)
    many = [600 + 400 * rng.random(n) for n in (60, 75, 60, 91, 44)] + [np.full(50, 800.0), np.array([800.0]), np.array([800.0, 900.0]), np.array([])]
    s, f = spectral.spectral_batch(many), fractal.fractal_batch(many)
    for k, x in enumerate(many[:5]):
        want = plain_spectrum(x)
        assert np.allclose(s[k], [want[n] for n in spectral._NAMES], rtol=1e-6)
        assert np.allclose(f[k], plain_fractal(x), rtol=1e-6)
        assert np.allclose(list(spectral.spectral_features(x).values()), s[k]) and np.allclose(list(fractal.fractal_features(x).values()), f[k])
    assert np.isnan(s[6:]).all() and (f[5:] == 0).all()


def test_fractal():
    rng = np.random.default_rng(1)
    noise = fractal.hurst_exponents(rng.normal(size=4000))
    assert len(noise) == 16 and abs(noise[8] - 0.5) < 0.15
    assert set(fractal.fractal_features(np.array([800.0] * 5)).values()) == {0.0}


def test_peak_matching():
    assert match_peaks(np.array([100, 200]), np.array([150]), 60) == (1, 1, 0)


@given(st.lists(st.integers(0, 300), unique=True), st.lists(st.integers(0, 300), unique=True), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_peak_matching_against_the_plain_form(a, b, limit):
    a, b = sorted(a), sorted(b)
    free, hits = list(range(len(b))), 0
    for p in a:
        near = [k for k in free if abs(b[k] - p) <= limit]
        if near:
            free.remove(min(near, key=lambda k: (abs(b[k] - p), k)))
            hits += 1
    assert match_peaks(np.array(a), np.array(b), limit) == (hits, len(a) - hits, len(b) - hits)


def test_refine_takes_the_higher_side():
    assert peaks.refine(np.array([0, 1, 3, 2, 2, 5, 0.0]), np.array([3])).tolist() == [5]


@pytest.mark.parametrize("method", sorted(peaks.DETECTORS))
def test_detectors_find_clean_beats(method):
    freq, n = 256, 30
    t = np.arange(n * freq) / freq
    signal = sum(np.exp(-((t - k - 0.5) ** 2) / (2 * 0.012**2)) for k in range(n))
    got = peaks.refine(signal, peaks.detect(signal, freq, method))
    want = (np.arange(n) + 0.5) * freq
    hits = match_peaks(want, got, 0.1 * freq)[0]
    assert hits >= 0.9 * n and len(got) <= 1.2 * n
    with pytest.raises(ValueError):
        peaks.detect(signal, freq, "no such")


def test_density_integrates_to_one():
    tau = np.linspace(1e-4, 20, 200_000)
    f = np.exp([point_process.log_density(x, 0.0, 0.8, 12.0) for x in tau[::20]])
    assert abs(f.sum() * (tau[20] - tau[0]) - 1) < 1e-2


def test_simplex():
    got = point_process.nelder_mead(lambda p: (p[0] - 3) ** 2 + 10 * (p[1] + 1) ** 2, np.array([0.0, 0.0]))
    assert np.allclose(got, [3, -1], atol=1e-2)


@pytest.mark.parametrize("seed", range(3))
def test_correction_mends_and_leaves_clean_beats(seed):
    rng = np.random.default_rng(seed)
    beats = np.cumsum(0.8 + 0.02 * rng.normal(size=120))
    assert np.array_equal(point_process.correct(beats), beats)
    extra = np.sort(np.append(beats, beats[90] + 0.35))
    assert np.array_equal(point_process.correct(extra), beats)
    missed = point_process.correct(np.delete(beats, 100))
    assert len(missed) == len(beats) and missed[100] == pytest.approx((beats[99] + beats[101]) / 2)
    assert np.array_equal(np.delete(missed, 100), np.delete(beats, 100))


def test_correction_fails_as_documented():
    with pytest.raises(IndexError):
        point_process.correct(np.arange(60) * 0.8)
    with pytest.raises(point_process.NoConvergence):
        point_process.nelder_mead(lambda p: -abs(p[0]), np.array([1.0]), iterations=50)
    assert point_process.log_density(1.0, 1.0, 0.8, 12.0) == pytest.approx(np.log(1e-10))


def test_quality_flag():
    assert point_process.binary_quality(np.arange(0, 10, 0.8)) == 1
    assert point_process.binary_quality(np.array([])) == 0
    assert point_process.binary_quality(np.array([0, 0.8, 4.0])) == 0


def test_windows():
    assert check_windows([-18, 0]) == [-18, 0]
    with pytest.raises(RuntimeError):
        check_windows([1])
    with pytest.raises(RuntimeError):
        check_windows([-19])


def test_mat_round_trip():
    arrays = {"raw_data": np.arange(6.0), "frequency": np.array([256.0]), "r_peaks": np.array([1.0, 4.0])}
    got = matfile.loads(matfile.dumps(arrays))
    assert all(np.array_equal(got[k].ravel(), arrays[k]) for k in arrays)
