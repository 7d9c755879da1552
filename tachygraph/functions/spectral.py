"""Frequency-domain features of one window of intervals: not-a-knot spline, resampling and a padded FFT, with numpy."""

from __future__ import annotations

import numpy as np

BANDS = {"ulf": (0.0, 0.003), "vlf": (0.003, 0.04), "lf": (0.04, 0.15), "hf": (0.15, 0.4)}
RATE = 7.0


def _curvatures(x: np.ndarray, y: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of many not-a-knot splines at once: rows are splines of last + 1 knots (4 at least), padded.

    They solve tridiagonal systems whose end rows follow from the two end conditions; all rows take each step together.
    """
    w, n = x.shape
    rows = np.arange(w)
    h = np.diff(x, axis=1)
    slope = np.diff(y, axis=1) / h
    a, b, c, d = (np.zeros((n, w)) for _ in range(4))
    a[1:-1], b[1:-1], c[1:-1], d[1:-1] = h[:, :-1].T, 2 * (h[:, :-1] + h[:, 1:]).T, h[:, 1:].T, 6 * np.diff(slope, axis=1).T
    r, s = h[:, 0] / h[:, 1], h[rows, last - 1] / h[rows, last - 2]
    #: m0 = (1 + r) m1 - r m2, and likewise at the end.
    b[1] += a[1] * (1 + r)
    c[1] -= a[1] * r
    a[1] = 0
    b[last - 1, rows] += c[last - 1, rows] * (1 + s)
    a[last - 1, rows] -= c[last - 1, rows] * s
    c[last - 1, rows] = 0
    beyond = np.arange(n)[:, None] >= last
    a[beyond] = c[beyond] = d[beyond] = 0
    b[beyond] = 1
    m, cc, dd = np.zeros((n, w)), np.zeros((n, w)), np.zeros((n, w))
    for k in range(1, n - 1):
        below = b[k] - a[k] * cc[k - 1]
        cc[k] = c[k] / below
        dd[k] = (d[k] - a[k] * dd[k - 1]) / below
    for k in range(n - 2, 0, -1):
        m[k] = dd[k] - cc[k] * m[k + 1]
    m[0] = (1 + r) * m[1] - r * m[2]
    m[last, rows] = (1 + s) * m[last - 1, rows] - s * m[last - 2, rows]
    return m.T


def _on_spline(x: np.ndarray, y: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    left, right, w = at - x[k], x[k + 1] - at, (x[1:] - x[:-1])[k]
    return (m[k] * right**3 + m[k + 1] * left**3) / (6 * w) + (y[k] / w - m[k] * w / 6) * right + (y[k + 1] / w - m[k + 1] * w / 6) * left


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through (x, y) whose third derivative is continuous at the second and the last but one knot."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at)
    return _on_spline(x, y, _curvatures(x[None], y[None], np.array([n - 1]))[0], at)


_NAMES = (*BANDS, "lf_hf_ratio", "total_power")


def _amplitudes(samples: list[np.ndarray], rate: float) -> np.ndarray:
    """Rows of features (in the order of _NAMES) of resampled series, whose transforms of equal length are taken together."""
    sizes = np.array([2 ** int(np.ceil(np.log2(len(y)))) for y in samples])
    out = np.full((len(samples), len(_NAMES)), np.nan)
    for n in np.unique(sizes):
        mine = np.flatnonzero(sizes == n)
        padded = np.zeros((len(mine), n))
        for r, i in enumerate(mine):
            y = samples[i]
            padded[r, : len(y)] = (y - y.mean()) / y.std() / len(y)
        amplitude = 2 * np.abs(np.fft.rfft(padded, axis=1))
        freq = np.arange(amplitude.shape[1]) * rate / n
        bands = np.stack([amplitude[:, (freq >= a) & (freq <= b)].sum(axis=1) for a, b in BANDS.values()], axis=1)
        ratio = np.rint(bands[:, 2] / bands[:, 3] * 100) / 100
        out[mine] = np.column_stack([bands, ratio, bands.sum(axis=1)])
    out[~np.isfinite(out).all(axis=1)] = np.nan
    return out


def spectral_batch(windows: list[np.ndarray], rate: float = RATE) -> np.ndarray:
    """Rows of the six features of many windows of intervals (ms): amplitudes by band (both ends count), lf/hf as a rounded ratio, and their sum; NaN where they can't be had."""
    out = np.full((len(windows), len(_NAMES)), np.nan)
    series = [np.asarray(x, float) for x in windows]
    good = [i for i, x in enumerate(series) if len(x) > 1 and np.isfinite(x).all() and (x[1:] > 0).all()]
    with np.errstate(all="ignore"):
        many = [i for i in good if len(series[i]) >= 4]
        bent: dict[int, np.ndarray] = {}
        if many:
            n = max(len(series[i]) for i in many)
            x, y = np.zeros((len(many), n)), np.zeros((len(many), n))
            last = np.array([len(series[i]) - 1 for i in many])
            for r, i in enumerate(many):
                own = series[i]
                t = np.cumsum(own / 1000)
                x[r, : len(own)], y[r, : len(own)] = t - t[0], own
                x[r, len(own) :] = x[r, len(own) - 1] + np.arange(1, n - len(own) + 1)
            m = _curvatures(x, y, last)
            bent = {i: m[r, : len(series[i])] for r, i in enumerate(many)}
        samples, places = [], []
        for i in good:
            own = series[i]
            t = np.cumsum(own / 1000) - own[0] / 1000
            grid = np.arange(0, t[-1], 1 / rate)
            if len(grid):
                y = _on_spline(t, own, bent[i], grid) if i in bent else not_a_knot(t, own, grid)
                samples.append(np.round(y / 1000, 4))
                places.append(i)
        if places:
            out[places] = _amplitudes(samples, rate)
    return out


def spectral_features(rr_ms: np.ndarray, rate: float = RATE) -> dict[str, float]:
    """The same of one window, by name."""
    return dict(zip(_NAMES, spectral_batch([rr_ms], rate)[0].tolist(), strict=True))
