"""Multifractal detrended fluctuation analysis of one window of intervals, from its published definition."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ORDERS = np.linspace(-10, 10, 20)
DROPPED = 4


@lru_cache(maxsize=1024)
def _fit_matrix(lag: int, degree: int) -> np.ndarray:
    """The matrix that takes segments of ``lag`` points to their least-squares polynomials."""
    basis = np.vander(np.arange(lag), degree + 1)
    return (basis @ np.linalg.pinv(basis)).T


def fluctuations(x: np.ndarray, lags: np.ndarray, orders: np.ndarray, degree: int = 1) -> np.ndarray:
    """F_q(lag) of each row of ``x``: (rows, lags, orders). The profile is cut into segments of ``lag`` from both ends and detrended in each.

    A lag with a segment that the fit meets exactly has zeros.
    """
    profile = np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1)
    out = np.zeros((len(x), len(lags), len(orders)))
    for k, lag in enumerate(lags):
        n = profile.shape[1] // lag
        parts = np.concatenate([profile[:, : n * lag].reshape(len(x), n, lag), profile[:, profile.shape[1] - n * lag :].reshape(len(x), n, lag)], axis=1)
        var = ((parts - parts @ _fit_matrix(int(lag), degree)) ** 2).mean(axis=2)
        good = (var > 0).all(axis=1)
        log = np.log(var[good])
        #: Means of powers by logarithms, with the largest taken out; the mean is over segments.
        scaled = log[:, :, None] * (orders / 2)
        top = scaled.max(axis=1, keepdims=True)
        out[good, k] = np.exp((np.log(np.exp(scaled - top).mean(axis=1)) + top[:, 0]) / orders)
    return out


def hurst_batch(x: np.ndarray) -> np.ndarray:
    """For each row, slopes of log F_q by log lag for the last sixteen of twenty orders; lags with a zero are dropped, and with fewer than two left all are NaN."""
    lags = np.unique(np.linspace(1, (x.shape[1] - 1) / 4, 10).astype(int))
    lags = lags[lags > 2]
    out = np.full((len(x), len(ORDERS) - DROPPED), np.nan)
    if len(lags) < 2:
        return out
    found = fluctuations(x, lags, ORDERS)
    good = (found > 0).all(axis=2) & np.isfinite(found).all(axis=2)
    weight = good[:, :, None].astype(float)
    at = np.log(lags)[None, :, None]
    log = np.log(np.where(good[:, :, None], found, 1.0))
    count = weight.sum(axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        dx = (at - (at * weight).sum(axis=1, keepdims=True) / count) * weight
        slopes = (dx * log).sum(axis=1) / (dx * dx).sum(axis=1)
    enough = good.sum(axis=1) >= 2
    out[enough] = slopes[enough][:, DROPPED:]
    return out


def hurst_exponents(x: np.ndarray) -> np.ndarray:
    """The same of one window; an error where there are none."""
    x = np.asarray(x, float)
    found = hurst_batch(x[~np.isnan(x)][None])[0]
    if np.isnan(found).all():
        raise ValueError("too few lags")
    return found


def thirds(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Slopes of straight lines through the first, middle and last third of the points."""
    a, b = int(len(x) / 3), int(2 * len(x) / 3)
    return [float(np.polyfit(x[i:j], y[i:j], 1)[0]) for i, j in ((0, a), (a, b), (b, len(x)))]


_NAMES = ("mf_hurst_max", "mf_coef_left", "mf_coef_center", "mf_coef_right")


def fractal_batch(windows: list[np.ndarray]) -> np.ndarray:
    """Rows of largest exponent and the three slopes of the spectrum of many windows of intervals; zeros where they can't be had. Windows of one length go together."""
    out = np.zeros((len(windows), len(_NAMES)))
    series = [np.asarray(x, float) for x in windows]
    series = [x[~np.isnan(x)] for x in series]
    sizes = np.array([len(x) for x in series])
    orders = ORDERS[DROPPED:]
    cuts = [0, len(orders) // 3, 2 * len(orders) // 3, len(orders)]
    for n in np.unique(sizes[sizes > 0]):
        mine = np.flatnonzero(sizes == n)
        h = hurst_batch(np.stack([series[i] for i in mine]))
        columns = [h.max(axis=1)]
        for i, j in zip(cuts, cuts[1:]):
            at = orders[i:j] - orders[i:j].mean()
            columns.append(h[:, i:j] @ at / (at @ at))
        got = np.column_stack(columns)
        got[~np.isfinite(got).all(axis=1)] = 0.0
        out[mine] = got
    return out


def fractal_features(rr_ms: np.ndarray) -> dict[str, float]:
    """The same of one window, by name."""
    return dict(zip(_NAMES, fractal_batch([rr_ms])[0].tolist(), strict=True))
