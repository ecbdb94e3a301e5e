"""Small regressions over one ordered series: unit-root test, autoregression. One series is what a task holds."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

#: Response surface of the Dickey-Fuller p-value with a constant (MacKinnon): ends, the split, both polynomials.
_LOW, _SPLIT, _HIGH = -18.83, -1.61, 2.74
_SMALL = (2.1659, 1.4412, 0.038269)
_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(statistic: float) -> float:
    """P-value of a Dickey-Fuller statistic with a constant."""
    if statistic > _HIGH:
        return 1.0
    if statistic < _LOW:
        return 0.0
    terms = _SMALL if statistic <= _SPLIT else _LARGE
    return NormalDist().cdf(sum(c * statistic**k for k, c in enumerate(terms)))


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients, residual sum of squares, inverse of x'x)."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    return beta, float(((y - x @ beta) ** 2).sum()), inverse


def akaike(rss: float, n: int, k: int) -> float:
    """AIC of a normal regression with k coefficients."""
    return n * (math.log(2 * math.pi * max(rss, 1e-300) / n) + 1) + 2 * k


def _differences(series: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns: level before, ``lags`` earlier differences, constant; and the differences to explain."""
    d = np.diff(series)
    n = len(d) - lags
    columns = [series[lags : lags + n], *(d[lags - k : lags - k + n] for k in range(1, lags + 1)), np.ones(n)]
    return np.column_stack(columns), d[lags:]


def unit_root_test(series: np.ndarray) -> tuple[float, float, int, int] | None:
    """Augmented Dickey-Fuller: (statistic, p, lags used, observations), lags chosen by AIC over one common sample; None below
    20 values or for a constant."""
    series = np.asarray(series, float)
    series = series[~np.isnan(series)]
    n = len(series)
    if n < 20 or series.max() == series.min():
        return None
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    x, y = _differences(series, most)
    scores = []
    for lags in range(most + 1):
        some = np.column_stack([x[:, : lags + 1], x[:, -1]])
        scores.append(akaike(least_squares(some, y)[1], len(y), some.shape[1]))
    used = int(np.argmin(scores))
    x, y = _differences(series, used)
    beta, rss, inverse = least_squares(x, y)
    error = math.sqrt(rss / (len(y) - x.shape[1]) * inverse[0, 0])
    statistic = float(beta[0] / error)
    return statistic, unit_root_p(statistic), used, len(y)


def made_stationary(series: np.ndarray) -> tuple[np.ndarray, int]:
    """The series, its first or its second differences: the first that passes the test at 0.05, else the second."""
    for times in (0, 1):
        found = unit_root_test(np.diff(series, times))
        if found and found[1] < 0.05:
            return np.diff(series, times), times
    return np.diff(series, 2), 2


def baseline_informativeness(prices: np.ndarray, most: int = 24, least: int = 100) -> float:
    """1 - R2 of the autoregression of returns with the lowest AIC, in [0, 1]; 0.5 where there are too few values."""
    prices = np.asarray(prices, float)
    prices = prices[~np.isnan(prices)]
    if len(prices) < least:
        return 0.5
    r = np.diff(prices) / prices[:-1]
    r = r[~np.isnan(r)]
    if len(r) < least:
        return 0.5
    best = (math.inf, 0.0, 0)
    for lag in range(1, min(most + 1, len(r) // 10)):
        n = len(r) - lag
        x = np.column_stack([np.ones(n), *(r[lag - k : lag - k + n] for k in range(1, lag + 1))])
        rss = least_squares(x, r[lag:])[1]
        # the lag order counts, with the constant and the variance
        best = min(best, (n * (math.log(2 * math.pi * max(rss, 1e-300) / n) + 1) + 2 * (lag + 2), rss, lag))
    total = float(((r[best[2] :] - r.mean()) ** 2).sum())
    if not best[2] or total == 0:
        return 0.5
    return 1.0 - max(0.0, min(1.0, 1 - best[1] / total))
