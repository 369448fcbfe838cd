"""Incomplete gamma functions and chi-square quantiles, on arrays, for thresholds of the anomaly detector."""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300
_MOST = 10_000


def _log_gamma(a: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in a.ravel().tolist()]).reshape(a.shape)


def gamma_pq(a, x) -> tuple[np.ndarray, np.ndarray]:
    """Regularised lower and upper incomplete gamma functions, each computed itself where it is the smaller one.

    A series below a + 1 gives the lower one, Wallis' recurrences of the continued
    fraction above give the upper one, so that far tails keep their digits. Null
    or NaN arguments give NaN; others need a > 0 and x >= 0.
    """
    a, x = np.broadcast_arrays(np.asarray(a, dtype=np.float64), np.asarray(x, dtype=np.float64))
    a, x = a.copy(), x.copy()
    missing = np.isnan(a) | np.isnan(x)
    if ((a <= 0) | (x < 0))[~missing].any():
        raise ValueError("gamma_p needs a > 0 and x >= 0")
    a[missing], x[missing] = 1.0, 0.0
    with np.errstate(divide="ignore", over="ignore", invalid="ignore", under="ignore"):
        scale = np.exp(a * np.log(np.maximum(x, _TINY)) - x - _log_gamma(a))
        low = x < a + 1
        p, q = np.zeros(a.shape), np.ones(a.shape)
        if low.any():
            al, xl = a[low], x[low]
            term = total = 1 / al
            for n in range(1, _MOST):
                term = term * xl / (al + n)
                total = total + term
                if (np.abs(term) <= np.abs(total) * 1e-16).all():
                    break
            p[low] = np.where(xl > 0, np.minimum(1.0, total * scale[low]), 0.0)
            q[low] = 1 - p[low]
        if (~low).any():
            al, xl = a[~low], x[~low]
            p0, q0, p1, q1 = np.zeros(al.shape), np.ones(al.shape), np.ones(al.shape), xl + 1 - al
            value = p1 / q1
            for n in range(1, _MOST):
                an, bn = n * (al - n), xl + 2 * n + 1 - al
                p0, p1 = p1, bn * p1 + an * p0
                q0, q1 = q1, bn * q1 + an * q0
                large = np.maximum(np.abs(q1), np.abs(p1)) > 1e200
                p0, q0, p1, q1 = (np.where(large, v / 1e200, v) for v in (p0, q0, p1, q1))
                new = np.where(q1 != 0, p1 / np.where(q1 != 0, q1, 1.0), value)
                done = np.abs(new - value) <= 1e-15 * np.abs(new)
                value = new
                if done.all():
                    break
            infinite = np.isinf(xl)
            q[~low] = np.where(infinite, 0.0, np.maximum(0.0, scale[~low] * value))
            p[~low] = 1 - q[~low]
    p[missing] = q[missing] = np.nan
    return p, q


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if math.isnan(a) or math.isnan(x):
        raise ValueError("gamma_p needs a > 0 and x >= 0")
    return float(gamma_pq(a, x)[0])


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if math.isnan(a) or math.isnan(x):
        raise ValueError("gamma_q needs a > 0 and x >= 0")
    return float(gamma_pq(a, x)[1])


def rx_thresholds(bands, rate) -> np.ndarray:
    """Chi-square quantiles: the score that a background pixel exceeds with the given probability, with bands degrees of freedom.

    Newton steps on the logarithm of the upper tail, kept within bounds that
    close in; rates down to the least positive number are resolved.
    """
    bands, rate = np.broadcast_arrays(np.asarray(bands, dtype=np.float64), np.asarray(rate, dtype=np.float64))
    missing = np.isnan(bands) | np.isnan(rate)
    if ((bands <= 0) | (rate <= 0) | (rate >= 1))[~missing].any():
        raise ValueError("the false-alarm rate must lie between 0 and 1, and there must be bands")
    a, want = np.where(missing, 2.0, bands) / 2, np.log(np.where(missing, 0.5, rate))
    log_gamma = _log_gamma(a)
    low, high = np.zeros(a.shape), a - want + np.sqrt(np.maximum(0.0, -2 * want * a * 2)) + 10
    t = a.copy()
    for _ in range(200):
        p, q = gamma_pq(a, t)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            # Where the tail is near 1, its logarithm comes from the lower part.
            log_q = np.where(p < 0.5, np.log1p(-p), np.log(np.maximum(q, 5e-324)))
            slope = -np.exp((a - 1) * np.log(np.maximum(t, _TINY)) - t - log_gamma - log_q)
            low, high = np.where(log_q > want, t, low), np.where(log_q > want, high, t)
            step = t - (log_q - want) / slope
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        if (np.abs(new - t) <= 1e-15 * np.abs(new)).all():
            t = new
            break
        t = new
    return np.where(missing, np.nan, 2 * t)


def rx_threshold(bands: int, rate: float) -> float:
    if math.isnan(rate) or math.isnan(bands):
        raise ValueError("the false-alarm rate must lie between 0 and 1, and there must be bands")
    return float(rx_thresholds(bands, rate))
