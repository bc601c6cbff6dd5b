"""Numeric kernels over one ordered series (numpy; NaN is missing)."""

from __future__ import annotations

from math import lgamma
from statistics import NormalDist

import numpy as np

EPSILON = np.finfo(float).eps


def z_of(level: float) -> float:
    """Two-sided normal quantile."""
    return NormalDist().inv_cdf(0.5 + level / 2)


def threshold(default: float, sensitivity: float | None) -> float:
    return default if sensitivity is None else 6 - 4 * min(1.0, max(0.0, sensitivity))


def mad(v: np.ndarray) -> float:
    v = v[np.isfinite(v)]
    return float(np.median(np.abs(v - np.median(v)))) if len(v) else np.nan


def interpolate(v: np.ndarray) -> np.ndarray:
    """Linear by position; ends take the nearest."""
    ok = np.flatnonzero(np.isfinite(v))
    return np.interp(np.arange(len(v)), ok, v[ok]) if len(ok) else v.copy()


def local_median(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and MAD of a centred window that slides inward at the ends, so it always has k values."""
    n, k = len(v), min(k, len(v))
    centre, spread = np.empty(n), np.empty(n)
    for i in range(n):
        lo = min(max(0, i - k // 2), n - k)
        w = v[lo : lo + k]
        w = w[np.isfinite(w)]
        centre[i] = np.median(w) if len(w) else np.nan
        spread[i] = np.median(np.abs(w - centre[i])) if len(w) else np.nan
    return centre, spread


def moving(v: np.ndarray, half: int, how) -> np.ndarray:
    """A statistic of windows that are cut at the ends."""
    return np.array([how(v[max(0, i - half) : i + half + 1]) for i in range(len(v))])


def moving_average(v: np.ndarray, k: int) -> np.ndarray:
    """Odd widths are plain, even ones the mean of the two windows that are off by one; cut at the ends."""
    n = len(v)
    if k % 2:
        return moving(v, k // 2, np.mean)
    h = k // 2
    a = np.array([v[max(0, i - h) : min(n, i + h)].mean() for i in range(n)])
    b = np.array([v[max(0, i - h + 1) : min(n, i + h + 1)].mean() for i in range(n)])
    return (a + b) / 2


def decompose(v: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal part (medians by phase, centred) and remainder (missing where the value is)."""
    if period < 2 or len(v) < 2 * period:
        raise ValueError("decomposition needs two periods")
    full = interpolate(v)
    rounded = period if period % 2 else period + 1
    trend = moving_average(moving(full, rounded // 2, np.median), period)
    phase = np.arange(len(v)) % period
    effect = np.array([np.median((full - trend)[phase == p]) for p in range(period)])
    effect -= effect.mean()
    return trend, effect[phase], v - trend - effect[phase]


def autocorrelation(v: np.ndarray, lag: int) -> float:
    """Biased; a missing value counts as the mean."""
    ok = np.isfinite(v)
    if not ok.any() or lag >= len(v):
        return np.nan
    d = np.where(ok, v - v[ok].mean(), 0.0)
    total = (d * d).sum()
    return float((d[: len(d) - lag] * d[lag:]).sum() / total) if total else np.nan


def detrend(v: np.ndarray) -> np.ndarray:
    x = np.arange(len(v)) - (len(v) - 1) / 2
    full = interpolate(v)
    slope = (x * (full - full.mean())).sum() / max((x * x).sum(), EPSILON)
    return full - full.mean() - slope * x


def periodogram(d: np.ndarray, least: int, most: int, quantile: float = 0.9) -> list[int]:
    """Periods at peaks of Welch's spectrum (Hann windows that overlap by half) whose power is above a quantile of all powers."""
    n = len(d)
    size = min(n, max(2 * most, n // 2))
    window = np.hanning(size + 1)[:size]
    parts = [d[i : i + size] for i in range(0, n - size + 1, max(1, size // 2))]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * window)) ** 2 for p in parts], axis=0)[1:]
    if not power.any():
        return []
    around = np.r_[-1.0, power, -1.0]
    at = np.flatnonzero((power > np.quantile(power, quantile)) & (power >= around[:-2]) & (power > around[2:])) + 1
    return sorted({p for p in np.rint(size / at).astype(int).tolist() if least <= p <= most})


def periods(v: np.ndarray, least: int = 4, most: int | None = None, limit: float = 0.3, method: str = "autocorrelation") -> list[tuple[int, float]]:
    """(period, strength) at local maxima of the autocorrelation, strongest first, without multiples of shorter ones.

    ``periodogram`` takes the peaks of the spectrum instead, ``auto`` both; the
    strength is the autocorrelation in any case.
    """
    if method not in ("autocorrelation", "periodogram", "auto"):
        raise ValueError(f"unknown method {method}")
    n = len(v)
    most = min(n // 3, 512) if most is None else most
    if n < 3 * least or most < least:
        return []
    d = detrend(v)
    acf = {k: autocorrelation(d, k) for k in range(max(1, least - 1), most + 2)}
    at = set(periodogram(d, least, most)) if method != "autocorrelation" else set()
    if method != "periodogram":
        at |= {k for k in range(least, most + 1) if acf[k] >= acf.get(k - 1, -2) and acf[k] > acf.get(k + 1, -2)}
    found = [(k, acf[k]) for k in sorted(at) if acf[k] >= limit]
    kept = [(p, s) for p, s in found if not any(q < p and p % q == 0 and t >= s - 0.05 for q, t in found)]
    return sorted(kept, key=lambda x: (-x[1], x[0]))


def robust_z(v: np.ndarray) -> np.ndarray:
    """(v - median) / (1.4826 MAD); without a MAD, 1.2533 times the mean absolute deviation; else 0."""
    ok = v[np.isfinite(v)]
    if not len(ok):
        return np.full(len(v), np.nan)
    m = np.median(ok)
    scale = 1.4826 * np.median(np.abs(ok - m)) or 1.2533 * np.mean(np.abs(ok - m))
    return (v - m) / scale if scale else np.where(np.isfinite(v), 0.0, np.nan)


def ols(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept; a constant x has slope 0."""
    dx = x - x.mean()
    bottom = (dx * dx).sum()
    slope = float((dx * (y - y.mean())).sum() / bottom) if bottom else 0.0
    return slope, float(y.mean() - slope * x.mean())


def theil_sen(x: np.ndarray, y: np.ndarray, most: int = 2000) -> tuple[float, float]:
    """Median of pairwise slopes and of residuals, on at most ``most`` points at equal strides."""
    if len(x) > most:
        at = np.arange(0, len(x), -(-len(x) // most))
        x, y = x[at], y[at]
    slopes = [((y[i + 1 :] - y[i])[d != 0] / d[d != 0]) for i in range(len(x) - 1) for d in (x[i + 1 :] - x[i],)]
    every = np.concatenate(slopes) if slopes else np.zeros(0)
    slope = float(np.median(every)) if len(every) else 0.0
    return slope, float(np.median(y - slope * x))


def _costs(y: np.ndarray, linear: bool):
    """Residual sum of squares of any segment, about its mean or its line, from prefix sums."""
    x = np.arange(len(y), dtype=float)
    sums = [np.r_[0, np.cumsum(a)] for a in (y, y * y, x, x * x, x * y)]

    def cost(i, j):
        n = j - i
        sy, syy, sx, sxx, sxy = (s[j] - s[i] for s in sums)
        total = syy - sy * sy / n
        if linear:
            dx = sxx - sx * sx / n
            total = total - np.where(dx > 0, (sxy - sx * sy / n) ** 2 / np.where(dx > 0, dx, 1), 0)
        return np.maximum(total, 0)

    return cost


def binary_segmentation(v: np.ndarray, cost: str = "linear", penalty: float = 1.0, min_segment: int = 5, most: int = 10) -> list[int]:
    """Greedy splits while the best gain exceeds 3 * penalty * parameters * variance * ln n."""
    y = interpolate(v)
    n, least = len(y), max(min_segment, 3 if cost == "linear" else 1)
    if np.isfinite(v).sum() < 2 * least:
        return []
    sigma = max(mad(np.diff(y)) * 1.4826 / np.sqrt(2), 1e-12)
    limit = penalty * 3 * (2 if cost == "linear" else 1) * sigma**2 * np.log(n)
    rss, ends = _costs(y, cost == "linear"), [0, n]
    while len(ends) - 2 < most:
        best = (limit, None)
        for i, j in zip(ends, ends[1:], strict=False):
            k = np.arange(i + least, j - least + 1)
            if len(k):
                gain = rss(i, j) - rss(i, k) - rss(k, j)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), int(k[at]))
        if best[1] is None:
            break
        ends = sorted([*ends, best[1]])
    return ends[1:-1]


def online_changepoints(v: np.ndarray, hazard: float = 1 / 250, min_segment: int = 5, most: int = 10) -> list[int]:
    """Bayesian online changepoints (Adams and MacKay, 2007) with a normal-gamma prior on the standardised series.

    The run length of largest probability at the end gives the last changepoint,
    that at the value before it the one before, and so on; O(n^2).
    """
    y = interpolate(v)
    n = len(y)
    if np.isfinite(v).sum() < 2 * min_segment:
        return []
    y = (y - y.mean()) / max(y.std(), 1e-12)
    alpha = 1 + np.arange(n + 1) / 2
    kappa = 1.0 + np.arange(n + 1)
    gammas = np.array([lgamma(a + 0.5) - lgamma(a) for a in alpha])
    mean, beta, log_r, best = np.zeros(1), np.full(1, 0.1), np.zeros(1), np.zeros(n, np.int64)
    for t, x in enumerate(y):
        m = t + 1
        scale = 2 * beta * (kappa[:m] + 1) / kappa[:m]
        density = gammas[:m] - 0.5 * np.log(np.pi * scale) - (alpha[:m] + 0.5) * np.log1p((x - mean) ** 2 / scale)
        joint = log_r + density
        top = joint.max()
        log_r = np.r_[top + np.log(np.exp(joint - top).sum()) + np.log(hazard), joint + np.log1p(-hazard)]
        log_r -= log_r.max() + np.log(np.exp(log_r - log_r.max()).sum())
        best[t] = int(np.argmax(log_r))
        beta = np.r_[0.1, beta + kappa[:m] * (x - mean) ** 2 / (2 * (kappa[:m] + 1))]
        mean = np.r_[0.0, (kappa[:m] * mean + x) / (kappa[:m] + 1)]
    found, end = [], n
    while end > 0:
        start = end - max(int(best[end - 1]), 1)
        if start >= min_segment and end - start >= min_segment:
            found.append(start)
        end = start
    return sorted(found)[:most]


def holt(y: np.ndarray) -> tuple[float, float, float, float, np.ndarray]:
    """alpha, beta, last level, last slope and fitted values of the best grid point."""
    grid, best = (0.05, 0.15, 0.3, 0.5, 0.7, 0.9), None  # fixed values: smoothing factors to try
    for a in grid:
        for b in grid:
            if b > a:
                continue
            level, slope, fitted = y[0], y[1] - y[0], [y[0]]
            for v in y[1:]:
                fitted.append(level + slope)
                new = a * v + (1 - a) * (level + slope)
                slope = b * (new - level) + (1 - b) * slope
                level = new
            sse = float(((y - np.array(fitted))[1:] ** 2).sum())
            if best is None or sse < best[0]:
                best = (sse, a, b, level, slope, np.array(fitted))
    return best[1:]


def holt_winters(y: np.ndarray, m: int) -> tuple[float, float, float, float, np.ndarray, np.ndarray]:
    """alpha, beta, level, slope, the last season and fitted values (additive)."""
    _, seasonal, _ = decompose(y, m)
    best = None
    # fixed values: smoothing factors to try
    for a in (0.1, 0.3, 0.5, 0.7):
        for b in (0.01, 0.05, 0.2):
            for g in (0.05, 0.2, 0.5):
                s = seasonal[:m].tolist()
                level, slope = y[:m].mean(), (y[m : 2 * m].mean() - y[:m].mean()) / m
                fitted = np.empty(len(y))
                for i, v in enumerate(y):
                    fitted[i] = level + slope + s[i % m]
                    new = a * (v - s[i % m]) + (1 - a) * (level + slope)
                    slope = b * (new - level) + (1 - b) * slope
                    level = new
                    s[i % m] = g * (v - level) + (1 - g) * s[i % m]
                sse = float(((y - fitted)[m:] ** 2).sum())
                if best is None or sse < best[0]:
                    best = (sse, a, b, level, slope, np.array(s), fitted)
    return best[1:]
