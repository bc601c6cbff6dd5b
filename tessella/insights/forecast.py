"""Forecasts with intervals, per series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import EPSILON, holt, holt_winters, interpolate, periods, z_of


def project(v: np.ndarray, horizon: int = 10, method: str = "auto", level: float | None = 0.95, period: int | None = None) -> tuple[str, int | None, np.ndarray, np.ndarray, np.ndarray]:
    """Method used, period, point forecasts, standard errors and fitted values."""
    if horizon < 1 or np.isfinite(v).sum() < 2:
        raise ValueError("a forecast needs a horizon and two values")
    y, h = interpolate(v), np.arange(1, horizon + 1)
    n = len(y)
    valid = period is not None and period >= 2 and n >= 2 * period
    if not valid:
        period = next((p for p, _ in periods(y) if n >= 3 * p), None)
    if method == "auto":
        method = ("drift" if n >= 3 else "naive") if n < 10 else "holt-winters" if period and n >= 3 * period else "holt"
    method = {"hw": "holt-winters", "mstl": "holt-winters", "ets": "holt"}.get(method, method)
    if method == "holt-winters" and not period:
        method = "holt"
    if method == "holt" and n < 3:
        method = "naive"
    if method in ("naive", "drift"):
        slope = (y[-1] - y[0]) / (n - 1) if method == "drift" else 0.0
        point, fitted = y[-1] + slope * h, np.r_[y[0], y[:-1] + slope]
        growth, skip = (h * (1 + h / n) if method == "drift" else h.astype(float)), 1
    else:
        if method == "holt":
            a, b, base, slope, fitted = holt(y)
            point, skip = base + slope * h, 1
        else:
            a, b, base, slope, season, fitted = holt_winters(y, period)
            point, skip = base + slope * h + season[(n + h - 1) % period], period
        growth = 1 + np.r_[0, np.cumsum((a + b * h[:-1]) ** 2)]
    rest = (y - fitted)[skip:]
    sd = max(float(np.std(rest, ddof=1)) if len(rest) > 1 else 0.0, EPSILON)
    return method, period if method == "holt-winters" else None, point, sd * np.sqrt(growth), fitted


def forecast(df: DataFrame, value: str, by: list[str], order: str, horizon: int = 10, method: str = "auto", level: float | None = 0.95, period: int | None = None) -> DataFrame:
    """(by, step, point, lower, upper, method): ``horizon`` steps after each series with two finite values or more."""
    schema = df.select(*by).withColumn("step", F.lit(0)).withColumn("point", F.lit(0.0)).withColumn("lower", F.lit(0.0)).withColumn("upper", F.lit(0.0)).withColumn("method", F.lit("")).schema
    for f in schema.fields:
        f.nullable = True

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values(order, kind="stable")[value].to_numpy(float)
        if np.isfinite(v).sum() < 2:
            return pd.DataFrame([(*key, 0, np.nan, np.nan, np.nan, "")], columns=schema.names)  # dropped below
        used, _, point, error, _ = project(v, horizon, method, level, period)
        z = z_of(level) if level and 0 < level < 1 else np.nan
        out = pd.DataFrame({"step": np.arange(1, horizon + 1, dtype=np.int32), "point": point, "lower": point - z * error, "upper": point + z * error, "method": used})
        for name, k in zip(by, key, strict=True):
            out[name] = k
        return out[schema.names]

    return df.groupBy(*by).applyInPandas(run, schema).filter("step > 0")
