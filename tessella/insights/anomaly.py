"""Anomalies: scores, flags and bands of each row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finite
from .kernels import EPSILON, decompose, interpolate, local_median, mad, periods, threshold


def _extended(df: DataFrame, *columns: str):
    return df.select("*", *(F.lit(None).cast("boolean" if c.startswith("is_") else "double").alias(c) for c in columns)).schema


def default_window(n: int, period: int | None) -> int:
    k = max(7, 2 * period if period and period >= 4 else n // 10)
    k = min(k, 201, n)
    return k if k % 2 else max(1, k - 1)


def _mad(v: np.ndarray, k: int | None, period: int | None) -> tuple[np.ndarray, np.ndarray]:
    centre, spread = local_median(v, k or default_window(len(v), period))
    scale = np.where(spread > 0, spread, max(mad(v), EPSILON)) * 1.4826
    return centre, scale


def anomalies(df: DataFrame, value: str, by: list[str], order: str, method: str = "mad", sensitivity: float | None = None, k: int | None = None, period: int | None = None, smoothing: float = 0.3) -> DataFrame:
    """Adds score, is_anomaly, lower and upper. zscore and iqr are window expressions; mad, seasonal and ewma run per series.

    Series with fewer than three finite values get no score.
    """
    v, w = finite(value), W.partitionBy(*by)
    enough = F.count(v).over(w) >= 3
    if method == "zscore":
        t = threshold(3.0, sensitivity)
        mean, sd = F.avg(v).over(w), F.stddev_samp(v).over(w)
        df = df.withColumn("__m", mean).withColumn("__s", F.when(sd > 0, sd).otherwise(F.lit(float(EPSILON)))).withColumn("__ok", enough)
        score = F.abs(v - F.col("__m")) / F.col("__s")
        lower, upper = F.col("__m") - t * F.col("__s"), F.col("__m") + t * F.col("__s")
    elif method == "iqr":
        t = 0.0
        reach = 1.5 if sensitivity is None else 2.25 - 1.5 * sensitivity
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.75))).over(w)
        df = df.withColumn("__q", q).withColumn("__ok", enough)
        a, b = F.col("__q")[0], F.col("__q")[1]
        lower, upper = a - reach * (b - a), b + reach * (b - a)
        beyond = F.greatest(a - v, v - b, F.lit(0.0))
        score = F.when(b > a, beyond / (b - a)).otherwise(F.when(beyond > 0, F.lit(float("inf"))).when(v.isNotNull(), F.lit(0.0)))
        flag = (v < lower) | (v > upper)
        out = df.withColumn("score", F.when(F.col("__ok"), score)).withColumn("is_anomaly", F.col("__ok") & F.coalesce(flag, F.lit(False)))
        return out.withColumn("lower", F.when(F.col("__ok"), lower)).withColumn("upper", F.when(F.col("__ok"), upper)).drop("__q", "__ok")
    elif method in ("mad", "auto", "seasonal", "stl", "ewma"):
        return _sequential(df, value, by, order, method, sensitivity, k, period, smoothing)
    else:
        raise ValueError(f"unknown method {method}")
    flag = F.coalesce(score > t, F.lit(False))
    out = df.withColumn("score", F.when(F.col("__ok"), score)).withColumn("is_anomaly", F.col("__ok") & flag)
    return out.withColumn("lower", F.when(F.col("__ok"), lower)).withColumn("upper", F.when(F.col("__ok"), upper)).drop("__m", "__s", "__ok")


def _sequential(df, value, by, order, method, sensitivity, k, period, smoothing):
    schema = _extended(df, "score", "is_anomaly", "lower", "upper")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        v = rows[value].to_numpy(float)
        v = np.where(np.isfinite(v), v, np.nan)
        score = lower = upper = np.full(len(v), np.nan)
        t = threshold(3.0 if method == "ewma" else 3.5, sensitivity)
        if np.isfinite(v).sum() >= 3:
            if method == "ewma":
                rate = min(1.0, max(0.01, smoothing))
                sigma = max(mad(v) * 1.4826, EPSILON)
                level, n = np.nanmedian(v), 0
                centre, width = np.empty(len(v)), np.empty(len(v))
                for i, x in enumerate(v):
                    n += 1
                    centre[i] = level
                    width[i] = sigma * np.sqrt(1 + rate / (2 - rate) * (1 - (1 - rate) ** (2 * n)))
                    if np.isfinite(x) and abs(x - level) <= t * width[i]:
                        level = rate * x + (1 - rate) * level
            else:
                p = period
                if method in ("seasonal", "stl") and p is None:
                    found = periods(interpolate(v))
                    p = found[0][0] if found else None
                if method in ("seasonal", "stl") and p and len(v) >= 2 * p:
                    trend, seasonal, rest = decompose(v, p)
                    middle, width = _mad(rest, k, p)
                    centre = trend + seasonal + middle
                else:
                    centre, width = _mad(v, k, p)
            score = np.abs(v - centre) / width
            lower, upper = centre - t * width, centre + t * width
        rows["score"], rows["is_anomaly"], rows["lower"], rows["upper"] = score, np.nan_to_num(score, nan=-1) > t, lower, upper
        return rows[schema.names]

    return df.groupBy(*by).applyInPandas(run, schema)


def decompose_series(df: DataFrame, value: str, by: list[str], order: str, period: int) -> DataFrame:
    """Adds trend, seasonal and remainder."""
    schema = _extended(df, "trend", "seasonal", "remainder")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        rows["trend"], rows["seasonal"], rows["remainder"] = decompose(rows[value].to_numpy(float), period)
        return rows[schema.names]

    return df.groupBy(*by).applyInPandas(run, schema)
