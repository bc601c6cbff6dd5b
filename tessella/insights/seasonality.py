"""Seasonal periods, per series, and autocorrelation as window expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finite
from .kernels import periods

# Names of periods for a unit of time.
NAMES = {("second", 60): "minutely", ("minute", 60): "hourly", ("hour", 24): "daily", ("hour", 168): "weekly", ("day", 7): "weekly", ("day", 30): "monthly", ("day", 365): "yearly", ("week", 52): "yearly", ("month", 3): "quarterly", ("month", 12): "yearly", ("quarter", 4): "yearly"}


def seasonality(df: DataFrame, value: str, by: list[str], order: str, least: int = 4, most: int | None = None, limit: float = 0.3, unit: str | None = None, method: str = "autocorrelation") -> DataFrame:
    """(by, period, strength, name), strongest first by ``place``; ``method``: autocorrelation, periodogram or auto (both)."""
    schema = df.select(*by).withColumn("place", F.lit(0)).withColumn("period", F.lit(0)).withColumn("strength", F.lit(0.0)).withColumn("name", F.lit("")).schema
    for f in schema.fields:
        f.nullable = True

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values(order, kind="stable")[value].to_numpy(float)
        found = periods(v, least, most, limit, method) if np.isfinite(v).any() else []
        out = pd.DataFrame([(i, p, s, NAMES.get((unit, p))) for i, (p, s) in enumerate(found)] or [(-1, 0, 0.0, None)], columns=["place", "period", "strength", "name"]).astype({"place": "int32", "period": "int32"})
        for name, k in zip(by, key, strict=True):
            out[name] = k
        return out[schema.names]

    return df.groupBy(*by).applyInPandas(run, schema).filter("place >= 0")


def autocorrelation(df: DataFrame, value: str, by: list[str], order: str, lags: int) -> DataFrame:
    """(by, lag, acf) for lags of 1 to ``lags``; a missing value counts as the mean."""
    v, w = finite(value), W.partitionBy(*by)
    centred = df.withColumn("__d", F.coalesce(v - F.avg(v).over(w), F.lit(0.0)))
    series = w.orderBy(order)
    for k in range(1, lags + 1):
        centred = centred.withColumn(f"__l{k}", F.col("__d") * F.lag("__d", k).over(series))
    total = F.sum(F.col("__d") * F.col("__d"))
    sums = centred.groupBy(*by).agg(*(F.try_divide(F.coalesce(F.sum(f"__l{k}"), F.lit(0.0)), total).alias(f"__a{k}") for k in range(1, lags + 1)))
    return sums.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"__a{k}").alias("acf")) for k in range(1, lags + 1)))).alias("x")).select(*by, "x.lag", "x.acf")
