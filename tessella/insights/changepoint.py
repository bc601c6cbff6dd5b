"""Changepoints and their segments, per series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import binary_segmentation, interpolate, online_changepoints


def changepoints(df: DataFrame, value: str, by: list[str], order: str, cost: str = "linear", penalty: float = 1.0, min_segment: int = 5, most: int = 10, method: str = "binseg") -> DataFrame:
    """(by, segment, start, stop, mean): half-open segments by position; every start but the first is a changepoint.

    ``method``: binseg (also auto), or normal-gamma (Bayesian, online), which takes no cost or penalty.
    """
    if method not in ("auto", "binseg", "normal-gamma"):
        raise ValueError(f"unknown method {method}")
    schema = df.select(*by).withColumn("segment", F.lit(0)).withColumn("start", F.lit(0)).withColumn("stop", F.lit(0)).withColumn("mean", F.lit(0.0)).schema
    for f in schema.fields:
        f.nullable = True

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values(order, kind="stable")[value].to_numpy(float)
        v = np.where(np.isfinite(v), v, np.nan)
        found = online_changepoints(v, min_segment=min_segment, most=most) if method == "normal-gamma" else binary_segmentation(v, cost, penalty, min_segment, most)
        ends = [0, *found, len(v)]
        full = interpolate(v)
        out = pd.DataFrame([(i, a, b, float(full[a:b].mean())) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))], columns=["segment", "start", "stop", "mean"]).astype({"segment": "int32", "start": "int32", "stop": "int32"})
        for name, k in zip(by, key, strict=True):
            out[name] = k
        return out[schema.names]

    return df.groupBy(*by).applyInPandas(run, schema)
