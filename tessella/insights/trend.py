"""Linear trends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finite
from .kernels import theil_sen


def trend(df: DataFrame, x: str, y: str, by: list[str], method: str = "ols") -> DataFrame:
    """(by, slope, intercept, r2, n) of series with two finite pairs or more."""
    a, b = finite(x), finite(y)
    pairs = df.select(*by, a.alias("__x"), b.alias("__y")).filter("__y IS NOT NULL")
    if method in ("ols", "linear", "auto"):
        both = F.col("__x").isNotNull()
        fx, fy = F.when(both, F.col("__x")), F.when(both, F.col("__y"))
        out = pairs.groupBy(*by).agg(F.regr_slope(fy, fx).alias("__s"), F.avg(fy).alias("__my"), F.avg(fx).alias("__mx"), F.sum(fy * fy).alias("__yy"), F.sum(fx * fy).alias("__xy"), F.sum(fx * fx).alias("__xx"), F.count(fx).alias("n"), F.var_pop("__y").alias("__v"), F.count("__y").alias("__n"))
        slope = F.coalesce("__s", F.lit(0.0))
        out = out.filter("n >= 2").withColumn("slope", slope).withColumn("intercept", F.col("__my") - F.col("slope") * F.col("__mx"))
        s, i, n = F.col("slope"), F.col("intercept"), F.col("n")
        rss = F.col("__yy") - 2 * s * F.col("__xy") - 2 * i * n * F.col("__my") + s * s * F.col("__xx") + 2 * s * i * n * F.col("__mx") + n * i * i
        return out.withColumn("r2", 1 - F.try_divide(rss, F.col("__v") * F.col("__n"))).select(*by, "slope", "intercept", "r2", "n")
    if method not in ("theil-sen", "robust"):
        raise ValueError(f"unknown method {method}")
    schema = pairs.select(*by).withColumn("slope", F.lit(0.0)).withColumn("intercept", F.lit(0.0)).withColumn("r2", F.lit(0.0)).withColumn("n", F.lit(0).cast("long")).schema
    for f in schema.fields:
        f.nullable = True

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["__x"]).sort_values("__x", kind="stable")
        xs, ys = rows["__x"].to_numpy(), rows["__y"].to_numpy()
        if len(xs) < 2:
            return pd.DataFrame([(*key, 0.0, 0.0, 0.0, 0)], columns=schema.names)  # dropped below
        slope, intercept = theil_sen(xs, ys)
        total = ((ys - ys.mean()) ** 2).sum()
        out = pd.DataFrame({"slope": [slope], "intercept": [intercept], "r2": [1 - ((ys - slope * xs - intercept) ** 2).sum() / total if total else np.nan], "n": [len(xs)]})
        for name, k in zip(by, key, strict=True):
            out[name] = k
        return out[schema.names]

    return pairs.groupBy(*by).applyInPandas(run, schema).filter("n > 0")
