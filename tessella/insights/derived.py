"""Insights as tables to draw beside the data, marks of rows and series, and one line of text for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.interval import guess_interval, median_step


def _layer(df: DataFrame, name: str, **columns) -> DataFrame:
    return df.select(F.lit(name).alias("layer"), *(c if c is None else F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in columns.items()))


def anomaly_layers(found: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Band (x, lower, upper) of all rows and dots (x, y) of the flagged ones, by ``layer``."""
    keys = {k: k for k in by}
    band = _layer(found.filter("lower IS NOT NULL"), "band", **keys, x=x, lower="lower", upper="upper")
    dots = _layer(found.filter("is_anomaly"), "dots", **keys, x=x, y=y)
    return band.unionByName(dots, allowMissingColumns=True)


def highlight(df: DataFrame, found: DataFrame, keys: list[str], flag: str = "is_anomaly") -> DataFrame:
    """Adds ``highlight``: whether the row (or series) with these keys is flagged."""
    marked = found.filter(F.col(flag)).select(*keys).distinct().withColumn("__marked", F.lit(True))
    return df.join(marked, keys, "left").withColumn("highlight", F.coalesce("__marked", F.lit(False))).drop("__marked")


def future_x(df: DataFrame, x: str, forecast: DataFrame, by: list[str]) -> DataFrame:
    """Adds the x of each forecast step: the series' last x and ``step`` typical intervals (a calendar one for times, else the median step, else 1)."""
    time = dict(df.dtypes)[x].startswith(("timestamp", "date"))
    step = median_step(df.select((F.unix_millis(F.col(x).cast("timestamp")) if time else F.col(x)).cast("double").alias("x")).distinct(), "x")
    last = df.groupBy(*by).agg(F.max(x).alias("__last"))
    out = forecast.join(last, by)
    if not time:
        return out.withColumn(x, F.col("__last") + F.col("step") * F.lit(step or 1.0)).drop("__last")
    unit = guess_interval(step or 86_400_000.0)
    moved = F.col("__last").cast("timestamp")
    horizon = forecast.agg(F.max("step")).first()[0] or 0
    at = F.lit(None).cast("timestamp")
    for k in range(1, horizon + 1):
        at = F.when(F.col("step") == k, unit.offset(moved, k)).otherwise(at)
    return out.withColumn(x, at).drop("__last")


def forecast_layers(df: DataFrame, x: str, y: str, forecast: DataFrame, by: list[str]) -> DataFrame:
    """Start (the last row of each series), line (x, y) and band (x, lower, upper) of a forecast with its x."""
    keys = {k: k for k in by}
    last = df.groupBy(*by).agg(F.max_by(y, x).alias("__y"), F.max(x).alias("__x"))
    placed = future_x(df, x, forecast, by)
    parts = _layer(last, "start", **keys, x="__x", y="__y"), _layer(placed, "line", **keys, x=x, y="point"), _layer(placed, "band", **keys, x=x, lower="lower", upper="upper")
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def trend_layers(df: DataFrame, x: str, found: DataFrame, by: list[str]) -> DataFrame:
    """The two ends of each series' line, from its slope and intercept."""
    ends = df.groupBy(*by).agg(F.min(x).alias("__a"), F.max(x).alias("__b"))
    both = found.join(ends, by).select(*by, "slope", "intercept", F.explode(F.array("__a", "__b")).alias("__x"))
    return _layer(both, "line", **{k: k for k in by}, x="__x", y=F.col("intercept") + F.col("slope") * F.col("__x"))


def summaries(found: dict[str, DataFrame]) -> dict[str, str]:
    """One line of text for each insight, from counts alone."""
    flags = {"anomalies": "is_anomaly", "category": "is_outlier", "series": "is_outlier", "frequency": "kind"}
    out = {}
    for name, df in found.items():
        if name in flags:
            c = F.col(flags[name])
            hit, n = df.agg(F.count(F.when(c.isNotNull() if name == "frequency" else c, 1)), F.count("*")).first()
            out[name] = f"{hit} of {n} stand out"
        else:
            out[name] = f"{df.count()} rows"
    return out


def only(df: DataFrame, target: dict | None) -> DataFrame:
    """The rows that an insight is for: each key of ``target`` has its value, or one of its values."""
    for key, want in (target or {}).items():
        df = df.filter(F.col(key).isin(list(want)) if isinstance(want, (list, tuple, set)) else F.col(key).eqNullSafe(F.lit(want)))
    return df
