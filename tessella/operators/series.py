"""Window functions over ordered series: rolling reducers, maps, normalisation and imputation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finite, percentile_of

Keys = list[str]


def _ordered(by: Keys, order: str):
    return W.partitionBy(*by).orderBy(order)


def rolling(df: DataFrame, value: str, k: int = 7, reducer: str | Callable[[Column], Column] = "mean", anchor: str = "middle", strict: bool = False, by: Keys = (), order: str = "x", out: str | None = None) -> DataFrame:
    """A reducer over frames of ``k`` rows around (middle), from (start) or up to (end) each row.

    Frames are cut at the ends of a series; ``strict`` gives null unless a frame
    has ``k`` rows with finite values (a function: ``k`` rows). A function gets
    the array of the frame's finite values.
    """
    if k < 1:
        raise ValueError("k must be positive")
    back = {"start": 0, "middle": (k - 1) // 2, "end": k - 1, "leading": 0, "centered": (k - 1) // 2, "trailing": k - 1}[anchor]
    series = _ordered(list(by), order)
    w, v = series.rowsBetween(-back, k - 1 - back), finite(value)
    share = 0.5 if reducer == "median" else percentile_of(reducer) if isinstance(reducer, str) else None
    if callable(reducer):
        got = reducer(F.collect_list(v).over(w))
    elif share is not None:
        got = F.percentile(v, F.lit(share)).over(w)
    elif reducer in ("first", "last", "difference", "ratio"):
        first, last = F.first_value(v, True).over(w), F.last_value(v, True).over(w)
        got = {"first": first, "last": last, "difference": last - first, "ratio": F.try_divide(last, first)}[reducer]
    elif reducer in ("min-index", "max-index"):
        pos = F.row_number().over(series) - 1
        sign = 1 if reducer == "min-index" else -1
        df = df.withColumn("__pos", pos)
        got = F.min_by("__pos", F.when(v.isNotNull(), F.struct(sign * v, F.col("__pos")))).over(w)
    elif reducer == "distinct":
        got = F.size(F.collect_set(v).over(w))
    elif reducer == "proportion":
        raise ValueError("a window has no total for a proportion")
    else:
        plain = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "variance": F.var_samp, "deviation": F.stddev_samp, "mode": lambda c: F.mode(c, True)}
        got = plain[reducer](v).over(w)
    if strict:
        got = F.when((F.count(F.lit(1)) if callable(reducer) else F.count(v)).over(w) == k, got)
    return df.withColumn(out or value, got).drop("__pos")


def cumsum(df: DataFrame, value: str, by: Keys = (), order: str = "x", out: str | None = None) -> DataFrame:
    """Running total; a missing value adds nothing."""
    w = _ordered(list(by), order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out or value, F.sum(F.coalesce(finite(value), F.lit(0.0))).over(w))


def rank(df: DataFrame, value: str, by: Keys = (), out: str | None = None) -> DataFrame:
    """Rank from 0; ties share the lowest."""
    v = finite(value)
    w = W.partitionBy(*by, v.isNull()).orderBy(v)
    return df.withColumn(out or value, F.when(v.isNotNull(), (F.rank().over(w) - 1).cast("double")))


def quantile_rank(df: DataFrame, value: str, by: Keys = (), out: str | None = None) -> DataFrame:
    """Rank divided by the number of finite values less one."""
    v = finite(value)
    w = W.partitionBy(*by, v.isNull())
    n = F.greatest(F.count(v).over(w) - 1, F.lit(1))
    return df.withColumn(out or value, F.when(v.isNotNull(), (F.rank().over(w.orderBy(v)) - 1) / n))


def diff(df: DataFrame, value: str, by: Keys = (), order: str = "x", out: str | None = None) -> DataFrame:
    v = finite(value)
    return df.withColumn(out or value, v - F.lag(v).over(_ordered(list(by), order)))


def pct_change(df: DataFrame, value: str, by: Keys = (), order: str = "x", out: str | None = None) -> DataFrame:
    v = finite(value)
    before = F.lag(v).over(_ordered(list(by), order))
    return df.withColumn(out or value, F.try_divide(v - before, F.abs(before)))


def normalize(df: DataFrame, value: str, basis: str | Callable[[Column], Column] = "first", by: Keys = (), order: str = "x", out: str | None = None) -> DataFrame:
    """Values relative to a basis of their series (first, last, min, max, mean, median, sum, pNN, a function), or by extent or deviation."""
    v, w = finite(value), W.partitionBy(*by)
    whole = _ordered(list(by), order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    if basis == "extent":
        lo, span = F.min(v).over(w), F.max(v).over(w) - F.min(v).over(w)
        return df.withColumn(out or value, F.when(span == 0, F.lit(0.0)).otherwise(F.try_divide(v - lo, span)))
    if basis == "deviation":
        sd = F.stddev_samp(v).over(w)
        return df.withColumn(out or value, F.when(sd == 0, F.when(v.isNotNull(), F.lit(0.0))).otherwise(F.try_divide(v - F.avg(v).over(w), sd)))
    if callable(basis):
        base = basis(F.collect_list(v).over(whole))
    elif basis in ("first", "last"):
        base = (F.first_value if basis == "first" else F.last_value)(v, True).over(whole)
    else:
        share = 0.5 if basis == "median" else percentile_of(basis)
        base = F.percentile(v, F.lit(share)).over(w) if share is not None else {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum}[basis](v).over(w)
    return df.withColumn(out or value, F.try_divide(v, base))


def impute(df: DataFrame, value: str, method: str | float = "linear", by: Keys = (), order: str = "x", out: str | None = None) -> DataFrame:
    """Fill missing values: linear by position (ends take the nearest), previous, next, zero or a constant."""
    v, series = finite(value), _ordered(list(by), order)
    back, ahead = series.rowsBetween(W.unboundedPreceding, 0), series.rowsBetween(0, W.unboundedFollowing)
    if method in ("previous", "ffill"):
        got = F.last_value(v, True).over(back)
    elif method in ("next", "bfill"):
        got = F.first_value(v, True).over(ahead)
    elif method in ("linear", "interpolate"):
        df = df.withColumn("__pos", F.row_number().over(series))
        known = F.when(v.isNotNull(), F.struct(F.col("__pos").alias("pos"), v.alias("v")))
        a, b = F.last_value(known, True).over(back), F.first_value(known, True).over(ahead)
        df = df.withColumn("__a", a).withColumn("__b", b)
        pa, va, pb, vb = (F.col(c) for c in ("__a.pos", "__a.v", "__b.pos", "__b.v"))
        got = F.when(v.isNotNull(), v).when(pa.isNull(), vb).when(pb.isNull(), va).otherwise(va + (vb - va) * (F.col("__pos") - pa) / (pb - pa))
    else:
        got = F.coalesce(v, F.lit(0.0 if method == "zero" else float(method)))
    return df.withColumn(out or value, got).drop("__pos", "__a", "__b")


def map_series(df: DataFrame, value: str, function: Callable[[pd.Series], pd.Series], by: Keys, order: str = "x", out: str | None = None) -> DataFrame:
    """A length-preserving function of each whole ordered series (Arrow batches, one series at a time)."""
    name = out or value
    schema = df.select(*[F.col(c) for c in df.columns if c != name], F.lit(None).cast("double").alias(name)).schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        rows[name] = pd.Series(function(rows[value].astype(float)), index=rows.index).to_numpy(float)
        return rows[schema.names]

    return df.groupBy(*by).applyInPandas(run, schema)
