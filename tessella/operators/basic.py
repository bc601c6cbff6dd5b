"""Filter, sort, reverse, shuffle and select. Row order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finite, reduce, truthy


def filter_rows(df: DataFrame, test: Column | str) -> DataFrame:
    """Rows whose test is truthy."""
    if isinstance(test, str) and test in df.columns:
        return df.filter(truthy(test, dict(df.dtypes)[test]))
    return df.filter(test)


def sort_rows(df: DataFrame, by: str, order: str) -> DataFrame:
    """Stable sort; ``-field`` descends. Missing values come last, and first when descending."""
    if by.startswith("-"):
        return df.orderBy(F.col(by[1:]).desc_nulls_first(), order)
    return df.orderBy(F.col(by).asc_nulls_last(), order)


def reverse_rows(df: DataFrame, order: str) -> DataFrame:
    return df.orderBy(F.col(order).desc())


def shuffle_rows(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A reproducible shuffle by a hash of the key, which needs no single task (not the bits of a sequential generator)."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def _pick(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("__pick", F.row_number().over(w)).filter("__pick = 1").drop("__pick")


def select_first(df: DataFrame, by: list[str], order: str) -> DataFrame:
    return _pick(df, by, F.col(order).asc())


def select_last(df: DataFrame, by: list[str], order: str) -> DataFrame:
    return _pick(df, by, F.col(order).desc())


def select_extreme(df: DataFrame, value: str, by: list[str], order: str, largest: bool = False) -> DataFrame:
    """The first row with the smallest (largest) finite value of each series; series without one are dropped."""
    v = finite(value)
    return _pick(df.filter(v.isNotNull()), by, v.desc() if largest else v.asc(), F.col(order).asc())


def top_categories(df: DataFrame, key: str, value: str, reducer: str = "max", descending: bool = True, limit: int | None = None) -> DataFrame:
    """Categories ordered by an aggregate; a negative limit takes the tail."""
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(reduce(reducer, F.col(value)).alias("value"))
    by = [F.col("value").desc_nulls_last() if descending else F.col("value").asc_nulls_last(), F.col(key)]
    if limit is None:
        return out.orderBy(*by)
    if limit >= 0:
        return out.orderBy(*by).limit(limit)
    tail = [F.col("value").asc_nulls_first() if descending else F.col("value").desc_nulls_first(), F.col(key).desc()]
    return out.orderBy(*tail).limit(-limit).orderBy(*by)
