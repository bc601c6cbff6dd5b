"""Outlying categories, rows within categories, and series: aggregates and joins on small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import Reducer, finite, reduce


def _robust(df: DataFrame, v: str, by: list[str]) -> tuple[DataFrame, Column]:
    """Adds what a robust z needs over partitions; gives the z. Without partitions the figures are aggregates, one row that is broadcast."""
    median, distance = F.percentile(v, F.lit(0.5)), F.abs(F.col(v) - F.col("__m"))
    if by:
        w = W.partitionBy(*by)
        df = df.withColumn("__m", median.over(w)).withColumn("__d", distance)
        df = df.withColumn("__mad", F.percentile("__d", F.lit(0.5)).over(w) * 1.4826).withColumn("__aad", F.avg("__d").over(w) * 1.2533)
    else:
        df = df.crossJoin(F.broadcast(df.agg(median.alias("__m"), F.count("*").alias("__all")))).withColumn("__d", distance)
        df = df.crossJoin(F.broadcast(df.agg((F.percentile("__d", F.lit(0.5)) * 1.4826).alias("__mad"), (F.avg("__d") * 1.2533).alias("__aad"))))
    scale = F.when(F.col("__mad") > 0, F.col("__mad")).otherwise(F.col("__aad"))
    z = F.when(scale > 0, (F.col(v) - F.col("__m")) / scale).otherwise(F.when(F.col(v).isNotNull(), F.lit(0.0)))
    return df, z


def frequency_outliers(df: DataFrame, key: str, count: Column | None = None, t: float = 2.5) -> DataFrame:
    """(key, count, score, kind): categories that are rare or dominant by the robust z of ln(count + 1)."""
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg((F.count("*") if count is None else F.sum(count)).cast("double").alias("count"))
    out = out.withColumn("__l", F.log1p(F.greatest("count", F.lit(0.0))))
    out, z = _robust(out, "__l", [])
    enough = F.col("__all") >= 3
    out = out.withColumn("score", F.when(enough, z).otherwise(F.lit(0.0)))
    return out.withColumn("kind", F.when(F.col("score") < -t, "rare").when(F.col("score") > t, "dominant")).select(key, "count", "score", "kind")


def category_outliers(df: DataFrame, key: str, value: str, reducer: Reducer = "median", t: float = 3.0, order: Column | None = None) -> DataFrame:
    """(key, value, score, is_outlier): categories whose aggregate is far from the others."""
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(reduce(reducer, F.col(value), order).cast("double").alias("value"))
    out, z = _robust(out, "value", [])
    return out.withColumn("score", z).withColumn("is_outlier", F.coalesce(F.abs("score") > t, F.lit(False))).select(key, "value", "score", "is_outlier")


def within_category(df: DataFrame, value: str, by: list[str], t: float = 3.0) -> DataFrame:
    """Adds score and is_outlier to each row, within its group; groups with fewer than four finite values have none."""
    out = df.withColumn("__v", finite(value))
    enough = F.count("__v").over(W.partitionBy(*by)) >= 4
    out, z = _robust(out, "__v", by)
    out = out.withColumn("score", F.when(enough, F.abs(z))).withColumn("is_outlier", F.coalesce(F.col("score") > t, F.lit(False)))
    return out.drop("__v", "__m", "__d", "__mad", "__aad")


def series_outliers(df: DataFrame, x: str, z: str, value: str, sensitivity: float = 0.5, method: str = "mad") -> DataFrame:
    """(z, mean_score, share, is_outlier): series far from the median of all series at a tenth of their x or more.

    ``dbscan``: at each x the values in order fall into clusters where a gap
    exceeds t times the scale; outside of a cluster of over half of them the
    score is 1, inside it 0, and without such a cluster 0 for all.
    """
    if method not in ("mad", "dbscan"):
        raise ValueError(f"unknown method {method}")
    t = 6 - 4 * min(0.99, max(0.01, sensitivity))
    out = df.select(x, z, finite(value).alias("__v")).filter("__v IS NOT NULL")
    w = W.partitionBy(x)
    out = out.withColumn("__m", F.percentile("__v", F.lit(0.5)).over(w)).withColumn("__d", F.abs(F.col("__v") - F.col("__m")))
    out = out.withColumn("__s", F.percentile("__d", F.lit(0.5)).over(w)).withColumn("__a", F.avg("__d").over(w) * 0.5).withColumn("__n", F.count("__v").over(w))
    scale = F.when(F.col("__s") > 0, F.col("__s")).otherwise(F.col("__a"))
    score = F.when((F.col("__n") >= 3) & (scale > 0), F.least(F.lit(1.0), F.col("__d") / (scale * t))).otherwise(F.lit(0.0))
    if method == "dbscan":
        gap = F.col("__v") - F.lag("__v").over(w.orderBy("__v", z))
        out = out.withColumn("__cut", F.coalesce((gap > scale * t).cast("int"), F.lit(0)))
        out = out.withColumn("__c", F.sum("__cut").over(w.orderBy("__v", z).rowsBetween(W.unboundedPreceding, 0)))
        out = out.withColumn("__size", F.count("__v").over(W.partitionBy(x, "__c")))
        main = F.max("__size").over(w) * 2 > F.col("__n")
        score = F.when((F.col("__n") >= 3) & (scale > 0) & main & (F.col("__size") * 2 <= F.col("__n")), F.lit(1.0)).otherwise(F.lit(0.0))
    got = out.withColumn("__score", score).groupBy(z).agg(F.avg("__score").alias("mean_score"), F.avg((F.col("__score") >= 1).cast("double")).alias("share"))
    enough = F.count(F.lit(1)).over(W.partitionBy()) >= 3
    return got.withColumn("is_outlier", enough & (F.col("share") >= 0.1))
