"""Aligning series: interpolation at the other series' x without a cross join, and crossing points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finite


def interpolate_at(metric: DataFrame, other: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """``metric`` with ``other_y``: the other series' value at its x, linear between neighbours, null outside of its range."""
    by = by or []
    number = lambda df: F.unix_micros(x).cast("double") if dict(df.dtypes)[x] == "timestamp" else F.col(x).cast("double")
    a = metric.withColumn("__x", number(metric)).withColumn("__o", F.lit(None).cast("double")).withColumn("__m", F.lit(True))
    b = other.select(*by, number(other).alias("__x"), finite(y).alias("__o")).filter("__o IS NOT NULL").withColumn("__m", F.lit(False))
    both = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy("__x")
    known = F.when(~F.col("__m"), F.struct(F.col("__x").alias("x"), F.col("__o").alias("o")))
    both = both.withColumn("__a", F.last_value(known, True).over(w.rangeBetween(W.unboundedPreceding, 0))).withColumn("__b", F.first_value(known, True).over(w.rangeBetween(0, W.unboundedFollowing)))
    ax, ao, bx, bo = (F.col(c) for c in ("__a.x", "__a.o", "__b.x", "__b.o"))
    value = F.when(ax == bx, ao).otherwise(ao + (bo - ao) * (F.col("__x") - ax) / (bx - ax))
    return both.filter("__m").withColumn("other_y", F.when(ax.isNotNull() & bx.isNotNull(), value)).drop("__x", "__o", "__m", "__a", "__b")


def difference(metric: DataFrame, other: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Bands between a metric and a comparison: gap, and lower and upper edge where the metric is above (or below)."""
    out = interpolate_at(metric, other, x, y, by)
    return out.withColumn("gap", finite(y) - F.col("other_y")).withColumn("lo", F.least(finite(y), "other_y")).withColumn("hi", F.greatest(finite(y), "other_y"))


def crossings(df: DataFrame, x: str, gap: str, by: list[str] | None = None) -> DataFrame:
    """Points where consecutive gaps change sign (x as a number)."""
    w = W.partitionBy(*(by or [])).orderBy(x)
    v = F.unix_micros(x).cast("double") if dict(df.dtypes)[x] == "timestamp" else F.col(x).cast("double")
    out = df.select(*(by or []), x, v.alias("__x"), F.col(gap).alias("__g")).withColumn("__px", F.lag("__x").over(w)).withColumn("__pg", F.lag("__g").over(w)).filter("__g * __pg < 0")
    return out.select(*(by or []), (F.col("__px") + (F.col("__x") - F.col("__px")) * F.col("__pg") / (F.col("__pg") - F.col("__g"))).alias("x"))


def align_series(df: DataFrame, x: str, z: str) -> DataFrame:
    """All series on the union of their x: rows that a series lacks have null values."""
    grid = df.select(x).distinct().crossJoin(df.select(z).distinct())  # x values times series, as asked
    return grid.join(df, [x, z], "left")
