"""The row before each row of a whole table in some order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a range of the order that one task holds, about.
ROWS = 200_000


def _number(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return (F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(c)).cast("double")


def with_previous(df: DataFrame, order: str, value: Column, name: str = "previous", rows: int = ROWS) -> DataFrame:
    """Adds the ``value`` of the row before in ``order`` (a number or a time; null rows are left out).

    Rows are dealt to equal ranges of ``order``; only the last value of each
    range, one row a range, is ordered in one task.
    """
    df = df.withColumn("__o", _number(df, order)).filter("__o IS NOT NULL").withColumn("__v", value)
    lo, hi, n = df.agg(F.min("__o"), F.max("__o"), F.count("*")).first()
    parts = max(1, n // rows)
    share = (F.col("__o") - F.lit(lo)) / F.lit(hi - lo if n and hi > lo else 1.0)
    df = df.withColumn("__part", F.least(F.lit(parts - 1), F.floor(share * parts)).cast("int"))
    inside = W.partitionBy("__part").orderBy("__o")
    ends = df.groupBy("__part").agg(F.max_by(F.struct("__v"), "__o").alias("__end"))
    ends = ends.select("__part", F.lag("__end").over(W.orderBy("__part")).alias("__end"))
    df = df.withColumn("__first", F.row_number().over(inside) == 1).withColumn("__before", F.lag("__v").over(inside))
    out = df.join(F.broadcast(ends), "__part")  # a row for each range
    return out.withColumn(name, F.when(F.col("__first"), F.col("__end.__v")).otherwise(F.col("__before"))).drop("__o", "__v", "__part", "__first", "__before", "__end")


def encode(df: DataFrame, key: str, order: str, domain: list | None = None, name: str = "code") -> DataFrame:
    """Adds dense codes of a key: by its place in ``domain`` (unknown: -1), or by first appearance (null: -1)."""
    if domain is not None:
        place = F.array_position(F.array(*(F.lit(v) for v in domain)), F.col(key)) if domain else F.lit(0)
        return df.withColumn(name, (F.coalesce(place, F.lit(0)) - 1).cast("int"))
    seen = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__at"))
    codes = seen.select("__key", (F.row_number().over(W.orderBy("__at", "__key")) - 1).cast("int").alias(name))  # a row for each kind
    return df.join(codes, F.col(key) == F.col("__key"), "left").drop("__key").fillna(-1, [name])
