"""Stacking by window sums: positive values rise from zero, negative ones fall from it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finite


def _stack_order(order: str | list | Column | None, v: Column, z: str, facet: list[str], row: str, x: str) -> Column:
    w = W.partitionBy(*facet, z)
    if order is None:
        return F.lit(0)
    if isinstance(order, list):
        at = F.array_position(F.array(*map(F.lit, order)), F.col(z))
        return F.when(at > 0, at).otherwise(len(order) + 1)
    if not isinstance(order, str):
        return order
    if order in ("value", "y"):
        return v
    if order == "x":
        return F.col(x)
    if order == "sum":
        return F.sum(v).over(w)
    if order == "appearance":  # where the series peaks
        return F.max_by(row, F.struct(v, -F.col(row))).over(w)
    return F.col(order)


def _inside_out(df: DataFrame, v: Column, z: str, facet: list[str], row: str) -> DataFrame:
    """Adds ``__key``: series by the place of their peak, each put on the lighter side, below on ties; early ones end up in the middle.

    Ranks come from one row per series, in one task a facet, and are joined back.
    """
    names = [f"__k{i}" for i in range(len(facet) + 1)]
    keys = [F.col(c).alias(n) for c, n in zip([*facet, z], names, strict=True)]
    peak = F.max_by(F.when(v.isNotNull(), F.col(row)), F.when(v.isNotNull(), F.struct(v, -F.col(row))))
    series = df.groupBy(*keys).agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("__sum"), F.coalesce(peak.cast("double"), F.lit(0.0)).alias("__at"), F.min(row).cast("double").alias("__seen"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__at", "__seen"], kind="stable").reset_index(drop=True)
        sides, weight = ([], []), [0.0, 0.0]
        for i, s in enumerate(rows["__sum"]):
            side = int(weight[1] < weight[0])
            weight[side] += s
            sides[side].append(i)
        rows = rows.iloc[[*reversed(sides[0]), *sides[1]]].copy()
        rows["__key"] = range(len(rows))
        return rows[[*names, "__key"]]

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema.fields if f.name in names), "`__key` long"])
    grouped = series.groupBy(*names[:-1]) if facet else series.withColumn("__all", F.lit(1)).groupBy("__all")
    ranks = grouped.applyInPandas(run, schema)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip([*facet, z], names, strict=True)]
    return df.join(ranks, same).drop(*names)


def stack(df: DataFrame, x: str, y: str | None, z: str, row: str, facet: list[str] | None = None, order=None, reverse: bool = False, offset: str | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds y1, y2 and y (the middle) of each row's part of its stack.

    A missing value has no part. ``order``: value, x, sum, appearance, inside-out, a list of series, a column.
    ``offset``: normalize, center, wiggle, or a function that gets the rows with y1 and y2 and gives them moved.
    """
    facet = facet or []
    v = F.lit(1.0) if y is None else finite(y)
    df = df.withColumn("__v", v)
    v = F.col("__v")
    if isinstance(order, str) and order == "inside-out":
        df = _inside_out(df, v, z, facet, row)
    else:
        df = df.withColumn("__key", _stack_order(order, v, z, facet, row, x))
    by = [F.col("__key").desc(), F.col(row).desc()] if reverse else [F.col("__key").asc(), F.col(row).asc()]
    w = W.partitionBy(*facet, x, v < 0).orderBy(*by)
    before = F.coalesce(F.sum(v).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    df = df.withColumn("y1", F.when(v.isNotNull(), before)).withColumn("y2", F.col("y1") + v)
    whole = W.partitionBy(*facet, x)
    if offset in ("normalize", "center"):
        lo = F.coalesce(F.min(F.least("y1", "y2", F.lit(0.0))).over(whole), F.lit(0.0))
        hi = F.coalesce(F.max(F.greatest("y1", "y2", F.lit(0.0))).over(whole), F.lit(0.0))
        df = df.withColumn("__lo", lo).withColumn("__hi", hi)
        for c in ("y1", "y2"):
            if offset == "normalize":
                span = F.col("__hi") - F.col("__lo")
                new = F.when(span == 0, F.when(F.col(c).isNotNull(), F.lit(0.0))).otherwise(F.try_divide(F.col(c) - F.col("__lo"), span))
            else:
                new = F.col(c) - (F.col("__lo") + F.col("__hi")) / 2
            df = df.withColumn(c, new)
        df = df.drop("__lo", "__hi")
    elif offset == "wiggle":
        df = _wiggle(df, x, z, row, facet, by)
    elif callable(offset):
        df = offset(df)
    elif offset is not None:
        raise ValueError(f"unknown offset {offset}")
    return df.withColumn("y", (F.col("y1") + F.col("y2")) / 2).drop("__v", "__key")


def _wiggle(df: DataFrame, x: str, z: str, row: str, facet: list[str], by: list[Column]) -> DataFrame:
    """Shift each stack so that weighted slopes cancel: a running sum over stacks of -sum((h - before) * (below + h / 2)) / sum(h)."""
    h = F.coalesce(F.col("__v"), F.lit(0.0))
    # stacks are numbered on a table of one row each
    keys = [*facet, x]
    firsts = df.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min(row).alias("__first"))
    within = [f"__k{i}" for i in range(len(facet))]
    firsts = firsts.withColumn("__n", F.dense_rank().over((W.partitionBy(*within) if facet else W.partitionBy(F.lit(0))).orderBy("__first")))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    df = df.join(firsts, same).drop(*(f"__k{i}" for i in range(len(keys))))
    series = W.partitionBy(*facet, z).orderBy("__n")
    before = F.when(F.lag("__n").over(series) == F.col("__n") - 1, F.lag(h).over(series)).otherwise(h)
    df = df.withColumn("__before", before)
    inside = W.partitionBy(*facet, x).orderBy(*by)
    change = h - F.col("__before")
    below = F.coalesce(F.sum(change).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    df = df.withColumn("__move", (below + change / 2) * h)
    stacks = df.groupBy(*facet, "__n").agg(F.sum("__move").alias("m"), F.sum(h).alias("s"))
    run = (W.partitionBy(*facet) if facet else W.partitionBy(F.lit(0))).orderBy("__n").rowsBetween(W.unboundedPreceding, 0)
    shift = F.sum(F.when((F.col("__n") > 1) & (F.col("s") > 0), -F.col("m") / F.col("s")).otherwise(F.lit(0.0))).over(run)
    df = df.join(stacks.select(*facet, "__n", shift.alias("__shift")), [*facet, "__n"])
    return df.withColumn("y1", F.col("y1") + F.col("__shift")).withColumn("y2", F.col("y2") + F.col("__shift")).drop("__first", "__n", "__before", "__move", "__shift")
