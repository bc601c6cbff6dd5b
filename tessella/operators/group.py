"""Grouping and binning: one hash aggregate, partial on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import Reducer, finite, reduce
from .bins import Bins, assign

Outputs = dict[str, tuple[Reducer, str | None]]


def _present(df: DataFrame, keys: list[str]) -> DataFrame:
    """Without rows whose key is missing."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
        if dict(df.dtypes)[k] in ("double", "float"):
            df = df.filter(~F.isnan(k))
    return df


def group_by(df: DataFrame, keys: list[str], outputs: Outputs, order: str | None = None) -> DataFrame:
    """Groups by keys; ``outputs`` maps a name to (reducer, column or null)."""
    at = F.col(order) if order else None
    aggregates = [reduce(r, None if c is None else F.col(c), at).alias(name) for name, (r, c) in outputs.items()]
    return _present(df, keys).groupBy(*keys).agg(*aggregates)


def proportion(df: DataFrame, keys: list[str], value: str | None = None, facet: list[str] | None = None) -> DataFrame:
    """Each group's share of the total of all rows (of its facet), including rows whose key is missing."""
    v = F.lit(1.0) if value is None else F.coalesce(finite(value), F.lit(0.0))
    sums = df.groupBy(*keys).agg(F.sum(v).alias("__sum"))
    total = F.sum("__sum").over(W.partitionBy(*(facet or [])))
    return _present(sums.withColumn("proportion", F.try_divide(F.col("__sum"), total)).drop("__sum"), keys)


def bin_by(df: DataFrame, value: str, bins: Bins, outputs: Outputs, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Groups by bin (and keys): x1, x2, x (the middle) and outputs."""
    binned = df.withColumn("__bin", assign(value, bins))
    out = group_by(binned, [*(keys or []), "__bin"], outputs, order)
    edges = F.array(*map(F.lit, bins.edges))
    x1, x2 = F.element_at(edges, F.col("__bin") + 1), F.element_at(edges, F.col("__bin") + 2)
    return out.select(*(keys or []), x1.alias("x1"), x2.alias("x2"), ((x1 + x2) / 2).alias("x"), *outputs)


def cumulative_bins(df: DataFrame, keys: list[str], x: str, value: str, descending: bool = False) -> DataFrame:
    """Running total of an additive output over the bins of each series."""
    w = W.partitionBy(*keys).orderBy(F.col(x).desc() if descending else F.col(x)).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(value, F.sum(value).over(w))


def cumulative_reduce(df: DataFrame, keys: list[str], value: str, by: str, bins: Bins, reducer: str, descending: bool = False) -> DataFrame:
    """(keys, x1, y): a median, pNN or distinct of all values up to each bin of ``by`` that has rows (from it, if descending).

    Equal values of a bin are counted first; each count then goes to the bins
    after it, so the rows grow by the number of bins at most, and no task holds
    the rows of a series.
    """
    if reducer != "distinct" and reducer != "median" and not (len(reducer) == 3 and reducer[0] == "p" and reducer[1:].isdigit()):
        raise ValueError(f"{reducer} needs no values of earlier bins: use cumulative_bins")
    binned = _present(df.withColumn("__bin", assign(by, bins)).withColumn("__v", finite(value)), [*keys, "__bin"])
    counts = binned.groupBy(*keys, "__bin", "__v").agg(F.count("*").alias("__n"))
    last = len(bins.edges) - 2
    reach = F.sequence(F.lit(0), F.col("__bin")) if descending else F.sequence(F.col("__bin"), F.lit(max(last, 0)))
    spread = counts.select(*keys, F.explode(reach).alias("__to"), "__v", "__n", (F.col("__bin") == F.col("__to")).alias("__own"))
    p = 0.5 if reducer == "median" else 0 if reducer == "distinct" else int(reducer[1:]) / 100
    y = F.count_distinct("__v").cast("double") if reducer == "distinct" else F.percentile("__v", F.lit(p), F.col("__n"))
    out = spread.groupBy(*keys, "__to").agg(y.alias("y"), F.max("__own").alias("__own")).filter("__own")
    return out.select(*keys, F.element_at(F.array(*map(F.lit, bins.edges)), F.col("__to") + 1).alias("x1"), "y")


def complete_grid(df: DataFrame, keys: list[str], fill: dict[str, float]) -> DataFrame:
    """All combinations of the keys' values; outputs of empty groups are filled (counts and sums with 0)."""
    grid: DataFrame | None = None
    for k in keys:  # domains of categories and bins, not of rows
        domain = df.select(k).distinct()
        grid = domain if grid is None else grid.crossJoin(domain)
    return grid.join(df, keys, "left").fillna(fill)


def keep_empty(binned: DataFrame, bins: Bins, keys: list[str], fill: dict[str, float]) -> DataFrame:
    """The output of ``bin_by`` with all bins of all combinations of the keys; outputs of empty ones are filled, or null."""
    at = F.transform(F.sequence(F.lit(0), F.lit(max(len(bins.edges) - 2, 0))), lambda i: i)
    edges = F.array(*map(F.lit, bins.edges))
    grid = binned.select(F.explode(at).alias("__i")).distinct()
    for k in keys:  # domains of categories, not of rows
        grid = grid.crossJoin(binned.select(k).distinct())
    x1, x2 = F.element_at(edges, F.col("__i") + 1), F.element_at(edges, F.col("__i") + 2)
    grid = grid.select(*keys, x1.alias("x1"), x2.alias("x2"), ((x1 + x2) / 2).alias("x"))
    return grid.join(binned.drop("x2", "x"), [*keys, "x1"], "left").fillna(fill)


def group_rows(df: DataFrame, keys: list[str], order: str, most: int = 100_000) -> DataFrame:
    """(keys, data): the rows of each group in order. For small groups: one of more than ``most`` rows is an error."""
    rows = _present(df, keys).groupBy(*keys).agg(F.count("*").alias("__n"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("__at"), F.struct(*df.columns).alias("row")))).alias("data"))
    guarded = F.when(F.col("__n") > most, F.raise_error(F.lit(f"a group has more than {most} rows"))).otherwise(F.col("data.row"))
    return rows.select(*keys, guarded.alias("data"))


def pearson(x: str, y: str) -> Column:
    """Correlation of the rows where both are finite, as an aggregate; NaN without variance."""
    a, b = finite(x), finite(y)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(a) > 0, F.coalesce(r, F.lit(float("nan"))))
