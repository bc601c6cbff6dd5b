"""Column functions: finite values, coercion, reducers over groups and frames."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column | str) -> Column:
    """The value as a double; null for NaN and infinities."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def to_number(value: Column | str, kind: str) -> Column:
    """Numeric form of a column of Spark type ``kind``: strings that are numbers, timestamps as epoch milliseconds, no booleans."""
    v = F.col(value) if isinstance(value, str) else value
    if kind == "boolean":
        return F.lit(None).cast("double")
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_millis(v.cast("timestamp")).cast("double")
    return finite(v.try_cast("double"))


def truthy(value: Column | str, kind: str) -> Column:
    """Whether a filter keeps a value: null, false, zero, NaN and the empty string are dropped."""
    v = F.col(value) if isinstance(value, str) else value
    if kind == "boolean":
        return F.coalesce(v, F.lit(False))
    if kind == "string":
        return F.coalesce(v != "", F.lit(False))
    if kind.startswith(("timestamp", "date")):
        return v.isNotNull()
    return F.coalesce((v != 0) & ~F.isnan(v.cast("double")), F.lit(False))


def percentile_of(name: str) -> float | None:
    """The share of a reducer called p00 to p99."""
    m = re.fullmatch(r"p(\d\d)", name)
    return int(m[1]) / 100 if m else None


Reducer = str | Callable[[Column], Column]


def reduce(name: Reducer, value: Column | None = None, order: Column | None = None) -> Column:
    """Aggregate of a group by a named reducer (or a function from a column to an aggregate).

    Without a value, ``count`` and ``sum`` count rows. ``first``, ``last``,
    ``min-index`` and ``max-index`` need ``order``; ties go to the first row.
    """
    if callable(name):
        return name(value)
    if value is None:
        if name in ("count", "sum"):
            return F.count(F.lit(1)).cast("double" if name == "sum" else "long")
        raise ValueError(f"{name} needs a value")
    v = finite(value)
    share = percentile_of(name)
    if share is not None or name == "median":
        return F.percentile(v, F.lit(0.5 if share is None else share))
    if name in ("first", "last"):
        pick = F.min_by if name == "first" else F.max_by
        return pick(v, F.when(v.isNotNull(), order))
    if name == "min-index":
        return F.min_by(order, F.when(v.isNotNull(), F.struct(v, order)))
    if name == "max-index":
        return F.min_by(order, F.when(v.isNotNull(), F.struct(-v, order)))
    simple = {
        "count": lambda: F.count(v),
        "sum": lambda: F.coalesce(F.sum(v), F.lit(0.0)),
        "mean": lambda: F.avg(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "mode": lambda: F.mode(v, True),
        "variance": lambda: F.var_samp(v),
        "deviation": lambda: F.stddev_samp(v),
        "distinct": lambda: F.count_distinct(v),
    }
    if name not in simple:
        raise ValueError(f"unknown reducer {name}")
    return simple[name]()


def label_of(value: str | None, reducer: Reducer | None = None, label: str | None = None) -> str | None:
    """Label of a channel: its own, or its name, with the reducer in front ("sum of value"); a count alone is "frequency"."""
    name = label or value
    if reducer is None or label is not None:
        return name
    kind = reducer if isinstance(reducer, str) else "value"
    return f"{kind} of {name}" if name else "frequency" if kind == "count" else kind
