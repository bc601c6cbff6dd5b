"""Numeric and calendar intervals (UTC): floor, offset, range, gap filling and shifts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reduce
from .ordered import with_previous
from .series import impute

# Milliseconds of the units with a constant length.
MS = {"millisecond": 1, "second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}
MONTHS = {"month": 1, "quarter": 3, "year": 12}
MONDAY = 4 * 86_400_000  # 1970-01-05


@dataclass(frozen=True)
class CustomInterval:
    """An interval by its own functions of columns: floor(x), offset(x, k) and, to fill gaps, sequence(start, stop)."""

    floor: Callable[[Column], Column]
    offset: Callable[[Column, int], Column]
    sequence: Callable[[Column, Column], Column] | None = None
    unit: str = "custom"


@dataclass(frozen=True)
class Interval:
    """``count`` units, or a number step (unit ``number``)."""

    unit: str
    count: float = 1

    def floor(self, x: Column) -> Column:
        if self.unit == "number":
            return F.floor(x / self.count) * self.count if self.count > 0 else F.floor(x * -self.count) / -self.count
        n = int(self.count)
        if self.unit in MS:
            step, base = MS[self.unit] * n, MONDAY if self.unit == "week" else 0
            return F.timestamp_millis((F.floor((F.unix_millis(x) - base) / step) * step + base).cast("long"))
        if self.unit == "quarter":
            if n > 1:
                raise ValueError("several quarters have no common floor; use months")
            return F.date_trunc("quarter", x)
        if self.unit == "year":
            return F.make_timestamp(F.floor(F.year(x) / n).cast("int") * n, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        month = F.floor((F.month(x) - 1) / n).cast("int") * n + 1
        return F.make_timestamp(F.year(x), month, F.lit(1), F.lit(0), F.lit(0), F.lit(0))

    def offset(self, x: Column, k: int = 1) -> Column:
        """Calendar months overflow: a day beyond a month's end runs on into the next."""
        if self.unit == "number":
            return x + k * (self.count if self.count > 0 else 1 / -self.count)
        if self.unit in MS:
            return F.timestamp_millis(F.unix_millis(x) + int(k * self.count * MS[self.unit]))
        start = F.date_trunc("month", x)
        moved = F.add_months(start, int(k * self.count * MONTHS[self.unit])).cast("timestamp")
        return F.timestamp_millis(F.unix_millis(moved) + F.unix_millis(x) - F.unix_millis(start))

    def sequence(self, start: Column, stop: Column) -> Column:
        """All steps from start to stop, both floored; both are included."""
        if self.unit == "number":
            step = self.count if self.count > 0 else 1 / -self.count
            n = F.round((stop - start) / step).cast("int")
            return F.transform(F.sequence(F.lit(0), n), lambda i: start + i * step)
        n = int(self.count)
        words = f"{n * MONTHS[self.unit]} month" if self.unit in MONTHS else f"{n * MS[self.unit]} millisecond"
        return F.sequence(start, stop, F.expr(f"interval {words}"))


def parse_interval(text: str | float | Interval) -> Interval:
    """``3 months``, ``day``, a number (negative: parts of one) or an interval."""
    if isinstance(text, CustomInterval):
        return text
    if isinstance(text, Interval):
        return text
    if isinstance(text, (int, float)):
        if not text:
            raise ValueError("an interval of 0")
        return Interval("number", float(text))
    m = re.fullmatch(r"\s*(?:(\d+)\s+)?([a-z]+?)s?\s*", text.lower())
    if not m or m[2] not in MS | MONTHS:
        raise ValueError(f"unknown interval {text}")
    return Interval(m[2], int(m[1] or 1))


def median_step(df: DataFrame, x: str) -> float | None:
    """Upper median of the positive differences of consecutive x."""
    gaps = with_previous(df.select(F.col(x).alias("x")), "x", F.col("x")).select((F.col("x") - F.col("previous")).cast("double").alias("gap")).filter("gap > 0")
    step = gaps.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap DESC)")).first()[0]
    return None if step is None else float(step)


def guess_interval(step_ms: float) -> Interval:
    """The calendar interval of a typical step in milliseconds."""
    days = step_ms / MS["day"]
    # fixed values: the least days of each unit
    for least, unit in ((360, "year"), (85, "quarter"), (27, "month"), (6.5, "week"), (0.95, "day")):
        if days >= least:
            return Interval(unit)
    for unit in ("hour", "minute", "second"):
        if step_ms >= 0.95 * MS[unit]:
            return Interval(unit, max(1, round(step_ms / MS[unit])))
    return Interval("number", step_ms)


def fill_interval(df: DataFrame, x: str, y: str, interval: str | Interval, by: list[str], order: str, reducer: str = "first", fill: str | float | None = None) -> DataFrame:
    """One row for each step of each series: x snapped, duplicates merged, gaps inserted (missing = true), values imputed if asked."""
    step = parse_interval(interval)
    snapped = df.withColumn("__x", step.floor(F.col(x))).filter("__x IS NOT NULL").groupBy(*by, "__x").agg(reduce(reducer, F.col(y), F.col(order)).alias(y))
    spans = snapped.groupBy(*by).agg(F.min("__x").alias("__a"), F.max("__x").alias("__b"))
    grid = spans.select(*by, F.explode(step.sequence(F.col("__a"), F.col("__b"))).alias("__x"))
    out = grid.join(snapped.withColumn("__have", F.lit(True)), [*by, "__x"], "left").withColumn("missing", F.col("__have").isNull()).drop("__have")
    if fill is not None:
        out = impute(out, y, fill, by, "__x")
    return out.withColumnRenamed("__x", x)


def shift_x(df: DataFrame, x: str, by: str | float) -> DataFrame:
    """x1 = x shifted ("+1 year", "-7 day", a number), x2 = x: to compare with what was before."""
    if isinstance(by, str):
        sign = -1 if by.strip().startswith("-") else 1
        moved = parse_interval(by.strip().lstrip("+-")).offset(F.col(x), sign)
    else:
        moved = F.col(x) + by
    return df.withColumn("x1", moved).withColumn("x2", F.col(x))
