"""Bin edges from one row of summary statistics, and bin assignment as arithmetic on columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finite


def tick_step(start: float, stop: float, count: float) -> tuple[float, bool]:
    """A step of 1, 2 or 5 times a power of ten for about ``count`` ticks; true if it is the inverse of the number given."""
    if not count > 0 or stop == start:
        return 0.0, False
    raw = abs(stop - start) / count
    power = math.floor(math.log10(raw))
    error = raw / 10.0**power
    factor = 10 if error >= math.sqrt(50) else 5 if error >= math.sqrt(10) else 2 if error >= math.sqrt(2) else 1
    if power < 0:
        return 10.0**-power / factor, True
    return 10.0**power * factor, False


def ticks(start: float, stop: float, count: float) -> list[float]:
    """Round values from start to stop, in that direction."""
    if start == stop:
        return [start]
    lo, hi = sorted((start, stop))
    step, inverse = tick_step(lo, hi, count)
    if not step:
        return []
    scale = (lambda i: i / step) if inverse else (lambda i: i * step)
    first, last = (lo * step, hi * step) if inverse else (lo / step, hi / step)
    i, j = math.ceil(first - 1e-9), math.floor(last + 1e-9)
    out = [scale(k) for k in range(i, j + 1)]
    return out if start < stop else out[::-1]


def nice(start: float, stop: float, count: float) -> tuple[float, float]:
    """Extend an extent to whole steps until the step is stable."""
    before = None
    for _ in range(10):
        step, inverse = tick_step(start, stop, count)
        if not step or (step, inverse) == before:
            break
        unit = 1 / step if inverse else step
        start, stop = (math.floor(start * step) / step, math.ceil(stop * step) / step) if inverse else (math.floor(start / unit) * unit, math.ceil(stop / unit) * unit)
        before = (step, inverse)
    return start, stop


@dataclass(frozen=True)
class Bins:
    """Edges in ascending order; the last bin is closed."""

    edges: tuple[float, ...]

    @property
    def step(self) -> float | None:
        """The common width, if there is one."""
        if len(self.edges) < 2:
            return None
        width = (self.edges[-1] - self.edges[0]) / (len(self.edges) - 1)
        return width if all(math.isclose(b - a, width, rel_tol=1e-9) for a, b in zip(self.edges, self.edges[1:], strict=False)) else None


def _count(rule: str, lo: float, hi: float, n: int, sd: float | None, iqr: float | None) -> int:
    if rule == "sturges":
        return math.ceil(math.log2(n)) + 1 if n else 1
    if rule in ("freedman-diaconis", "fd"):
        return math.ceil((hi - lo) / (2 * iqr * n ** (-1 / 3))) if iqr else 1
    count = math.ceil((hi - lo) / (3.49 * sd * n ** (-1 / 3))) if sd else 1
    return min(count, 200) if rule == "auto" else count


def thresholds(lo: float, hi: float, count: float) -> tuple[float, ...]:
    """Nice edges that cover [lo, hi]."""
    if lo == hi:
        return (lo, lo + 1)
    a, b = nice(lo, hi, count)
    edges = ticks(a, b, count)
    if len(edges) > 1 and hi >= edges[-1]:
        edges.append(edges[-1] + (edges[-1] - edges[-2]))
    return tuple(edges)


def bin_edges(df: DataFrame, value: str, rule: str | int | Sequence[float] | Callable = "auto") -> Bins:
    """Edges by a rule (auto, scott, sturges, freedman-diaconis), a tick count, explicit edges, or a function of (stats) that gives a count or edges."""
    if isinstance(rule, (list, tuple)):
        return Bins(tuple(sorted(map(float, rule))))
    v = finite(value)
    wanted = [F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"), F.stddev_samp(v).alias("sd")]
    if rule in ("freedman-diaconis", "fd") or callable(rule):
        wanted.append((F.percentile(v, F.lit(0.75)) - F.percentile(v, F.lit(0.25))).alias("iqr"))
    row = df.agg(*wanted).first().asDict()
    if not row["n"]:
        return Bins(())
    if callable(rule):
        rule = rule(row)
        if isinstance(rule, (list, tuple)):
            return Bins(tuple(sorted(map(float, rule))))
    count = rule if isinstance(rule, (int, float)) else _count(rule, row["lo"], row["hi"], row["n"], row["sd"], row.get("iqr"))
    return Bins(thresholds(row["lo"], row["hi"], count))


def interval_edges(df: DataFrame, value: str, step: float, domain: tuple[float, float] | None = None) -> Bins:
    """Multiples of ``step`` that cover the values, or ``domain``."""
    v = finite(value)
    lo, hi = domain or df.agg(F.min(v), F.max(v)).first()
    if lo is None:
        return Bins(())
    first, last = math.floor(lo / step), math.floor(hi / step) + 1
    return Bins(tuple(i * step for i in range(first, last + 1)))


def time_interval(df: DataFrame, x: str, count: int | None = None, domain: tuple | None = None):
    """The calendar interval that gives about ``count`` bins of the times (by default twice the bins of Sturges' rule, 5 to 120)."""
    from .interval import guess_interval

    lo, hi, n = df.select(F.unix_millis(F.col(x).cast("timestamp")).alias("t")).agg(F.min("t"), F.max("t"), F.count("t")).first()
    if not n:
        return guess_interval(86_400_000.0)
    if domain:
        lo, hi = (d.timestamp() * 1000 for d in domain)
    count = count or max(5, min(60, math.ceil(math.log2(n)) + 1) * 2)
    return guess_interval((hi - lo) / count)


@dataclass(frozen=True)
class Channel:
    """What a channel is binned by, with options of its own that go before those of the transform."""

    value: str
    thresholds: object = None
    interval: object = None
    domain: tuple | None = None

    def bins(self, df: DataFrame, thresholds="auto", interval=None):
        """Bins of numbers, or an interval of times."""
        from .interval import parse_interval

        step, rule = self.interval or interval, self.thresholds if self.thresholds is not None else thresholds
        if dict(df.dtypes)[self.value].startswith(("timestamp", "date")):
            return parse_interval(step) if step else time_interval(df, self.value, rule if isinstance(rule, int) else None, self.domain)
        if step:
            return interval_edges(df, self.value, float(step), self.domain)
        if callable(rule) and self.domain:
            lo, hi = self.domain
            return bin_edges(df, self.value, lambda stats: rule(stats | {"lo": lo, "hi": hi}))
        return bin_edges(df, self.value, rule)


def assign(value: Column | str, bins: Bins) -> Column:
    """Number of the bin of a value; null outside of all. Equal widths need no search."""
    v, edges = finite(value), bins.edges
    if len(edges) < 2:
        return F.lit(None).cast("int")
    last = len(edges) - 2
    inside = (v >= edges[0]) & (v <= edges[-1])
    literal = F.array(*map(F.lit, edges))
    found = F.size(F.filter(literal, lambda e: e <= v)) - 1
    if bins.step and len(edges) > 16:
        guess = F.floor((v - edges[0]) / bins.step).cast("int")
        guess = F.greatest(F.lit(0), F.least(guess, F.lit(last)))
        # floating steps: the neighbour may be the right one
        up, down = F.element_at(literal, guess + 2), F.element_at(literal, guess + 1)
        found = guess + F.when(v >= up, 1).when(v < down, -1).otherwise(0)
    return F.when(inside, F.least(found, F.lit(last))).cast("int")
