"""Scales: extents and domains are aggregates; everything else is arithmetic on a few values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finite
from ..operators.bins import nice
from ..sources import field_type


def position_scale(frames: list[tuple[DataFrame, str]], zero: bool = False, facet: list[str] | None = None) -> dict:
    """Type and domain over several marks: any ordinal field makes it ordinal; continuous ones have extents, also by facet."""
    kinds = [field_type(dict(df.dtypes)[c]) for df, c in frames]
    if "ordinal" in kinds:
        every = frames[0][0].select(F.col(frames[0][1]).cast("string").alias("v"))
        for df, c in frames[1:]:
            every = every.unionByName(df.select(F.col(c).cast("string").alias("v")))
        return {"type": "ordinal", "domain": [r.v for r in every.filter("v IS NOT NULL").distinct().orderBy("v").collect()]}
    lo, hi = [], []
    for (df, c), kind in zip(frames, kinds, strict=True):
        v = F.col(c) if kind == "temporal" else finite(c)
        r = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
        lo += [r.lo] if r.lo is not None else []
        hi += [r.hi] if r.hi is not None else []
    domain = [min(lo), max(hi)] if lo else [0, 1]
    if zero and kinds[0] == "quantitative":
        domain = [min(0, domain[0]), max(0, domain[1])]
    out = {"type": kinds[0], "domain": domain}
    if facet:
        df, c = frames[0]
        out["facets"] = [r.asDict() for r in df.groupBy(*facet).agg(F.min(c).alias("lo"), F.max(c).alias("hi")).orderBy(*facet).collect()]
    return out


def nice_extent(lo: float, hi: float, count: int = 10) -> tuple[float, float]:
    return nice(lo, hi, count)


def color_scale(df: DataFrame, field: str, order: str, palette: list[str], diverging: bool = False) -> dict:
    """Categories by first appearance with a cyclic palette, or a continuous extent (symmetric if diverging)."""
    if field_type(dict(df.dtypes)[field]) == "ordinal":
        seen = df.filter(F.col(field).isNotNull()).groupBy(field).agg(F.min(order).alias("o")).orderBy("o").collect()
        return {"type": "ordinal", "domain": [r[field] for r in seen], "range": [palette[i % len(palette)] for i in range(len(seen))]}
    r = df.agg(F.min(finite(field)).alias("lo"), F.max(finite(field)).alias("hi")).first()
    lo, hi = (0.0, 1.0) if r.lo is None else (r.lo, r.hi)
    if diverging:
        most = max(abs(lo), abs(hi))
        lo, hi = -most, most
    return {"type": "continuous", "domain": [lo, hi], "range": palette}


def color_stops(palette: list[str], share: float) -> str:
    """The colour at a share of the way through equally spaced #rrggbb stops."""
    at = min(1.0, max(0.0, share)) * (len(palette) - 1)
    i = min(int(at), len(palette) - 2) if len(palette) > 1 else 0
    a, b = (tuple(int(c[k : k + 2], 16) for k in (1, 3, 5)) for c in (palette[i], palette[min(i + 1, len(palette) - 1)]))
    return "#" + "".join(f"{round(x + (y - x) * (at - i)):02x}" for x, y in zip(a, b, strict=True))


def radius_scale(value: float, top: float, radii: tuple[float, float] = (2, 9)) -> float:
    """Area in proportion to the value."""
    return radii[0] + math.sqrt(max(0.0, value) / top) * (radii[1] - radii[0]) if top > 0 else radii[0]
