"""From a specification to DataFrames and an option document.

A specification names a mark, fields and transforms. ``auto_spec`` fills what is
missing in; ``plot`` runs the transforms as DataFrame operators and collects only
what they leave for drawing (``limit`` guards the driver).
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import insights as models
from ..functions import finite
from ..operators import bin_by, bin_edges, fill_interval, group_by, normalize, rolling, stack
from ..insights.derived import only, summaries
from ..operators.bins import time_interval
from ..operators.interval import parse_interval
from ..operators.ordered import with_previous
from ..sources import field_type
from .scales import position_scale

STACKED = frozenset(("areaY", "areaX", "barY", "barX", "rectY", "rectX"))
SERIES = frozenset(("line", "lineY", "lineX", "area", "areaY", "dot", "barY", "rectY"))
MARKS = frozenset("line lineX lineY area areaX areaY bar barX barY rect rectX rectY cell dot dotX dotY rule ruleX ruleY text textX textY differenceX differenceY frame gridX gridY".split())


def format_value(v) -> str:
    """Dates as YYYY-MM-DD (with the time unless midnight); numbers with fewer decimals the larger they are."""
    if v is None:
        return ""
    if isinstance(v, (datetime.datetime, datetime.date)):
        time = isinstance(v, datetime.datetime) and (v.hour or v.minute or v.second)
        return v.strftime("%Y-%m-%d %H:%M" if time else "%Y-%m-%d")
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        if abs(v) >= 1000:
            return f"{v:.0f}"
        return f"{v:.1f}".rstrip("0").rstrip(".") if abs(v) >= 10 else f"{v:.3g}"
    return str(v)


def is_monotonic(df: DataFrame, value: str, order: str) -> bool:
    """Whether finite values never change direction in the given order."""
    v = F.unix_micros(value).cast("double") if dict(df.dtypes)[value].startswith("timestamp") else finite(value)
    rows = df.select(order, v.alias("v")).filter("v IS NOT NULL")
    steps = with_previous(rows, order, F.col("v")).select(F.signum(F.col("v") - F.col("previous")).alias("s"))
    r = steps.agg(F.max("s").alias("hi"), F.min("s").alias("lo")).first()
    return r.hi is None or not (r.hi > 0 and r.lo < 0)


def auto_spec(df: DataFrame, spec: dict, order: str | None = None) -> dict:
    """Complete a specification: reducers, mark and zero baseline, with the reason."""
    out, kind = dict(spec), dict(df.dtypes)
    x, y = out.get("x"), out.get("y")
    tx, ty = (field_type(kind[c]) if c else None for c in (x, y))
    if out.get("reduce") is None and (x is None or y is None) and not out.get("mark") == "rule":
        out["reduce"] = "count"
    aggregated = out.get("reduce") is not None
    if out.get("mark"):
        reason = "requested"
    elif out.get("size"):
        out["mark"], reason = "dot", "a size needs dots"
    elif aggregated and out["reduce"] in ("count", "sum", "proportion", "distinct"):
        out["mark"], reason = ("barX" if x is None and y is not None else "barY"), "aggregates start from zero"
    elif tx == ty == "ordinal":
        out["mark"], reason = "dot", "two ordinal fields"
    elif x and y and order and not is_monotonic(df, x, order) and (ty != "quantitative" or not is_monotonic(df, y, order)):
        out["mark"], reason = "dot", "neither field is ordered"
    elif x and y:
        out["mark"], reason = "line", "one field is ordered"
    else:
        out["mark"], reason = "rule", "one field"
    out["zero"] = out.get("zero", out["mark"].startswith(("bar", "area", "rect")))
    out["reason"] = reason
    return out


def facets(df: DataFrame, fx: str | None, fy: str | None) -> list[dict]:
    """Facets in row-major order: every fy with every fx (two small domains)."""
    domain = lambda c: [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).collect()] if c else [None]
    return [{"fx": a, "fy": b} for b in domain(fy) for a in domain(fx)]


@dataclass(frozen=True)
class Chart:
    """A compiled chart: its rows, insights, scales and warnings."""

    spec: dict
    data: DataFrame
    insights: dict[str, DataFrame] = field(default_factory=dict)
    scales: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def option(self, limit: int = 100_000) -> dict:
        """The option document; more than ``limit`` rows are an error, not a sample."""
        rows = self.data.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} rows to draw: aggregate first")
        groups: dict = {}
        z = self.spec.get("color")
        for r in rows:
            groups.setdefault(r[z] if z in r.asDict() else None, []).append(r.asDict())
        kind = self.spec["mark"].removesuffix("X").removesuffix("Y")
        return {"series": [{"type": {"dot": "scatter", "area": "line", "rect": "bar"}.get(kind, kind), "name": name, "data": data} for name, data in groups.items()], "xAxis": self.scales.get("x"), "yAxis": self.scales.get("y"), "warnings": self.warnings}

    def describe(self, limit: int = 1000) -> dict[str, list[dict]]:
        """Rows of each insight; more than ``limit`` of one are an error."""
        out = {}
        for k, df in self.insights.items():
            rows = df.limit(limit + 1).collect()
            if len(rows) > limit:
                raise ValueError(f"insight {k} has more than {limit} rows")
            out[k] = [r.asDict() for r in rows]
        return out

    def summaries(self) -> dict[str, str]:
        """One line of text for each insight."""
        return summaries(self.insights)


def layers(charts: dict[str, Chart]) -> DataFrame:
    """The rows of several marks of one plot, by ``layer``; columns that a mark lacks are null."""
    out = None
    for name, chart in charts.items():
        part = chart.data.withColumn("layer", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def replicate(df: DataFrame, facets_of: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a mark without these facets, once in every facet of another's (a small domain)."""
    missing = [k for k in keys if k not in df.columns]
    return df.crossJoin(F.broadcast(facets_of.select(*missing).distinct())) if missing else df


def guess_spec(df: DataFrame) -> dict:
    """The first time as x, the first number as y, and a string of at most 24 values as color."""
    kinds = {name: field_type(kind) for name, kind in df.dtypes}
    found = {"x": next((n for n, k in kinds.items() if k == "temporal"), None)}
    found["y"] = next((n for n, k in kinds.items() if k == "quantitative"), None)
    for name in (n for n, k in kinds.items() if k == "ordinal"):
        if df.select(name).distinct().limit(25).count() <= 24:
            found["color"] = name
            break
    return {k: v for k, v in found.items() if v}


def plot(df: DataFrame, spec: dict, order: str | None = None) -> Chart:
    """Compile: filter, aggregate (group or bin), interval, window, normalise, stack, insights, scales."""
    spec = auto_spec(df, spec, order)
    if spec["mark"] not in MARKS:
        raise ValueError(f"unknown mark {spec['mark']}")
    x, y, z = spec.get("x"), spec.get("y"), spec.get("color")
    warnings: list[str] = []
    if spec.get("filter") is not None:
        df = df.filter(spec["filter"])
    by = [c for c in (spec.get("fx"), spec.get("fy"), z) if c]
    kind = dict(df.dtypes)
    if spec.get("reduce"):
        out = {"value" if y is None else y: (spec["reduce"], y)}
        if x and field_type(kind[x]) == "quantitative" and spec.get("bins") is not False:
            df = bin_by(df, x, bin_edges(df, x, spec.get("bins", "auto")), out, by, order)
            x = "x"
        elif x and field_type(kind[x]) == "temporal":
            step = parse_interval(spec["interval"]) if spec.get("interval") else time_interval(df, x, spec.get("bins") if isinstance(spec.get("bins"), int) else None)
            df = group_by(df.withColumn(x, step.floor(F.col(x))), [*by, x], out, order)
        else:
            df = group_by(df, [*by, *([x] if x else [])], out, order)
        y = next(iter(out))
    elif spec.get("interval") and x and y:
        df = fill_interval(df, x, y, spec["interval"], by, order or x, spec.get("intervalReduce", "first"), spec.get("fill"))
    if spec.get("window") and y:
        df = rolling(df, y, **({"k": spec["window"]} if isinstance(spec["window"], int) else spec["window"]), by=by, order=x)
    if spec.get("normalize") and y:
        df = normalize(df, y, spec["normalize"], by, x)
    found: dict[str, DataFrame] = {}
    for name, options in (spec.get("insights") or {}).items():
        if spec["mark"] not in SERIES and name in ("anomalies", "forecast", "changepoints", "seasonality", "trend"):
            warnings.append(f"{name} needs a series mark")
            continue
        options = {} if options is True else dict(options)
        series = only(df, options.pop("target", None)).filter(F.col(x).isNotNull())
        keys = by or ["__all"]
        series = series if by else series.withColumn("__all", F.lit(1))
        if name == "trend":
            number = series.withColumn("__t", F.unix_millis(x).cast("double") if field_type(dict(df.dtypes)[x]) == "temporal" else F.col(x))
            found[name] = models.trend(number, "__t", y, keys, **options)
        elif name in ("anomalies", "forecast", "changepoints", "seasonality"):
            found[name] = getattr(models, name)(series, y, keys, x, **options)
        elif name == "frequency":
            found[name] = models.frequency_outliers(df, x, F.col(y), **options)
        elif name == "category":
            found[name] = models.category_outliers(df, x, y, **options)
        elif name == "series" and z:
            found[name] = models.series_outliers(df, x, z, y, **options)
        else:
            warnings.append(f"no insight {name} here")
    if spec["mark"] in STACKED and z and x and y and spec.get("stack", True) is not False:
        names = {c: f"__own_{c}" for c in ("y", "y1", "y2") if c in df.columns}  # the stack's columns go beside the caller's
        at = {c: names.get(c, c) for c in (x, y, z, *by)}
        stacked = stack(df.withColumnsRenamed(names).withColumn("__row", F.col(at[z])), at[x], at[y], at[z], "__row", [at[c] for c in by if c != z], **(spec["stack"] if isinstance(spec.get("stack"), dict) else {}))
        df = stacked.drop("__row", *([] if "y" not in names else ["y"])).withColumnsRenamed({names[c]: c if c == "y" else f"{c}_own" for c in names})
    scales = {name: position_scale([(df, c)], spec["zero"] and name == ("x" if spec["mark"].endswith("X") else "y")) for name, c in (("x", x), ("y", y)) if c and c in df.columns}
    return Chart(spec, df, found, scales, warnings)


def spec_to_code(spec: dict, name: str = "df") -> str:
    """A snippet that plots the specification."""
    shown = {k: v for k, v in spec.items() if v is not None and k != "reason"}
    return "from tessella.plans import plot\n\nchart = plot(\n    " + f"{name},\n    {shown!r},\n)\nprint(chart.option())\n"
