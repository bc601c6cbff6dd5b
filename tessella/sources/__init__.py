"""Sources, field inspection and sinks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def rows(spark: SparkSession, data: Sequence[Mapping], schema: str | None = None) -> DataFrame:
    """In-memory rows; none at all need a schema."""
    return spark.createDataFrame([dict(r) for r in data], schema)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text with a header; numbers and dates are inferred, empty is null."""
    return spark.read.csv(path, header=True, inferSchema=True)


def field_type(kind: str) -> str:
    """quantitative, temporal or ordinal, from a Spark type."""
    if kind.startswith(("timestamp", "date")):
        return "temporal"
    return "ordinal" if kind in ("string", "boolean") or kind.startswith(("char", "varchar")) else "quantitative"


def inspect_fields(df: DataFrame, most: int = 50) -> list[dict]:
    """Name, type and, for ordinal fields, up to ``most`` distinct values. The schema is exact, so nothing is sampled."""
    out = []
    for name, kind in df.dtypes:
        found = {"name": name, "type": field_type(kind)}
        if found["type"] == "ordinal":
            found["values"] = [r[0] for r in df.select(name).distinct().dropna().orderBy(name).limit(most).collect()]
        out.append(found)
    return out


def to_json(option: dict) -> str:
    """The option document as JSON."""
    return json.dumps(option, default=lambda v: v.isoformat() if hasattr(v, "isoformat") else str(v))
