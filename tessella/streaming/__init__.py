"""The same binning over streams: calendar bins with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import Reducer, reduce


def windowed_reduce(stream: DataFrame, time: str, width: str, outputs: dict[str, tuple[Reducer, str | None]], keys: list[str] | None = None, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) calendar bins of a stream: x1, x2, keys and outputs, each emitted once its watermark passes."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    aggregates = [reduce(r, None if c is None else F.col(c)).alias(n) for n, (r, c) in outputs.items()]
    out = stream.withWatermark(time, late).groupBy(window.alias("__w"), *(keys or [])).agg(*aggregates)
    return out.select(F.col("__w.start").alias("x1"), F.col("__w.end").alias("x2"), *(keys or []), *outputs)
