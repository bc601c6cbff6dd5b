"""Declarative chart specifications compiled to DataFrames and an option document."""

from .scales import color_scale, color_stops, nice_extent, position_scale, radius_scale
from .spec import Chart, auto_spec, facets, format_value, is_monotonic, plot, spec_to_code

__all__ = ["Chart", "auto_spec", "color_scale", "color_stops", "facets", "format_value", "is_monotonic", "nice_extent", "plot", "position_scale", "radius_scale", "spec_to_code"]
