"""The transform algebra: DataFrame -> DataFrame operators to be chained with ``df.transform``."""

from .basic import filter_rows, reverse_rows, select_extreme, select_first, select_last, shuffle_rows, sort_rows, top_categories
from .bins import Bins, Channel, assign, bin_edges, interval_edges, nice, thresholds, tick_step, ticks, time_interval
from .difference import align_series, crossings, difference, interpolate_at
from .group import bin_by, complete_grid, cumulative_bins, cumulative_reduce, group_by, group_rows, keep_empty, pearson, proportion
from .interval import CustomInterval, Interval, fill_interval, guess_interval, median_step, parse_interval, shift_x
from .ordered import encode, with_previous
from .series import cumsum, diff, impute, map_series, normalize, pct_change, quantile_rank, rank, rolling
from .stack import stack

__all__ = [n for n in dir() if not n.startswith("_")]
