"""Insight models over grouped series. Row-wise models are windows; sequential ones run per series in grouped pandas functions."""

from .anomaly import anomalies, decompose_series
from .changepoint import changepoints
from .forecast import forecast
from .outliers import category_outliers, frequency_outliers, series_outliers, within_category
from .seasonality import autocorrelation, seasonality
from .trend import trend

__all__ = ["anomalies", "autocorrelation", "category_outliers", "changepoints", "decompose_series", "forecast", "frequency_outliers", "seasonality", "series_outliers", "trend", "within_category"]
