import math

import numpy as np

from tessella import insights as I
from tessella.insights import kernels as K


def frame(spark, values, z="a"):
    return spark.createDataFrame([(z, i, None if v is None else float(v)) for i, v in enumerate(values)], "z string, x int, y double")


def test_local_window_keeps_its_width():
    centre, _ = K.local_median(np.array([1.0, 2, 3, 100]), 3)
    assert centre.tolist() == [2, 2, 3, 3]


def test_anomalies_find_a_spike(spark):
    values = [10 + (i % 3) for i in range(40)]
    values[20] = 90
    for how in ("mad", "zscore", "iqr", "ewma", "seasonal"):
        got = I.anomalies(frame(spark, values), "y", ["z"], "x", how).filter("is_anomaly").collect()
        assert 20 in [r.x for r in got], how


def test_forecasts(spark):
    line = frame(spark, [2 * i for i in range(20)])
    got = I.forecast(line, "y", ["z"], "x", 3, "drift").orderBy("step").collect()
    assert [r.point for r in got] == [40, 42, 44]
    assert math.isclose(I.forecast(line, "y", ["z"], "x", 1, "holt").first().point, 40, rel_tol=1e-6)
    wave = frame(spark, [10 * math.sin(2 * math.pi * i / 7) for i in range(70)])
    point = I.forecast(wave, "y", ["z"], "x", 7, "auto").orderBy("step").collect()
    assert max(abs(r.point - 10 * math.sin(2 * math.pi * (69 + r.step) / 7)) for r in point) < 2


def test_changepoints_seasons_and_trends(spark):
    got = I.changepoints(frame(spark, [0] * 30 + [10] * 30), "y", ["z"], "x", cost="mean").orderBy("segment").collect()
    assert [r.start for r in got] == [0, 30]
    season = I.seasonality(frame(spark, [i % 7 for i in range(84)]), "y", ["z"], "x", unit="day").first()
    assert (season.period, season.name) == (7, "weekly")
    for how in ("ols", "theil-sen"):
        t = I.trend(frame(spark, [3 * i + 1 for i in range(10)]), "x", "y", ["z"], how).first()
        assert math.isclose(t.slope, 3) and math.isclose(t.intercept, 1, abs_tol=1e-9) and math.isclose(t.r2, 1)


def test_outliers(spark):
    rows = [(k, float(v), i) for k, v in zip("abcdefg", [1, 2, 1, 2, 1, 2, 50], strict=True) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, v double, x int")
    assert [r.k for r in I.category_outliers(df, "k", "v").filter("is_outlier").collect()] == ["g"]
    assert [r.k for r in I.series_outliers(df, "x", "k", "v").filter("is_outlier").collect()] == ["g"]
    assert I.within_category(df, "v", ["k"]).filter("score IS NOT NULL").count() == 0
    assert I.frequency_outliers(df, "k").filter("kind IS NOT NULL").count() == 0


def test_constant_and_short_series(spark):
    assert I.anomalies(frame(spark, [1, 1]), "y", ["z"], "x", "mad").filter("is_anomaly").count() == 0
    assert I.forecast(frame(spark, [1]), "y", ["z"], "x").count() == 0
    assert K.robust_z(np.array([1.0, 1, 1])).tolist() == [0, 0, 0]


def test_spectral_periods():
    wave = np.array([math.sin(2 * math.pi * i / 12) for i in range(240)])
    for how in ("periodogram", "auto"):
        assert K.periods(wave, method=how)[0][0] == 12
    assert K.periods(np.ones(60), method="periodogram") == []


def test_online_changepoints(spark):
    noise = np.random.default_rng(1).normal(0, 1, 120)
    noise[60:] += 12
    found = K.online_changepoints(noise)
    assert len(found) == 1 and abs(found[0] - 60) <= 1
    assert K.online_changepoints(np.random.default_rng(2).normal(0, 1, 120)) == []
    got = I.changepoints(frame(spark, noise.tolist()), "y", ["z"], "x", method="normal-gamma").orderBy("segment").collect()
    assert [r.start for r in got] == [0, found[0]] and got[1].mean > 11


def test_dbscan_finds_the_far_series(spark):
    rows = [(k, float(v), i) for k, v in zip("abcdefg", [1, 2, 1.5, 2.5, 1, 2, 50], strict=True) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, v double, x int")
    assert [r.k for r in I.series_outliers(df, "x", "k", "v", method="dbscan").filter("is_outlier").collect()] == ["g"]
