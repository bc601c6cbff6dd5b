import datetime
import math

import pytest
from pyspark.sql import functions as F

from tessella import operators as O
from tessella.functions import label_of
from tessella.insights import anomalies, forecast, trend
from tessella.insights.derived import anomaly_layers, forecast_layers, future_x, highlight, only, summaries, trend_layers
from tessella.operators.bins import Bins, Channel, interval_edges, time_interval
from tessella.operators.group import group_rows, keep_empty, pearson
from tessella.operators.interval import CustomInterval, Interval, median_step, parse_interval
from tessella.operators.ordered import encode, with_previous
from tessella.operators.stack import stack
from tessella.plans.spec import guess_spec, is_monotonic, layers, plot, replicate


@pytest.fixture(scope="module")
def series(spark):
    day = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i)
    return spark.createDataFrame([(day(i), z, float(i * (1 if z == "a" else 2) + (50 if (i, z) == (9, "a") else 0))) for i in range(20) for z in "ab"], "t timestamp, z string, v double")


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_previous_rows(spark, rows):
    df = spark.createDataFrame([(i * i, float(i % 7)) for i in range(40)], "o long, v double").repartition(5)
    got = {r.o: r.previous for r in with_previous(df, "o", F.col("v"), rows=rows).collect()}
    assert got == {i * i: float((i - 1) % 7) if i else None for i in range(40)}
    assert with_previous(df.limit(0), "o", F.col("v")).count() == 0


def test_median_step_and_monotonic(spark):
    df = spark.createDataFrame([(float(x), float(-x)) for x in (0, 1, 2, 4, 4, 9, 20)], "x double, y double")
    assert median_step(df, "x") == 2.0 and is_monotonic(df, "y", "x")
    assert not is_monotonic(df.withColumn("y", F.abs(F.col("y") + 3)), "y", "x")


def test_codes(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "o long, k string")
    assert [r.code for r in encode(df, "k", "o").orderBy("o").collect()] == [0, 1, 0, -1]
    assert [r.code for r in encode(df, "k", "o", ["a"]).orderBy("o").collect()] == [-1, 0, -1, -1]


def test_bins_of_times_and_channels(spark, series):
    assert time_interval(series, "t") == Interval("day") and time_interval(series, "t", 2) == Interval("week")
    assert Channel("t").bins(series) == Interval("day") and Channel("t", interval="month").bins(series, interval="day") == Interval("month")
    assert interval_edges(series, "v", 10).edges == (0, 10, 20, 30, 40, 50, 60) and interval_edges(series, "v", 10, (5, 12)).edges == (0, 10, 20)
    assert Channel("v", interval=30, domain=(0, 40)).bins(series).edges == (0, 30, 60)


def test_empty_bins_are_kept(spark):
    df = spark.createDataFrame([(0.0, "a"), (10.0, "b")], "w double, k string")
    bins = Bins((0, 2, 4, 6, 8, 10))
    out = keep_empty(O.bin_by(df, "w", bins, {"n": ("count", None)}, ["k"]), bins, ["k"], {"n": 0})
    assert sorted((r.k, r.x1, r.n) for r in out.collect()) == sorted((k, float(x), int((k, x) in (("a", 0), ("b", 8)))) for k in "ab" for x in (0, 2, 4, 6, 8))


def test_rows_of_groups_and_correlation(spark):
    df = spark.createDataFrame([(2, "a", 1.0, 2.0), (1, "a", 2.0, 4.0), (3, "b", 1.0, 1.0), (4, "b", 1.0, 3.0), (5, "a", None, 9.0)], "o long, k string, x double, y double")
    assert [x.o for x in group_rows(df, ["k"], "o").filter("k = 'a'").first().data] == [1, 2, 5]
    with pytest.raises(Exception, match="more than 1 rows"):
        group_rows(df, ["k"], "o", most=1).collect()
    got = {r.k: r.r for r in df.groupBy("k").agg(pearson("x", "y").alias("r")).collect()}
    assert math.isclose(got["a"], 1.0) and math.isnan(got["b"])


def test_labels():
    assert label_of("v", "sum") == "sum of v" and label_of(None, "count") == "frequency" and label_of("v", "sum", "V") == "V" and label_of("v") == "v"


def test_custom_interval(spark):
    tens = CustomInterval(lambda x: F.floor(x / 10) * 10, lambda x, k: x + 10 * k, lambda a, b: F.sequence(a, b, F.lit(10).cast("long")))
    assert parse_interval(tens) is tens
    df = spark.createDataFrame([(3, 1.0), (35, 2.0)], "x long, y double")
    assert [(r.x, r.y) for r in O.fill_interval(df, "x", "y", tens, [], "x").orderBy("x").collect()] == [(0, 1.0), (10, None), (20, None), (30, 2.0)]


def test_layers_of_insights(spark, series):
    found = anomalies(series, "v", ["z"], "t", method="iqr")
    drawn = anomaly_layers(found, "t", "v", ["z"])
    assert drawn.filter("layer = 'band'").count() == 40 and drawn.filter("layer = 'dots'").count() == found.filter("is_anomaly").count()
    marked = highlight(series, found, ["z", "t"])
    assert marked.filter("highlight").count() == found.filter("is_anomaly").count() and marked.count() == 40
    ahead = forecast(series, "v", ["z"], "t", horizon=2, method="naive")
    assert sorted({r.t for r in future_x(series, "t", ahead, ["z"]).collect()}) == [datetime.datetime(2024, 1, 21), datetime.datetime(2024, 1, 22)]
    assert {r.layer: r["count"] for r in forecast_layers(series, "t", "v", ahead, ["z"]).groupBy("layer").count().collect()} == {"start": 2, "line": 4, "band": 4}
    number = series.withColumn("t", F.unix_millis("t") / 86400000.0)
    ends = trend_layers(number, "t", trend(number.filter("z = 'b'"), "t", "v", ["z"]), ["z"]).collect()
    assert sorted(round(r.y, 6) for r in ends) == [0.0, 38.0]
    assert only(series, {"z": "a"}).count() == 20 and only(series, {"z": ["a", "b"]}).count() == 40
    assert summaries({"anomalies": found, "trend": ahead}) == {"anomalies": f"{found.filter('is_anomaly').count()} of 40 stand out", "trend": "4 rows"}


def test_plots(spark, series):
    assert guess_spec(series) == {"x": "t", "y": "v", "color": "z"}
    bars = plot(series.withColumnRenamed("v", "y"), {"mark": "barY", "x": "t", "y": "y", "color": "z"})
    rows = bars.data.filter("t = '2024-01-05'").orderBy("z").collect()
    assert [(r.z, r.y, r.y1, r.y2) for r in rows] == [("a", 4.0, 0.0, 4.0), ("b", 8.0, 4.0, 12.0)]
    line = plot(series, {"mark": "line", "x": "t", "y": "v", "color": "z", "insights": {"anomalies": {"method": "iqr", "target": {"z": "a"}}}})
    assert line.summaries()["anomalies"].endswith("of 20 stand out")
    with pytest.raises(ValueError, match="more than 3 rows"):
        line.describe(limit=3)
    both = layers({"line": line, "bars": bars})
    assert both.groupBy("layer").count().count() == 2 and both.count() == 80
    assert replicate(series.drop("z"), series, ["z"]).count() == 80


def test_wiggle_without_facets(spark):
    df = spark.createDataFrame([(x, z, float(v), x * 2 + i) for x, vs in enumerate([(1, 2), (2, 2), (4, 1)]) for i, (z, v) in enumerate(zip("ab", vs))], "x long, z string, v double, r long")
    got = {(r.x, r.z): (r.y1, r.y2) for r in stack(df, "x", "v", "z", "r", offset="wiggle").collect()}
    shift = 0.0
    for x, (now, before) in enumerate(zip([(1, 2), (2, 2), (4, 1)], [(1, 2), (1, 2), (2, 2)])):
        below = move = 0.0
        for h, b in zip(now, before):
            move += (below + (h - b) / 2) * h
            below += h - b
        shift -= move / sum(now) if x else 0.0
        assert math.isclose(got[x, "a"][0], shift) and math.isclose(got[x, "b"][1], shift + sum(now))
