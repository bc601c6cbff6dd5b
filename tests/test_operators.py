import math

import pytest
from pyspark.sql import functions as F

from tessella import operators as O
from tessella.operators.interval import guess_interval, parse_interval
from tessella.plans import color_stops, format_value, is_monotonic, plot, radius_scale, spec_to_code
from tessella.sources import inspect_fields


def series(spark, values):
    return spark.createDataFrame([(1, i, None if v is None else float(v)) for i, v in enumerate(values)], "z int, x int, y double")


def column(df, name="y", order="x"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_ticks_and_nice():
    assert O.ticks(0, 10, 5) == [0, 2, 4, 6, 8, 10]
    assert O.ticks(10, 0, 5) == [10, 8, 6, 4, 2, 0]
    assert O.ticks(3, 3, 5) == [3]
    assert O.nice(0.13, 9.7, 10) == (0, 10)
    assert O.thresholds(5, 5, 10) == (5, 6)


def test_assign_closes_the_last_bin(spark):
    bins = O.Bins((0.0, 1.0, 2.0))
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 1.0, 2.0, 2.1, float("nan"), None)], "v double")
    assert [r.b for r in df.select(O.assign("v", bins).alias("b")).collect()] == [None, 0, 1, 1, None, None, None]
    many = O.Bins(tuple(i / 10 for i in range(31)))
    got = spark.range(31).select(O.assign(F.col("id") / 10, many).alias("b")).collect()
    assert [r.b for r in got] == [*range(30), 29]


def test_rolling_frames_and_strict(spark):
    df = series(spark, [1, 2, None, 4])
    assert column(O.rolling(df, "y", 2, "sum", "end", by=["z"])) == [1, 3, 2, 4]
    assert column(O.rolling(df, "y", 2, "sum", "end", strict=True, by=["z"])) == [None, 3, None, None]
    assert column(O.rolling(df, "y", 3, "max-index", by=["z"])) == [1, 1, 3, 3]
    with pytest.raises(ValueError):
        O.rolling(df, "y", 2, "proportion")


def test_maps(spark):
    df = series(spark, [2, None, 2, 6])
    assert column(O.cumsum(df, "y", ["z"])) == [2, 2, 4, 10]
    assert column(O.rank(df, "y", ["z"])) == [0, None, 0, 2]
    assert column(O.quantile_rank(df, "y", ["z"])) == [0, None, 0, 1]
    assert column(O.diff(df, "y", ["z"])) == [None, None, None, 4]
    assert column(O.pct_change(df, "y", ["z"]))[-1] == 2
    assert column(O.normalize(series(spark, [3, None, 3]), "y", "extent", ["z"])) == [0, 0, 0]
    doubled = O.map_series(df, "y", lambda s: s * 2, ["z"])
    assert column(doubled)[-1] == 12


def test_impute(spark):
    df = series(spark, [None, 1, None, 3, None])
    assert column(O.impute(df, "y", "linear", ["z"])) == [1, 1, 2, 3, 3]
    assert column(O.impute(df, "y", "previous", ["z"])) == [None, 1, 1, 3, 3]
    assert column(O.impute(df, "y", "next", ["z"])) == [1, 1, 3, 3, None]
    assert column(O.impute(df, "y", 7, ["z"])) == [7, 1, 7, 3, 7]


def test_stack_offsets(spark):
    df = spark.createDataFrame([("a", "p", 1.0, 0), ("a", "q", -2.0, 1), ("a", "r", 3.0, 2), ("a", "s", None, 3)], "x string, z string, v double, row int")
    got = {r.z: (r.y1, r.y2) for r in O.stack(df, "x", "v", "z", "row").collect()}
    assert got == {"p": (0, 1), "q": (0, -2), "r": (1, 4), "s": (None, None)}
    share = {r.z: r.y2 for r in O.stack(df, "x", "v", "z", "row", offset="normalize").collect()}
    assert share["r"] == 1 and share["q"] == 0
    flat = spark.createDataFrame([(i, z, 1.0, 2 * i + k) for i in range(3) for k, z in enumerate("ab")], "x int, z string, v double, row int")
    assert all(r.y1 == k for k, z in enumerate("ab") for r in O.stack(flat, "x", "v", "z", "row", offset="wiggle").filter(F.col("z") == z).collect())


def test_stack_inside_out_and_offset_function(spark):
    peaks = {"a": (9, 1, 1), "b": (1, 8, 1), "c": (1, 1, 7), None: (2, 2, 3)}
    rows = [(x, z, float(h), 10 * x + k) for k, (z, hs) in enumerate(peaks.items()) for x, h in enumerate(hs)]
    df = spark.createDataFrame(rows, "x int, z string, v double, row int")
    got = O.stack(df, "x", "v", "z", "row", order="inside-out").filter("x = 0").orderBy("y1").collect()
    # by peak: a (11) below, b (10) above, c (9) above since 10 < 11, then the null series (7) below
    assert [r.z for r in got] == [None, "a", "b", "c"]
    moved = O.stack(df, "x", "v", "z", "row", offset=lambda d: d.withColumn("y1", F.col("y1") + 1).withColumn("y2", F.col("y2") + 1))
    assert moved.agg(F.min("y1")).first()[0] == 1
    faceted = O.stack(df.withColumn("f", F.lit("q")), "x", "v", "z", "row", ["f"], order="inside-out")
    assert [r.z for r in faceted.filter("x = 0").orderBy("y1").collect()] == [None, "a", "b", "c"]
    assert O.stack(df.limit(0), "x", "v", "z", "row", order="inside-out").count() == 0


def test_intervals(spark):
    at = lambda e: spark.sql("SELECT timestamp'2024-01-31 10:20:30' AS t").select(e(F.col("t")).cast("string").alias("v")).first().v
    assert at(parse_interval("month").offset) == "2024-03-02 10:20:30"
    assert at(parse_interval("3 months").floor) == "2024-01-01 00:00:00"
    assert at(parse_interval("week").floor) == "2024-01-29 00:00:00"
    assert guess_interval(86_400_000 * 7).unit == "week"
    with pytest.raises(ValueError):
        parse_interval("fortnight")
    with pytest.raises(ValueError):
        parse_interval(0)


def test_gap_filling_and_median_step(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0, 0), ("a", 0.4, 9.0, 1), ("a", 3.0, 4.0, 2)], "z string, x double, y double, o int")
    got = O.fill_interval(df, "x", "y", 1, ["z"], "o", "first", "linear").orderBy("x").collect()
    assert [(r.x, r.y, r.missing) for r in got] == [(0, 1, False), (1, 2, True), (2, 3, True), (3, 4, False)]
    assert O.median_step(df, "x") == 2.6


def test_difference_and_crossings(spark):
    a, b = series(spark, [0, 2, 4]), spark.createDataFrame([(1, 0, 1.0), (1, 2, 1.0)], "z int, x int, y double")
    got = O.difference(a, b, "x", "y", ["z"])
    assert column(got, "other_y") == [1, 1, 1]
    assert [r.x for r in O.crossings(got, "x", "gap", ["z"]).collect()] == [0.5]


def test_groups_and_reducers(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", float("nan"), 1), ("b", 2.0, 2), (None, 5.0, 3)], "k string, v double, o int")
    got = {r.k: r for r in O.group_by(df, ["k"], {"n": ("count", "v"), "rows": ("count", None), "s": ("sum", "v"), "i": ("max-index", "v"), "sq": (lambda c: F.sum(c * c), "v")}, "o").collect()}
    assert set(got) == {"a", "b"} and got["a"].n == 1 and got["a"].rows == 2 and got["b"].i == 2
    share = {r.k: r.proportion for r in O.proportion(df, ["k"], "v").collect()}
    assert math.isclose(share["b"], 2 / 8)
    assert [r.k for r in O.top_categories(df, "k", "v", "sum", limit=-1).collect()] == ["a"]
    assert O.complete_grid(spark.createDataFrame([("a", 1, 2), ("b", 2, 3)], "p string, q int, n int"), ["p", "q"], {"n": 0}).count() == 4


def test_sort_puts_missing_first_when_descending(spark):
    df = series(spark, [1, None, 3])
    assert [r.y for r in O.sort_rows(df, "-y", "x").collect()] == [None, 3, 1]
    assert [r.y for r in O.filter_rows(df, "y").collect()] == [1, 3]


def test_plot_and_helpers(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "k string, v double")
    chart = plot(df, {"x": "k", "y": "v", "reduce": "sum"})
    assert chart.spec["mark"] == "barY" and chart.scales["y"]["domain"] == [0, 4]
    assert len(chart.option()["series"][0]["data"]) == 2
    with pytest.raises(ValueError):
        chart.option(limit=1)
    assert is_monotonic(series(spark, [1, 2, 2]), "y", "x") and not is_monotonic(series(spark, [1, 2, 1]), "y", "x")
    assert (format_value(1234.6), format_value(12.345), format_value(0.12345)) == ("1235", "12.3", "0.123")
    assert radius_scale(4, 4) == 9 and color_stops(["#000000", "#ffffff"], 0.5) == "#808080"
    assert "plot(" in spec_to_code({"mark": "dot"})
    assert inspect_fields(df)[0] == {"name": "k", "type": "ordinal", "values": ["a", "b"]}


def test_stream_bins(spark, tmp_path):
    from tessella.streaming import windowed_reduce

    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 2.0D AS v UNION ALL SELECT timestamp'2024-01-01 00:20:00', 3.0D UNION ALL SELECT timestamp'2024-01-02 00:00:00', 1.0D").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "in"))
    out = windowed_reduce(stream, "ts", "1 hour", {"s": ("sum", "v")})
    q = out.writeStream.format("memory").queryName("bins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.s for r in spark.table("bins").orderBy("x1").collect()] == [5, 1]
