"""Registered queries of the transform and insight operators, and the SQL that checks them.

Derived floating values are rounded to six decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import insights as I
from . import operators as O
from .insights.derived import future_x, highlight
from .operators.bins import time_interval
from .operators.group import keep_empty, pearson
from .operators.interval import parse_interval
from .operators.ordered import encode, with_previous
from .plans import plot
from .session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def daily(spark, d) -> DataFrame:
    """Events a day and type: x, z, value (sum)."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("day", "ts").alias("x"), F.col("event_type").alias("z")).agg(F.sum("value").alias("y"))


def monthly(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.date_trunc("month", "o_orderdate").alias("x"), F.col("o_orderpriority").alias("z")).agg(F.sum("o_totalprice").alias("y"))


DAILY = "WITH s AS (SELECT date_trunc('day', ts)::TIMESTAMP AS x, event_type AS z, sum(value) AS y FROM events GROUP BY 1, 2)"
MONTHLY = "WITH s AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS x, o_orderpriority AS z, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2)"


@query("group_sum_mean", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    out = O.group_by(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"sum_qty": ("sum", "l_quantity"), "avg_price": ("mean", "l_extendedprice"), "n": ("count", None)})
    return rounded(out, "sum_qty").withColumn("avg_price", F.round("avg_price", 4))


REDUCERS = {
    "count": "count(o_totalprice)::DOUBLE", "sum": "sum(o_totalprice)", "mean": "avg(o_totalprice)", "median": "quantile_cont(o_totalprice, 0.5)", "min": "min(o_totalprice)", "max": "max(o_totalprice)",
    "first": "arg_min(o_totalprice, o_orderkey)", "last": "arg_max(o_totalprice, o_orderkey)", "variance": "var_samp(o_totalprice)", "deviation": "stddev_samp(o_totalprice)", "distinct": "count(DISTINCT o_totalprice)::DOUBLE",
    "p25": "quantile_cont(o_totalprice, 0.25)", "p90": "quantile_cont(o_totalprice, 0.9)", "min-index": "(SELECT min(q.o_orderkey) FROM orders q WHERE q.o_orderpriority = o.o_orderpriority AND q.o_totalprice = min(o.o_totalprice))::DOUBLE", "max-index": None,
}
for _name, _sql in REDUCERS.items():
    if _name in ("min-index", "max-index"):
        _dir = "ASC" if _name == "min-index" else "DESC"
        _sql = f"SELECT z, y FROM (SELECT o_orderpriority AS z, o_orderkey::DOUBLE AS y, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice {_dir}, o_orderkey) AS r FROM orders) WHERE r = 1"
    else:
        _sql = f"SELECT o_orderpriority AS z, round({_sql}, 2) AS y FROM orders o GROUP BY 1"

    def _one(spark, d, name=_name):
        out = O.group_by(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "z"), ["z"], {"y": (name, "o_totalprice")}, "o_orderkey")
        return out.withColumn("y", F.round(F.col("y").cast("double"), 2))

    query(f"group_{_name.replace('-', '_')}", _sql)(_one)


@query("group_mode", "SELECT z, y FROM (SELECT p_brand AS z, p_size::DOUBLE AS y, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS r FROM part GROUP BY p_brand, p_size) WHERE r = 1")
def _(spark, d):
    return O.group_by(table(spark, d, "part").withColumnRenamed("p_brand", "z"), ["z"], {"y": ("mode", "p_size")})


@query("group_proportion", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS proportion FROM orders GROUP BY 1, 2")
def _(spark, d):
    return rounded(O.proportion(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice"), "proportion")


@query("group_proportion_facet", "SELECT o_orderstatus, o_orderpriority, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS proportion FROM orders GROUP BY 1, 2")
def _(spark, d):
    return rounded(O.proportion(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], None, ["o_orderstatus"]), "proportion")


@query("group_topk_domain", "SELECT p_type, count(*)::DOUBLE AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(spark, d):
    return O.top_categories(table(spark, d, "part"), "p_type", "p_partkey", "count", limit=3).withColumn("value", F.col("value").cast("double"))


@query("filter_truthy_sort", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC")
def _(spark, d):
    return O.sort_rows(O.filter_rows(table(spark, d, "orders"), "o_totalprice > 100000"), "-o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("shuffle_rows", "SELECT o_orderkey FROM orders")
def _(spark, d):
    return O.shuffle_rows(table(spark, d, "orders"), "o_orderkey").select("o_orderkey")


@query("select_last", "SELECT z, x, round(y, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY x DESC) r FROM (" + DAILY + " SELECT * FROM s)) WHERE r = 1")
def _(spark, d):
    return rounded(O.select_last(daily(spark, d), ["z"], "x"), "y")


@query("select_first", "SELECT z, x, round(y, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY x) r FROM (" + DAILY + " SELECT * FROM s)) WHERE r = 1")
def _(spark, d):
    return rounded(O.select_first(daily(spark, d), ["z"], "x"), "y")


for _name, _largest in (("min_y", False), ("max_y", True)):

    def _extreme(spark, d, largest=_largest):
        return rounded(O.select_extreme(daily(spark, d), "y", ["z"], "x", largest), "y")

    query(f"select_{_name}", "SELECT z, x, round(y, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY y " + ("DESC" if _largest else "ASC") + ", x) r FROM (" + DAILY + " SELECT * FROM s)) WHERE r = 1")(_extreme)


@query("bin_interval_count", "SELECT floor(value / 10) * 10 AS x1, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(parse_interval(10).floor(F.col("value")).alias("x1")).agg(F.count("*").alias("n"))


@query("bin_explicit_edges", "SELECT CASE WHEN l_quantity < 10 THEN 0.0 WHEN l_quantity < 20 THEN 10.0 WHEN l_quantity < 35 THEN 20.0 ELSE 35.0 END::DOUBLE AS x1, CASE WHEN l_quantity < 10 THEN 10.0 WHEN l_quantity < 20 THEN 20.0 WHEN l_quantity < 35 THEN 35.0 ELSE 50.0 END::DOUBLE AS x2, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1, 2")
def _(spark, d):
    df = table(spark, d, "lineitem")
    return O.bin_by(df, "l_quantity", O.bin_edges(df, "l_quantity", [0, 10, 20, 35, 50]), {"n": ("count", None)}).select("x1", "x2", "n")


BINNED = """WITH st AS (SELECT min({v}) lo, max({v}) hi, count({v}) n, stddev_samp({v}) sd, quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) iqr FROM {t}),
c AS (SELECT *, {count} AS k FROM st), p AS (SELECT *, power(10.0::DOUBLE, floor(log10((hi - lo) / k))) AS pw FROM c),
w AS (SELECT *, pw * CASE WHEN (hi - lo) / k / pw >= sqrt(50) THEN 10 WHEN (hi - lo) / k / pw >= sqrt(10) THEN 5 WHEN (hi - lo) / k / pw >= sqrt(2) THEN 2 ELSE 1 END AS step FROM p)
SELECT floor({v} / step) * step AS x1, count(*) AS n FROM {t}, w GROUP BY 1"""
for _name, _rule, _t, _v, _count in (
    ("bin_auto_scott", "auto", "lineitem", "l_extendedprice", "least(200, ceil((hi - lo) / (3.49 * sd * power(n, -1.0 / 3))))"),
    ("bin_scott", "scott", "lineitem", "l_extendedprice", "ceil((hi - lo) / (3.49 * sd * power(n, -1.0 / 3)))"),
    ("bin_sturges", "sturges", "orders", "o_totalprice", "ceil(log2(n)) + 1"),
    ("bin_fd", "fd", "orders", "o_totalprice", "ceil((hi - lo) / (2 * iqr * power(n, -1.0 / 3)))"),
    ("bin_count_hint", 12, "orders", "o_totalprice", "12"),
):

    def _binned(spark, d, rule=_rule, t=_t, v=_v):
        df = table(spark, d, t)
        return O.bin_by(df, v, O.bin_edges(df, v, rule), {"n": ("count", None)}).select("x1", "n")

    query(_name, BINNED.format(v=_v, t=_t, count=_count))(_binned)

for _unit in ("month", "week", "quarter", "year", "day"):

    def _calendar(spark, d, unit=_unit):
        return rounded(table(spark, d, "orders").groupBy(parse_interval(unit).floor(F.col("o_orderdate")).alias("x1")).agg(F.sum("o_totalprice").alias("y"), F.count("*").alias("n")), "y").withColumn("y", F.round("y", 2))

    query(f"bin_{_unit}_sum", f"SELECT date_trunc('{_unit}', o_orderdate)::TIMESTAMP AS x1, round(sum(o_totalprice), 2) AS y, count(*) AS n FROM orders GROUP BY 1")(_calendar)


@query("bin_6hour_count", "SELECT make_timestamp((epoch_ms(ts) // 21600000) * 21600000 * 1000) AS x1, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(parse_interval("6 hours").floor(F.col("ts")).alias("x1")).agg(F.count("*").alias("n"))


for _desc in (False, True):

    def _cumulative(spark, d, desc=_desc):
        df = table(spark, d, "part")
        counts = O.bin_by(df, "p_size", O.bin_edges(df, "p_size", list(range(0, 61, 10))), {"n": ("count", None)}).select(F.lit(1).alias("all"), "x1", "n")
        return O.cumulative_bins(counts, ["all"], "x1", "n", desc).select("x1", "n")

    query("bin_cumulative" + "_desc" * _desc, "SELECT x1, sum(n) OVER (ORDER BY x1 " + ("DESC" if _desc else "ASC") + ")::BIGINT AS n FROM (SELECT (floor(p_size / 10.0) * 10)::DOUBLE AS x1, count(*) AS n FROM part GROUP BY 1)")(_cumulative)


@query("bin_keep_empty", "WITH g AS (SELECT (floor(p_retailprice / 100) * 100)::DOUBLE AS x1, p_brand, count(*) AS n FROM part GROUP BY 1, 2) SELECT a.x1, b.p_brand, coalesce(g.n, 0) AS n FROM (SELECT DISTINCT x1 FROM g) a CROSS JOIN (SELECT DISTINCT p_brand FROM g) b LEFT JOIN g ON g.x1 = a.x1 AND g.p_brand = b.p_brand")
def _(spark, d):
    g = table(spark, d, "part").groupBy(parse_interval(100).floor(F.col("p_retailprice")).cast("double").alias("x1"), "p_brand").agg(F.count("*").alias("n"))
    return O.complete_grid(g, ["x1", "p_brand"], {"n": 0})


@query("bin_2d", "SELECT (floor(l_quantity / 5) * 5)::DOUBLE AS x1, (floor(l_discount / 0.02) * 0.02)::DOUBLE AS y1, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(parse_interval(5).floor(F.col("l_quantity")).alias("x1"), parse_interval(0.02).floor(F.col("l_discount")).alias("y1")).agg(F.count("*").alias("n"))


@query("group_2d_heatmap", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return O.group_by(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": ("count", None)})


ROLL = {
    "mean_end": (dict(k=7, reducer="mean", anchor="end"), "avg(y) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"),
    "mean_middle_even": (dict(k=4, reducer="mean", anchor="middle"), "avg(y) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)"),
    "sum_start": (dict(k=3, reducer="sum", anchor="start"), "sum(y) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"),
    "median": (dict(k=5, reducer="median"), "quantile_cont(y, 0.5) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "p90": (dict(k=5, reducer="p90"), "quantile_cont(y, 0.9) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "min": (dict(k=5, reducer="min"), "min(y) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "max": (dict(k=5, reducer="max"), "max(y) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "deviation": (dict(k=5, reducer="deviation"), "stddev_samp(y) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "difference": (dict(k=5, reducer="difference"), "last_value(y) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - first_value(y) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "ratio": (dict(k=5, reducer="ratio"), "last_value(y) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / first_value(y) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "strict": (dict(k=7, reducer="mean", anchor="end", strict=True), "CASE WHEN count(y) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7 THEN avg(y) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END"),
    "function": (dict(k=3, reducer=lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)), "sum(y * y) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"),
}
for _name, (_options, _sql) in ROLL.items():

    def _roll(spark, d, options=_options):
        return O.rolling(daily(spark, d), "y", by=["z"], order="x", **options).withColumn("y", F.round("y", 4))

    query(f"window_{_name}", f"{DAILY} SELECT x, z, round({_sql}, 4) AS y FROM s")(_roll)

W_ = "OVER (PARTITION BY z ORDER BY x)"
ALL = "OVER (PARTITION BY z)"
MAPS = {
    "map_cumsum": (lambda s: O.cumsum(s, "y", ["z"]), f"sum(y) OVER (PARTITION BY z ORDER BY x ROWS UNBOUNDED PRECEDING)"),
    "map_rank": (lambda s: O.rank(s, "y", ["z"]), "(rank() OVER (PARTITION BY z ORDER BY y) - 1)::DOUBLE"),
    "map_quantile": (lambda s: O.quantile_rank(s, "y", ["z"]), f"(rank() OVER (PARTITION BY z ORDER BY y) - 1)::DOUBLE / greatest(count(y) {ALL} - 1, 1)"),
    "map_diff": (lambda s: O.diff(s, "y", ["z"]), f"y - lag(y) {W_}"),
    "map_pct_change": (lambda s: O.pct_change(s, "y", ["z"]), f"(y - lag(y) {W_}) / nullif(abs(lag(y) {W_}), 0)"),
    "normalize_first": (lambda s: O.normalize(s, "y", "first", ["z"]), f"y / first_value(y) {W_}"),
    "normalize_last": (lambda s: O.normalize(s, "y", "last", ["z"]), "y / last_value(y) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "normalize_mean": (lambda s: O.normalize(s, "y", "mean", ["z"]), f"y / avg(y) {ALL}"),
    "normalize_median": (lambda s: O.normalize(s, "y", "median", ["z"]), f"y / quantile_cont(y, 0.5) {ALL}"),
    "normalize_sum": (lambda s: O.normalize(s, "y", "sum", ["z"]), f"y / sum(y) {ALL}"),
    "normalize_extent": (lambda s: O.normalize(s, "y", "extent", ["z"]), f"(y - min(y) {ALL}) / (max(y) {ALL} - min(y) {ALL})"),
    "normalize_deviation": (lambda s: O.normalize(s, "y", "deviation", ["z"]), f"(y - avg(y) {ALL}) / stddev_samp(y) {ALL}"),
}
for _name, (_f, _sql) in MAPS.items():

    def _mapped(spark, d, f=_f):
        return f(monthly(spark, d)).withColumn("y", F.round("y", 4))

    query(_name, f"{MONTHLY} SELECT x, z, round({_sql}, 4) AS y FROM s")(_mapped)

GAPS = """WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS x, sum(value) AS y FROM events WHERE event_type = 'purchase' GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(x) FROM h), (SELECT max(x) FROM h), INTERVAL 1 HOUR)) AS x),
s AS (SELECT g.x, h.y, row_number() OVER (ORDER BY g.x) AS p FROM g LEFT JOIN h ON g.x = h.x)"""
FILLS = {
    "zero": "coalesce(y, 0)",
    "previous": "last_value(y IGNORE NULLS) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING)",
    "next": "first_value(y IGNORE NULLS) OVER (ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "linear": "coalesce(y, a.v + (b.v - a.v) * (p - a.p) / (b.p - a.p))",
}
for _name, _sql in FILLS.items():

    def _filled(spark, d, how=_name):
        e = table(spark, d, "events").filter("event_type = 'purchase'").withColumn("z", F.lit(1))
        out = O.fill_interval(e, "ts", "value", "hour", ["z"], "event_id", "sum", how)
        return out.select(F.col("ts").alias("x"), F.round("value", 4).alias("y"))

    _from = "s" if _name != "linear" else "(SELECT x, y, p, last_value(CASE WHEN y IS NOT NULL THEN {'p': p, 'v': y} END IGNORE NULLS) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS a, first_value(CASE WHEN y IS NOT NULL THEN {'p': p, 'v': y} END IGNORE NULLS) OVER (ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM s)"
    query(f"impute_{_name}", f"{GAPS} SELECT x, round({_sql}, 4) AS y FROM {_from}")(_filled)


@query("interval_fill", GAPS + " SELECT x, round(y, 4) AS y, y IS NULL AS missing FROM s")
def _(spark, d):
    e = table(spark, d, "events").filter("event_type = 'purchase'").withColumn("z", F.lit(1))
    return O.fill_interval(e, "ts", "value", "hour", ["z"], "event_id", "sum").select(F.col("ts").alias("x"), F.round("value", 4).alias("y"), "missing")


@query("shift_month", MONTHLY + " SELECT x + INTERVAL 1 MONTH AS x1, x AS x2, z, round(y, 2) AS y FROM s")
def _(spark, d):
    return O.shift_x(monthly(spark, d), "x", "+1 month").select("x1", "x2", "z", F.round("y", 2).alias("y"))


PRIOR = "(SELECT arg_{m}({{'x': b.x, 'y': b.y}}, b.x) FROM b WHERE b.z = a.z AND b.x {c} a.x)"


@query("difference_yoy", MONTHLY + ", b AS (SELECT x + INTERVAL 1 YEAR AS x, z, y FROM s), n AS (SELECT x, z, y, " + PRIOR.format(m="max", c="<=") + " AS p, " + PRIOR.format(m="min", c=">=") + " AS q FROM s a) SELECT x, z, round(y, 2) AS y, round(CASE WHEN p.x = q.x THEN p.y ELSE p.y + (q.y - p.y) * (epoch(x) - epoch(p.x)) / (epoch(q.x) - epoch(p.x)) END, 4) AS other_y FROM n")
def _(spark, d):
    m = monthly(spark, d)
    before = O.shift_x(m, "x", "+1 year").select(F.col("x1").alias("x"), "z", "y")
    out = O.difference(m, before, "x", "y", ["z"])
    return out.select("x", "z", F.round("y", 2).alias("y"), F.round("other_y", 4).alias("other_y"))


STACKS = {
    "zero": ({}, "below", "below + y"),
    "normalize": ({"offset": "normalize"}, "below / total", "(below + y) / total"),
    "center": ({"offset": "center"}, "below - total / 2", "below + y - total / 2"),
}
for _name, (_options, _a, _b) in STACKS.items():

    def _stacked(spark, d, options=_options):
        m = monthly(spark, d).withColumn("row", F.substring("z", 1, 1).cast("int"))
        out = O.stack(m.withColumnRenamed("y", "v"), "x", "v", "z", "row", **options)
        return out.select("x", "z", F.round("y1", 4).alias("y1"), F.round("y2", 4).alias("y2"))

    query(f"stack_{_name}", f"{MONTHLY}, t AS (SELECT *, coalesce(sum(y) OVER (PARTITION BY x ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(y) OVER (PARTITION BY x) AS total FROM s) SELECT x, z, round({_a}, 4) AS y1, round({_b}, 4) AS y2 FROM t")(_stacked)


@query("stack_order_sum", MONTHLY + ", t AS (SELECT *, sum(y) OVER (PARTITION BY z) AS k FROM s) SELECT x, z, round(coalesce(sum(y) OVER (PARTITION BY x ORDER BY k, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS y1 FROM t")
def _(spark, d):
    m = monthly(spark, d).withColumn("row", F.substring("z", 1, 1).cast("int")).withColumnRenamed("y", "v")
    return O.stack(m, "x", "v", "z", "row", order="sum").select("x", "z", F.round("y1", 2).alias("y1"))


@query("stack_diverging", "WITH s AS (SELECT c_mktsegment AS x, c_nationkey AS z, sum(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE -c_acctbal END) AS v FROM customer GROUP BY 1, 2) SELECT x, z, round(coalesce(sum(v) OVER (PARTITION BY x, v < 0 ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS y1 FROM s")
def _(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("x"), F.col("c_nationkey").alias("z")).agg(F.sum(F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).otherwise(-F.col("c_acctbal"))).alias("v"))
    return O.stack(c, "x", "v", "z", "z").select("x", "z", F.round("y1", 2).alias("y1"))


@query("stack_wiggle")
def _(spark, d):
    m = monthly(spark, d).withColumnRenamed("y", "v").withColumn("row", F.unix_seconds("x") * 10 + F.substring("z", 1, 1).cast("int"))
    return O.stack(m, "x", "v", "z", "row", offset="wiggle").select("x", "z", F.round("y1", 2).alias("y1"), F.round("y2", 2).alias("y2"))


@query("facet_extent", "SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("align_series", DAILY + " SELECT a.x, b.z, round(s.y, 4) AS y FROM (SELECT DISTINCT x FROM s) a CROSS JOIN (SELECT DISTINCT z FROM s) b LEFT JOIN s ON s.x = a.x AND s.z = b.z")
def _(spark, d):
    return O.align_series(daily(spark, d), "x", "z").select("x", "z", F.round("y", 4).alias("y"))


@query("anomaly_zscore", DAILY + " SELECT x, z, round(abs(y - avg(y) OVER (PARTITION BY z)) / stddev_samp(y) OVER (PARTITION BY z), 6) AS score, abs(y - avg(y) OVER (PARTITION BY z)) / stddev_samp(y) OVER (PARTITION BY z) > 3 AS is_anomaly FROM s")
def _(spark, d):
    return rounded(I.anomalies(daily(spark, d), "y", ["z"], "x", "zscore").select("x", "z", "score", "is_anomaly"), "score")


@query("anomaly_iqr", DAILY + ", q AS (SELECT z, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM s GROUP BY 1) SELECT x, s.z, round(greatest(a - y, y - b, 0) / (b - a), 6) AS score, (y < a - 1.5 * (b - a) OR y > b + 1.5 * (b - a)) AS is_anomaly FROM s JOIN q ON s.z = q.z")
def _(spark, d):
    return rounded(I.anomalies(daily(spark, d), "y", ["z"], "x", "iqr").select("x", "z", "score", "is_anomaly"), "score")


for _name in ("mad", "seasonal", "ewma"):

    def _anomaly(spark, d, how=_name):
        return rounded(I.anomalies(daily(spark, d), "y", ["z"], "x", how), "score", "lower", "upper")

    query(f"anomaly_{_name}")(_anomaly)


@query("trend_ols", DAILY + ", n AS (SELECT z, y, epoch(x) / 86400.0 - 19723 AS t FROM s) SELECT z, round(regr_slope(y, t), 4) AS slope, round(regr_intercept(y, t), 2) AS intercept, round(regr_r2(y, t), 4) AS r2, count(*) AS n FROM n GROUP BY 1")
def _(spark, d):
    s = daily(spark, d).withColumn("t", F.unix_seconds("x") / 86400.0 - 19723)
    out = I.trend(s, "t", "y", ["z"])
    return out.select("z", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 4).alias("r2"), "n")


@query("trend_theil_sen", DAILY + ", n AS (SELECT z, y, epoch(x) / 86400.0 - 19723 AS t FROM s), m AS (SELECT a.z, quantile_cont((b.y - a.y) / (b.t - a.t), 0.5) AS slope FROM n a JOIN n b ON a.z = b.z AND a.t < b.t GROUP BY 1) SELECT n.z, round(any_value(slope), 4) AS slope, round(quantile_cont(y - slope * t, 0.5), 2) AS intercept FROM n JOIN m ON n.z = m.z GROUP BY 1")
def _(spark, d):
    s = daily(spark, d).withColumn("t", F.unix_seconds("x") / 86400.0 - 19723)
    return I.trend(s, "t", "y", ["z"], "theil-sen").select("z", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("autocorrelation", DAILY + ", c AS (SELECT z, x, y - avg(y) OVER (PARTITION BY z) AS d FROM s), l AS (SELECT z, k AS lag, d, lag(d, k::INT) OVER (PARTITION BY z, k ORDER BY x) AS e FROM c, (SELECT unnest(generate_series(1, 7))::INT AS k)) SELECT z, lag, round(sum(d * e) / sum(d * d), 6) AS acf FROM l GROUP BY 1, 2")
def _(spark, d):
    return rounded(I.autocorrelation(daily(spark, d), "y", ["z"], "x", 7), "acf")


@query("forecast_naive", DAILY + ", p AS (SELECT z, arg_max(y, x) AS point FROM s GROUP BY 1) SELECT z, step, round(point, 4) AS point FROM p, (SELECT unnest(generate_series(1, 5))::INT AS step)")
def _(spark, d):
    return I.forecast(daily(spark, d), "y", ["z"], "x", 5, "naive").select("z", "step", F.round("point", 4).alias("point"))


@query("forecast_drift", DAILY + ", p AS (SELECT z, arg_max(y, x) AS b, arg_min(y, x) AS a, count(*) AS n FROM s GROUP BY 1) SELECT z, step, round(b + step * (b - a) / (n - 1), 4) AS point FROM p, (SELECT unnest(generate_series(1, 5))::INT AS step)")
def _(spark, d):
    return I.forecast(daily(spark, d), "y", ["z"], "x", 5, "drift").select("z", "step", F.round("point", 4).alias("point"))


for _name, _options in (("holt", {"method": "holt"}), ("hw", {"method": "hw", "period": 7}), ("auto", {})):

    def _forecast(spark, d, options=_options):
        return rounded(I.forecast(daily(spark, d), "y", ["z"], "x", 5, **options), "point", "lower", "upper")

    query(f"forecast_{_name}")(_forecast)


@query("changepoint_binseg")
def _(spark, d):
    return rounded(I.changepoints(daily(spark, d), "y", ["z"], "x"), "mean")


@query("seasonality_acf")
def _(spark, d):
    return rounded(I.seasonality(daily(spark, d), "y", ["z"], "x", unit="day"), "strength")


@query("decompose_weekly")
def _(spark, d):
    return rounded(I.decompose_series(daily(spark, d), "y", ["z"], "x", 7), "trend", "seasonal", "remainder")


@query("frequency_outliers", "WITH c AS (SELECT user_id, count(*)::DOUBLE AS count FROM events GROUP BY 1), l AS (SELECT *, ln(count + 1) AS v FROM c), m AS (SELECT quantile_cont(v, 0.5) AS m FROM l), q AS (SELECT quantile_cont(abs(v - m), 0.5) AS mad, avg(abs(v - m)) AS aad FROM l, m) SELECT user_id, count, round(CASE WHEN mad > 0 THEN (v - m) / (1.4826 * mad) WHEN aad > 0 THEN (v - m) / (1.2533 * aad) ELSE 0 END, 6) AS score FROM l, m, q")
def _(spark, d):
    return rounded(I.frequency_outliers(table(spark, d, "events"), "user_id").select("user_id", "count", "score"), "score")


@query("category_outliers", "WITH c AS (SELECT c_nationkey, quantile_cont(c_acctbal, 0.5) AS value FROM customer GROUP BY 1), m AS (SELECT quantile_cont(value, 0.5) AS m FROM c), q AS (SELECT quantile_cont(abs(value - m), 0.5) AS mad FROM c, m) SELECT c_nationkey, round(value, 6) AS value, round((value - m) / (1.4826 * mad), 6) AS score, abs((value - m) / (1.4826 * mad)) > 3 AS is_outlier FROM c, m, q")
def _(spark, d):
    return rounded(I.category_outliers(table(spark, d, "customer"), "c_nationkey", "c_acctbal"), "value", "score")


@query("within_category_outliers", "WITH m AS (SELECT c_nationkey AS k, quantile_cont(c_acctbal, 0.5) AS m FROM customer GROUP BY 1), q AS (SELECT k, any_value(m) AS m, quantile_cont(abs(c_acctbal - m), 0.5) AS mad, count(*) AS n FROM customer JOIN m ON k = c_nationkey GROUP BY 1) SELECT c_custkey, CASE WHEN n >= 4 THEN round(abs(c_acctbal - m) / (1.4826 * mad), 6) END AS score FROM customer JOIN q ON k = c_nationkey")
def _(spark, d):
    return rounded(I.within_category(table(spark, d, "customer"), "c_acctbal", ["c_nationkey"]).select("c_custkey", "score"), "score")


@query("series_outliers", DAILY + ", m AS (SELECT x, quantile_cont(y, 0.5) AS m, count(*) AS n FROM s GROUP BY 1), q AS (SELECT s.x, any_value(m) AS m, any_value(n) AS n, quantile_cont(abs(y - m), 0.5) AS mad, avg(abs(y - m)) * 0.5 AS aad FROM s JOIN m ON s.x = m.x GROUP BY 1), v AS (SELECT z, CASE WHEN n >= 3 AND greatest(mad, aad) > 0 THEN least(1.0, abs(y - m) / (4.0 * CASE WHEN mad > 0 THEN mad ELSE aad END)) ELSE 0.0 END AS score FROM s JOIN q ON s.x = q.x) SELECT z, round(avg(score), 6) AS mean_score FROM v GROUP BY 1")
def _(spark, d):
    return rounded(I.series_outliers(daily(spark, d), "x", "z", "y").select("z", "mean_score"), "mean_score")


@query("spec_monthly_bars", MONTHLY + " SELECT x AS o_orderdate, z AS o_orderpriority, round(y, 2) AS o_totalprice FROM s")
def _(spark, d):
    chart = plot(table(spark, d, "orders"), {"mark": "lineY", "x": "o_orderdate", "y": "o_totalprice", "color": "o_orderpriority", "reduce": "sum", "interval": "month"}, "o_orderkey")
    return chart.data.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("stack_inside_out")
def _(spark, d):
    m = monthly(spark, d).withColumnRenamed("y", "v").withColumn("row", F.unix_seconds("x") * 10 + F.substring("z", 1, 1).cast("int"))
    return O.stack(m, "x", "v", "z", "row", order="inside-out").select("x", "z", F.round("y1", 2).alias("y1"), F.round("y2", 2).alias("y2"))


@query("stack_offset_function", MONTHLY + ", t AS (SELECT *, coalesce(sum(y) OVER (PARTITION BY x ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(y) OVER (PARTITION BY x) AS total FROM s) SELECT x, z, round(below - total, 2) AS y1, round(below + y - total, 2) AS y2 FROM t")
def _(spark, d):
    def hang(rows: DataFrame) -> DataFrame:
        top = F.max("y2").over(W.partitionBy("x"))
        return rows.withColumn("top", top).withColumns({"y1": F.col("y1") - F.col("top"), "y2": F.col("y2") - F.col("top")}).drop("top")

    m = monthly(spark, d).withColumn("row", F.substring("z", 1, 1).cast("int")).withColumnRenamed("y", "v")
    return O.stack(m, "x", "v", "z", "row", offset=hang).select("x", "z", F.round("y1", 2).alias("y1"), F.round("y2", 2).alias("y2"))


@query("series_outliers_dbscan", DAILY + ", m AS (SELECT *, quantile_cont(y, 0.5) OVER (PARTITION BY x) AS m, count(*) OVER (PARTITION BY x) AS n FROM s), d AS (SELECT *, quantile_cont(abs(y - m), 0.5) OVER (PARTITION BY x) AS mad, avg(abs(y - m)) OVER (PARTITION BY x) * 0.5 AS aad FROM m), e AS (SELECT *, CASE WHEN mad > 0 THEN mad ELSE aad END AS s, y - lag(y) OVER (PARTITION BY x ORDER BY y, z) AS gap FROM d), c AS (SELECT *, sum(CASE WHEN gap > 4 * s THEN 1 ELSE 0 END) OVER (PARTITION BY x ORDER BY y, z) AS c FROM e), k AS (SELECT *, count(*) OVER (PARTITION BY x, c) AS size FROM c), b AS (SELECT *, max(size) OVER (PARTITION BY x) AS big FROM k) SELECT z, round(avg(CASE WHEN n >= 3 AND s > 0 AND big * 2 > n AND size * 2 <= n THEN 1.0 ELSE 0.0 END), 6) AS mean_score FROM b GROUP BY 1")
def _(spark, d):
    return rounded(I.series_outliers(daily(spark, d), "x", "z", "y", method="dbscan").select("z", "mean_score"), "mean_score")


for _name in ("periodogram", "auto"):

    def _season(spark, d, how=_name):
        return rounded(I.seasonality(daily(spark, d), "y", ["z"], "x", unit="day", method=how), "strength")

    query(f"seasonality_{_name}")(_season)


@query("changepoint_normal_gamma")
def _(spark, d):
    return rounded(I.changepoints(daily(spark, d), "y", ["z"], "x", method="normal-gamma"), "mean")


for _name, _sql in (("median", "quantile_cont(p_retailprice, 0.5)"), ("distinct", "count(DISTINCT p_retailprice)::DOUBLE")):

    def _cumulative_values(spark, d, how=_name):
        df = table(spark, d, "part")
        return O.cumulative_reduce(df, ["p_brand"], "p_retailprice", "p_size", O.bin_edges(df, "p_size", list(range(0, 61, 10))), how).withColumn("y", F.round("y", 4))

    query(f"bin_cumulative_{_name}", f"SELECT b.p_brand, b.x1, round({_sql}, 4) AS y FROM (SELECT DISTINCT p_brand, (floor(p_size / 10.0) * 10)::DOUBLE AS x1 FROM part) b JOIN part p ON p.p_brand = b.p_brand AND floor(p_size / 10.0) * 10 <= b.x1 GROUP BY 1, 2")(_cumulative_values)


@query("encode_first_appearance", "WITH f AS (SELECT o_orderpriority AS k, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1) SELECT o_orderkey, code::INT AS code FROM orders JOIN f ON o_orderpriority = k")
def _(spark, d):
    return encode(table(spark, d, "orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", "code")


@query("pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(table(spark, d, "lineitem").groupBy("l_returnflag").agg(pearson("l_quantity", "l_extendedprice").alias("r")), "r")


@query("bin_keep_all_bins", "WITH g AS (SELECT i * 10 AS x1, s.p_brand FROM generate_series(0, 9) t(i), (SELECT DISTINCT p_brand FROM part) s), c AS (SELECT least(floor(p_size / 10), 9) * 10 AS x1, p_brand, count(*) AS n FROM part WHERE p_size BETWEEN 0 AND 100 GROUP BY 1, 2) SELECT g.x1::DOUBLE AS x1, (g.x1 + 10)::DOUBLE AS x2, (g.x1 + 5)::DOUBLE AS x, g.p_brand, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.x1 = c.x1 AND g.p_brand = c.p_brand")
def _(spark, d):
    bins = O.Bins(tuple(float(i * 10) for i in range(11)))
    return keep_empty(O.bin_by(table(spark, d, "part"), "p_size", bins, {"n": ("count", None)}, ["p_brand"]), bins, ["p_brand"], {"n": 0})


@query("bin_time_automatic", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS x, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(time_interval(o, "o_orderdate", 80).floor(F.col("o_orderdate")).alias("x")).agg(F.count("*").alias("n"))


@query("previous_value", "SELECT event_id, round(value - lag(value) OVER (ORDER BY event_id), 6) AS change FROM events")
def _(spark, d):
    e = with_previous(table(spark, d, "events"), "event_id", F.col("value"), rows=1000)
    return rounded(e.select("event_id", (F.col("value") - F.col("previous")).alias("change")), "change")


@query("median_step", "WITH g AS (SELECT x - lag(x) OVER (ORDER BY x) AS gap FROM (SELECT DISTINCT o_totalprice AS x FROM orders)), r AS (SELECT gap, row_number() OVER (ORDER BY gap) AS i, count(*) OVER () AS n FROM g WHERE gap > 0) SELECT round(gap, 6) AS step FROM r WHERE i = n // 2 + 1")
def _(spark, d):
    step = O.interval.median_step(table(spark, d, "orders").select(F.col("o_totalprice").alias("x")).distinct(), "x")
    return rounded(spark.createDataFrame([(step,)], "step double"), "step")


@query("forecast_future_x", DAILY + " SELECT z, step, max(x) + INTERVAL (step) DAY AS x FROM s, (SELECT unnest(generate_series(1, 3))::INT AS step) GROUP BY z, step")
def _(spark, d):
    s = daily(spark, d)
    return future_x(s, "x", I.forecast(s, "y", ["z"], "x", horizon=3, method="naive"), ["z"]).select("z", "step", "x")


@query("highlight_anomalies", DAILY + ", q AS (SELECT z, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM s GROUP BY 1) SELECT x, s.z, round(y, 4) AS y, (y < a - 1.5 * (b - a) OR y > b + 1.5 * (b - a)) AS highlight FROM s JOIN q ON s.z = q.z")
def _(spark, d):
    s = daily(spark, d)
    return highlight(s, I.anomalies(s, "y", ["z"], "x", method="iqr"), ["z", "x"]).select("x", "z", F.round("y", 4).alias("y"), "highlight")


@query("stack_wiggle_whole", "WITH s AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS x, o_orderstatus AS z, round(sum(o_totalprice)) AS v FROM orders GROUP BY 1, 2), f AS (SELECT *, dense_rank() OVER (ORDER BY x) AS n FROM s), b AS (SELECT *, CASE WHEN lag(n) OVER (PARTITION BY z ORDER BY n) = n - 1 THEN lag(v) OVER (PARTITION BY z ORDER BY n) ELSE v END AS p FROM f), m AS (SELECT *, coalesce(sum(v - p) OVER (PARTITION BY x ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b), t AS (SELECT n, CASE WHEN n > 1 THEN -sum((below + (v - p) / 2) * v) / sum(v) ELSE 0 END AS step FROM m GROUP BY n), k AS (SELECT n, sum(step) OVER (ORDER BY n) AS shift FROM t) SELECT x, z, round(shift + sum(v) OVER (PARTITION BY x ORDER BY z), 3) AS y2 FROM f JOIN k ON f.n = k.n")
def _(spark, d):
    o = table(spark, d, "orders")
    s = o.groupBy(F.date_trunc("month", "o_orderdate").alias("x"), F.col("o_orderstatus").alias("z")).agg(F.round(F.sum("o_totalprice")).alias("v")).withColumn("row", F.struct("x", "z"))
    return O.stack(s, "x", "v", "z", "row", offset="wiggle").select("x", "z", F.round("y2", 3).alias("y2"))
