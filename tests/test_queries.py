import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CHECKED = ["bin_auto_scott", "group_median", "group_min_index", "window_p90", "map_quantile", "impute_linear", "difference_yoy", "stack_normalize", "anomaly_iqr", "trend_theil_sen", "series_outliers", "series_outliers_dbscan", "stack_offset_function", "bin_cumulative_median", "bin_cumulative_distinct"]


def cells(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(["~" if v is None or v != v else round(v, 3) + 0.0 if isinstance(v, float) else str(v) for v in r]) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert cells(entry.queries()[name](spark, DATA).toPandas()) == cells(con.execute(entry.oracle_sql()[name]).df())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert math.inf > len(entry.queries()) > 90
