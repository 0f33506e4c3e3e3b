"""Every query with SQL against DuckDB at the smallest size, and the others for a stable schema."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(value):
    return "nan" if value != value else repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    rows = found.collect()
    spark.catalog.clearCache()
    if name not in SQL:
        assert found.columns
        return
    expected = duck.sql(SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_streamed_bars_are_all_bars(spark):
    streamed, whole = (entry.queries()[n](spark, SF).select("ticker", F.col("start").cast("timestamp_ntz"), "open", "high", "low", "close", "ticks") for n in ("stream_tick_bars", "stream_tick_bars_batch"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, whole.collect()))
