"""The registry, and a sample of its queries against SQL at the smallest scale."""

import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
DATA = "/root/testdata/sf0.001"

import __spark_entry__ as entry_points
from check import TABLES, compare

SAMPLE = [
    "latest_row", "latest_date_rows", "new_or_changed_rows", "vintage_refresh", "gap_fill_controlled", "rebase_100",
    "run_monthly", "total_return", "select_n", "er_ewma", "cov_sample", "m_limit_weights", "nav", "perf_stats",
    "stream_dedup",
]


def test_every_sql_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    base = duckdb.connect()
    base.execute("SET TimeZone='UTC'")
    for table in TABLES:
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = entry_points.queries()[name](spark, DATA).toArrow()
    want = base.execute(entry_points.oracle_sql()[name]).to_arrow_table()
    assert compare(got, want) == ""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry_runs(spark):
    assert entry_points.entry(spark).count() == 1
