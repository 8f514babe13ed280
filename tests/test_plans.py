"""What the physical plans must and must not contain."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from helpers import panel
from tickloom import workload
from tickloom.operators import accounting, panels, snapshots
from tickloom.operators import calendar as C
from tickloom.sources import tables
from tickloom.sources.catalog import MarketTables

DATA = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_read_filters_reach_the_scan(spark, tmp_path):
    rows = spark.range(1000).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("DATE"),
        F.concat(F.lit("U"), F.col("id") % 20).alias("TICKER"),
        F.col("id").cast("double").alias("ADJ_CLOSE"),
        F.lit("x").alias("WIDE"),
    )
    rows.write.parquet(str(tmp_path / "prices.parquet"))
    source = MarketTables(spark, base=str(tmp_path))
    df = tables.get_prices(source, ["u1", "U2"], None, "2024-01-10", "2024-01-20").select("DATE", "ADJ_CLOSE")
    text = plan_of(df)
    assert "In(TICKER, [U1,U2])" in text
    assert "GreaterThanOrEqual(DATE,2024-01-10)" in text and "LessThanOrEqual(DATE,2024-01-20)" in text
    assert "WIDE" not in text


def test_whole_rows_are_limited_before_their_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("k"), F.col("id").alias("DATE"), F.lit("x").alias("text"))
    text = plan_of(snapshots.latest_row(df, ["k"]))
    assert text.count("WindowGroupLimit") >= 2 and "SortAggregate" not in text


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["latest_row", "dedup_rownum", "new_or_changed_rows", "holdings_rollup"])
def test_registered_reductions_do_not_sort_for_aggregates(spark, name):
    assert "SortAggregate" not in plan_of(workload.QUERIES[name](spark, DATA))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["cov_oas", "cov_ledoit_wolf", "cov_regime_blended", "cov_sample"])
def test_pair_sums_are_computed_once(spark, name):
    assert plan_of(workload.QUERIES[name](spark, DATA)).count("FlatMapGroupsInPandas") <= 2  # named in tree and details


def test_grids_and_values_use_no_products(spark):
    df = panel(spark, {"A": [1, None, 3], "B": [2, 2, 2]}).where("value IS NOT NULL")
    cal = C.calendar_of(df)
    whole = panel(spark, {"A": [1, 2, 3], "B": [2, 2, 2]})
    plan = whole.select("date", "asset", F.lit(0.5).alias("weight"))
    # the value line writes its growth; what it is written from is looked at by itself
    growth = accounting.holdings_growth(whole, cal, plan)
    for frame in (panels.densify(df, cal), panels.fill_gaps(df, cal), growth, accounting.nav(whole, cal, plan)):
        text = plan_of(frame)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["total_return", "er_mean", "signal_history", "research_chain", "cov_sample", "gap_fill_controlled", "m_limit_weights"])
def test_registered_plans_have_no_products(spark, name):
    text = plan_of(workload.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
