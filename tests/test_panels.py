"""Panels, calendar, factors and selections against the golden cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import cells, cross, day, names, panel
from tickloom.operators import calendar as C
from tickloom.operators import factors, panels, selection
from tickloom.operators.support import Ordering, exact_quantiles, ordered_prefix


def test_fill_and_rebase(spark):
    df = panel(spark, {"AAPL": [100, 101, None], "MSFT": [None, None, 300]})
    cal = C.calendar_of(df)
    filled = panels.fill_gaps(df, cal).drop("pos")
    out = cells(panels.rebase(filled, cal))
    assert out == {
        ("2024-03-01", "AAPL"): 100.0,
        ("2024-03-02", "AAPL"): pytest.approx(101.0),
        ("2024-03-03", "AAPL"): pytest.approx(101.0),
        ("2024-03-03", "MSFT"): 100.0,
    }


@pytest.mark.parametrize("tail, third", [([51, None], 51.0), ([None, None], None)])
def test_single_trailing_gap(spark, tail, third):
    df = panel(spark, {"AAPL": [100, 101, 102], "EWG": [50, *tail]})
    cal = C.calendar_of(df)
    assert cells(panels.fill_gaps(df, cal)).get(("2024-03-03", "EWG")) == third
    if third is None:
        assert {r["asset"]: str(r["last_valid_date"]) for r in panels.delisted(df, cal).collect()} == {"EWG": "2024-03-01"}


def test_isolated_empty_date_is_copied(spark):
    df = panel(spark, {"AAPL": [0.6, None, 0.7], "MSFT": [0.4, None, 0.3]})
    cal = C.calendar_of(df)
    out = cells(panels.fill_isolated(df, cal))
    assert out[("2024-03-02", "AAPL")] == 0.6 and out[("2024-03-02", "MSFT")] == 0.4
    held = panels.membership(panels.fill_isolated(df, cal).withColumnRenamed("value", "weight"), cal)
    assert all(r["held"] for r in held.collect())


def test_select_all_variants(spark):
    df = panel(spark, {"A": [100, None, 101], "B": [100, -1, 102]})
    now = df.where(F.col("date") == F.lit("2024-03-02").cast("date"))
    assert names(selection.select_all(now)) == []
    assert names(selection.select_all(now, include_no_data=True)) == ["A", "B"]
    assert names(selection.select_all(now, include_negative=True)) == ["B"]


def test_select_has_data(spark):
    df = panel(spark, {"A": [1, 2, 3], "B": [1, None, 3]})
    cal = C.calendar_of(df)
    now = df.where(F.col("date") == F.lit("2024-03-03").cast("date")).select("date", "asset")
    assert names(selection.select_has_data(df, cal, now, C.Offset(days=2))) == ["A"]


def test_quantiles_and_double_sorts(spark):
    metric = cross(spark, {"A": 4, "B": 3, "C": 2, "D": 1})
    pool = metric.select("date", "asset")
    assert names(selection.select_quantile(metric, pool, 2, 2)) == ["C", "D"]
    sectors = spark.createDataFrame([("A", "T"), ("B", "T"), ("C", "H"), ("D", "H")], "asset string, sector string")
    tech = cross(spark, {"A": 4, "B": 1, "C": 3, "D": 2})
    assert names(selection.sector_double_sort(tech, pool, sectors, 2)) == ["A", "C"]
    size = cross(spark, dict(zip("ABCDEFGH", range(8, 0, -1))))
    quality = cross(spark, dict(A=1, B=4, C=3, D=2, E=8, F=5, G=7, H=6))
    assert names(selection.standard_double_sort(size, quality, size.select("date", "asset"), 2, 2)) == ["B", "C", "E", "G"]


def test_ewma_recursion_with_gaps(spark):
    df = panel(spark, {"A": [1, 3, 5], "B": [2, None, 6], "C": [None, 4, None]})
    cal = C.calendar_of(df)
    out = cells(factors.ewma(df, cal, cal, half_life=1), "factor")
    wide = df.toPandas().pivot(index="date", columns="asset", values="value").astype(float)
    expected = wide.ewm(alpha=0.5, adjust=False).mean()
    assert out[("2024-03-03", "A")] == pytest.approx(3.5)
    for (date, asset), value in out.items():
        assert value == pytest.approx(expected.loc[day(date), asset])


def test_standardize_constant_cross_section(spark):
    out = factors.standardize(cross(spark, {"A": 2, "B": 2}))
    assert [r["factor"] for r in out.collect()] == [0.0, 0.0]


def test_ordered_prefix_spreads_a_hot_group(spark):
    """One group with most rows and most of them tied: still exact, and not in one partition."""
    rows = spark.range(6000).select(
        F.when(F.col("id") < 5000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.when(F.col("id") % 3 == 0, 1.0).otherwise((F.col("id") % 11).cast("double")).alias("v"),
        F.format_string("a%05d", "id").alias("asset"),
    )
    out = ordered_prefix(rows, ["g"], [Ordering("v", True), Ordering("asset")], {"s": F.col("v")}).toPandas()
    want = rows.toPandas().sort_values(["g", "v", "asset"], ascending=[True, False, True])
    want["_pos"] = want.groupby("g").cumcount() + 1
    want["s"] = want.groupby("g")["v"].cumsum()
    got = out.sort_values(["g", "_pos"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[["g", "v", "asset", "_pos"]], want[["g", "v", "asset", "_pos"]].reset_index(drop=True), check_dtype=False)
    assert np.allclose(got["s"], want["s"])


def test_exact_quantiles_match_linear_rule(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"date": ["d"] * 101 + ["e"] * 4, "asset": [f"a{i:03d}" for i in range(105)], "x": rng.normal(size=105).round(1)})
    out = exact_quantiles(spark.createDataFrame(frame), ["date"], "x", "asset", {"q": 0.25, "m": 0.5}).toPandas().set_index("date")
    for date, group in frame.groupby("date"):
        assert out.loc[date, "q"] == pytest.approx(group["x"].quantile(0.25))
        assert out.loc[date, "m"] == pytest.approx(group["x"].quantile(0.5))


def test_top_n_two_rounds(spark):
    rows = spark.range(2000).select(
        F.lit(day("2024-03-01")).alias("date"), F.format_string("a%04d", "id").alias("asset"), (F.col("id") % 50).cast("double").alias("factor")
    )
    got = names(selection.select_n(rows, rows, 45))
    want = sorted(r["asset"] for r in rows.orderBy(F.col("factor").desc(), "asset").limit(45).collect())
    assert got == want
