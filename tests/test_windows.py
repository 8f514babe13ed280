"""Window sums without copied rows against plain sums over every window."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import day
from test_plans import plan_of
from tickloom.operators import calendar as C
from tickloom.operators import expected_returns, factors

START = day("2020-01-01")
LOOKBACK = C.Offset(days=9)


def history(spark, seed=1, days=75):
    """A panel with gaps, a leap in size, equal stretches, an asset that ends early and one with one value."""
    pick = random.Random(seed)
    table = {a: {} for a in ("gaps", "leap", "flat", "ends", "one")}
    for i in range(days):
        if pick.random() < 0.5:
            table["gaps"][i] = pick.uniform(-5, 50)
        table["leap"][i] = 1e12 * pick.random() if i < 30 else 0.01 + 1e-6 * pick.random()
        table["flat"][i] = 0.1 if i % 40 < 25 else 0.1 + i
        if i < 22:
            table["ends"][i] = 3.0 + i
    table["one"][40] = 7.7
    rows = [(START + datetime.timedelta(days=i), a, v) for a, vs in table.items() for i, v in vs.items()]
    rows += [(START + datetime.timedelta(days=3), "nan", float("nan")), (START + datetime.timedelta(days=4), "nan", None)]
    return table, spark.createDataFrame(rows, "date date, asset string, value double").repartition(3)


def windows(table, days=75, back=9):
    for a, vs in table.items():
        for i in range(days):
            low = max(i - back, 0)
            inside = [(p - low, vs[p]) for p in range(low, i + 1) if p in vs]
            if inside:
                yield a, START + datetime.timedelta(days=i), inside


@pytest.mark.parametrize("k", [None, 0, 1, 2, 0.5])
def test_moving_averages_equal_plain_sums(spark, k):
    table, panel = history(spark)
    cal = C.calendar_of(panel)
    out = factors.simple_moving_average(panel, cal, cal, LOOKBACK) if k is None else factors.kernel_moving_average(panel, cal, cal, LOOKBACK, k)
    got = {(r["asset"], r["date"]): r["factor"] for r in out.collect()}
    want = {}
    for a, d, inside in windows(table):
        weights = [1 if k is None else (p + 1) ** k for p, _ in inside]
        want[a, d] = math.fsum(w * v for w, (_, v) in zip(weights, inside)) / sum(weights)
        if k != 0.5 and len({v for _, v in inside}) == 1:
            assert got[a, d] == inside[0][1]  # equal prices to the last bit
    assert set(got) == set(want)
    assert all(got[key] == pytest.approx(want[key], rel=1e-12) for key in want)


@pytest.mark.parametrize("alpha", [0.02, 0.5, 0.9999999])
def test_decayed_means_equal_plain_sums(spark, alpha):
    table, panel = history(spark)
    table = {a: table[a] for a in ("gaps", "flat", "ends", "one")}
    panel = panel.where(F.col("asset").isin(list(table)))
    cal = C.calendar_of(panel)
    edges = C.window_edges(cal, cal, LOOKBACK)
    rows = C.on_calendar(panel, cal)
    sums = C.decayed_sums(rows, edges, 1 - alpha, None, weight=F.lit(1.0), total=F.col("value")).where("n > 0")
    got = {(r["asset"], r["now"]): (r["n"], r["total"] / r["weight"]) for r in sums.collect()}
    want = {}
    for a, d, inside in windows(table):
        low = max((d - START).days - 9, 0)
        weights = [(1 - alpha) ** ((d - START).days - low - p) for p, _ in inside]
        if sum(weights) > 1e-30:
            want[a, d] = (len(inside), math.fsum(w * v for w, (_, v) in zip(weights, inside)) / math.fsum(weights))
    assert set(want) <= set(got)
    assert all(got[key][0] == want[key][0] for key in want)
    # where the window's last dates are empty, all its weights are small against what they are taken from
    near = [key for key in want if alpha < 0.9 or (key[1] - START).days in table[key[0]]]
    assert near and all(got[key][1] == pytest.approx(want[key][1], rel=1e-9) for key in near)


def test_exponential_returns_of_a_pool(spark):
    table, panel = history(spark)
    panel = panel.where("asset IN ('ends', 'flat')")
    cal = C.calendar_of(panel)
    pool = panel.where("asset = 'ends'").select("date", "asset")
    out = expected_returns.er_ewma(panel, cal, pool, LOOKBACK, alpha=0.3).collect()
    assert {r["asset"] for r in out} == {"ends"}
    for r in out:
        i = (r["date"] - START).days
        low = max(i - 9, 0)
        inside = [(p, table["ends"][p] / table["ends"][p - 1] - 1) for p in range(low + 1, i + 1)]
        weights = [0.7 ** (i - p) for p, _ in inside]
        assert r["expected_return"] == pytest.approx(sum(w * x for w, (_, x) in zip(weights, inside)) / sum(weights))
    assert len(out) == 21


def test_windows_are_not_filled_with_copies(spark):
    _, panel = history(spark)
    cal = C.calendar_of(panel)
    pool = panel.select("date", "asset")
    frames = [
        factors.simple_moving_average(panel, cal, cal, LOOKBACK), factors.kernel_moving_average(panel, cal, cal, LOOKBACK, 2),
        expected_returns.er_ewma(panel, cal, pool, LOOKBACK, alpha=0.1), expected_returns.er_mean(panel, cal, pool, LOOKBACK),
    ]
    for frame in frames:
        text = plan_of(frame)
        # a bridge from windows to their dates carries wpos and wlen
        assert "wpos" not in text and "wlen" not in text and "NestedLoop" not in text


def test_windows_of_nothing(spark):
    _, panel = history(spark)
    cal = C.calendar_of(panel)
    none = cal.limit(0)
    assert factors.simple_moving_average(panel, cal, none, LOOKBACK).count() == 0
    assert factors.kernel_moving_average(panel.limit(0), cal, cal, LOOKBACK, 1).count() == 0
    assert expected_returns.er_ewma(panel, cal, panel.select("date", "asset").limit(0), LOOKBACK, alpha=0.1).count() == 0
