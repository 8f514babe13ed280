"""Covariance, weights, accounting and statistics against NumPy, pandas and plain loops."""

import contextlib
import datetime
import io
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import cells, cross, day, panel
from tickloom.functions import fees
from tickloom.operators import accounting, covariance, panels, stats, support, weights
from tickloom.operators import calendar as C
from tickloom.operators.selection import select_all


@pytest.fixture(scope="module")
def random_panel(spark):
    rng = np.random.default_rng(7)
    growth = 1 + rng.normal(0, 0.02, size=(40, 6))
    table = 100 * growth.cumprod(axis=0)
    table[5, 2] = np.nan
    table[17, 4] = np.nan
    columns = {f"A{i}": [None if np.isnan(v) else v for v in table[:, i]] for i in range(6)}
    df = panel(spark, columns).where("value IS NOT NULL")
    wide = pd.DataFrame(table, columns=list(columns), index=[day("2024-03-01") + datetime.timedelta(days=i) for i in range(40)])
    return df, wide


def _last(df, wide):
    now = wide.index[-1]
    return df.where(F.col("date") == F.lit(now))


def _matrix(cov, order):
    frame = covariance.both_triangles(cov).toPandas().pivot(index="i", columns="j", values="cov")
    return frame.loc[order, order].to_numpy()


def test_pairwise_covariances_match_pandas(spark, random_panel):
    df, wide = random_panel
    cal = C.calendar_of(df)
    pool = _last(select_all(df), wide)
    back = C.Offset(days=20)
    history = wide.iloc[-21:].pct_change(fill_method=None).iloc[1:]
    order = list(wide.columns)
    assert np.allclose(_matrix(covariance.cov_sample(df, cal, pool, back), order), history.cov().to_numpy())
    ewm = history.ewm(halflife=5).cov().xs(history.index[-1], level=0).to_numpy()
    assert np.allclose(_matrix(covariance.cov_ewma(df, cal, pool, back, halflife=5), order), ewm)


def test_blocks_do_not_change_the_result(spark, random_panel):
    df, wide = random_panel
    cal = C.calendar_of(df)
    pool = _last(select_all(df), wide)
    from tickloom.operators.estimators import history, of_pool

    rows = of_pool(history(df, cal, pool, C.Offset(days=20)), pool)
    one = covariance.gram(rows).toPandas().sort_values(["i", "j"]).reset_index(drop=True)
    many = covariance.gram(rows, block=2).toPandas().sort_values(["i", "j"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(one, many)
    assert len(one) == 21 and (one["i"] <= one["j"]).all()  # six names: half the matrix and its diagonal


def test_whole_matrix_estimators(spark, random_panel):
    df, wide = random_panel
    cal = C.calendar_of(df)
    pool = _last(select_all(df), wide)
    order = list(wide.columns)
    x = wide.iloc[-16:].pct_change(fill_method=None).iloc[1:].to_numpy()
    back = C.Offset(days=15)


def test_limit_weights_and_deltas(spark):
    w = cross(spark, {"A": 0.8, "B": 0.2}, "weight")
    out = cells(weights.m_limit_weights(w, 0.6), "weight")
    assert out[("2024-03-01", "A")] == pytest.approx(0.6) and out[("2024-03-01", "B")] == pytest.approx(0.4)
    target, current = cross(spark, {"A": 0.9, "B": 0.1}, "weight"), cross(spark, {"A": 0.5, "B": 0.5}, "weight")
    moved = cells(weights.m_limit_deltas(target, current, 0.1), "weight")
    assert moved[("2024-03-01", "A")] == pytest.approx(0.6) and moved[("2024-03-01", "B")] == pytest.approx(0.4)


def _repeat_clip(w, base, limit):
    n = len(w)
    limit = limit + max(0, ((base - limit).sum() - 1) / n, (1 - (base + limit).sum()) / n)
    for _ in range(20_000):
        w = np.clip(w, base - limit, base + limit)
        w = w / w.sum()
        if (np.abs(w - base) - limit <= 1e-12).all():
            break
    return w


def test_limit_deltas_equal_the_repeated_rule(spark):
    """Over books that are at most fully invested; beyond that the repetition need not end."""
    rng = np.random.default_rng(3)
    rows, bases, wanted = [], [], {}
    for k in range(40):
        n = int(rng.integers(2, 9))
        w, b = rng.dirichlet(np.ones(n) * 0.4), rng.dirichlet(np.ones(n)) * rng.uniform(0.5, 1.0)
        limit_rows = [(day("2020-01-01") + datetime.timedelta(days=k), f"A{i}", float(w[i])) for i in range(n)]
        rows += limit_rows
        bases += [(r[0], r[1], float(b[i])) for i, r in enumerate(limit_rows)]
        for r, value in zip(limit_rows, _repeat_clip(w, b, 0.07)):
            wanted[(str(r[0]), r[1])] = value
    schema = "date date, asset string, weight double"
    out = cells(weights.m_limit_deltas(spark.createDataFrame(rows, schema), spark.createDataFrame(bases, schema), 0.07), "weight")
    for key, value in wanted.items():
        assert out.get(key, 0.0) == pytest.approx(value, abs=1e-7)


def _loop_nav(wide, schedule, capital):
    """Day by day: trade at the close before, mark at the close."""
    cash, units, out = capital, {}, []
    dates = list(wide.index)
    for t, date in enumerate(dates):
        if date in schedule and t > 0:
            price = wide.iloc[t - 1]
            value = cash + sum(q * price[a] for a, q in units.items())
            units = {a: w * value / price[a] for a, w in schedule[date].items()}
            cash = value * (1 - sum(schedule[date].values()))
        out.append(cash + sum(q * wide.iloc[t][a] for a, q in units.items()))
    return out


def test_nav_equals_a_day_loop(spark):
    rng = np.random.default_rng(11)
    table = 50 * (1 + rng.normal(0, 0.03, size=(60, 4))).cumprod(axis=0)
    df = panel(spark, {f"A{i}": list(table[:, i]) for i in range(4)})
    dates = [day("2024-03-01") + datetime.timedelta(days=i) for i in range(60)]
    wide = pd.DataFrame(table, columns=[f"A{i}" for i in range(4)], index=dates)
    schedule = {}
    for k in range(0, 60, 7):
        w = rng.dirichlet(np.ones(4)) * 0.95
        schedule[dates[k]] = {f"A{i}": float(w[i]) for i in range(4) if i != k % 4}
    plan = spark.createDataFrame(
        [(d, a, w) for d, ws in schedule.items() for a, w in ws.items()], "date date, asset string, weight double"
    )
    cal = C.calendar_of(df)
    got = [r["value"] for r in accounting.nav(df, cal, plan, 1e6).orderBy("date").collect()]
    assert np.allclose(got, _loop_nav(wide, schedule, 1e6), rtol=1e-12)
    # two portfolios valued in one job
    both = plan.withColumn("book", F.lit("x")).unionByName(plan.withColumn("weight", F.col("weight") * 0).withColumn("book", F.lit("y")))
    lines = accounting.nav(df, cal, both, 1e6, by=["book"]).toPandas()
    assert np.allclose(lines[lines.book == "x"].sort_values("date")["value"], got, rtol=1e-12)
    assert np.allclose(lines[lines.book == "y"]["value"], 1e6)


def test_prior_close_execution_and_single_transaction(spark):
    df = panel(spark, {"A": [10, 20, 20]})
    cal = C.calendar_of(df)
    plan = spark.createDataFrame([(day("2024-03-02"), "A", 1.0)], "date date, asset string, weight double")
    assert cells(accounting.positions(df, cal, plan, 1000.0), "quantity") == {
        ("2024-03-02", "A"): 100.0,
        ("2024-03-03", "A"): 100.0,
    }
    trades = accounting.transactions(df, cal, plan, 1000.0).collect()
    assert len(trades) == 1 and trades[0]["quantity"] > 0
    shares = accounting.drifted_weights(df, cal, plan)
    assert {r["asset"] for r in shares.collect()} == {"A", "Cash"}


def test_bankruptcy_stops_the_line(spark):
    df = panel(spark, {"A": [100, -200, 50]})
    cal = C.calendar_of(df)
    plan = spark.createDataFrame([(day("2024-03-02"), "A", 1.0)], "date date, asset string, weight double")
    line = accounting.nav(df, cal, plan)
    assert accounting.cut_at_bankruptcy(line).count() == 2
    assert accounting.cut_at_bankruptcy(line, child=True).where("value IS NULL").count() == 1


def test_long_and_short_net_out(spark):
    one = spark.createDataFrame([(day("2024-03-02"), "A", 1.0)], "date date, asset string, weight double")
    assert weights.long_short_combine(one, one).count() == 0


def test_commission_defaults(spark):
    df = spark.createDataFrame([(-200.0, 10.0), (0.0, 10.0)], "q double, p double")
    row, none = df.select(*[f(F.col("q"), F.col("p")).alias(n) for n, f in fees.COMMISSIONS.items()]).collect()
    assert row["quantity_tiered"] == 100 and row["notional_bps"] == 5 and row["fixed"] == 1
    assert row["per_share"] == 1 and row["notional_tiers"] == pytest.approx(2.0)
    assert none["fixed"] == 0 and none["notional_bps_min"] == 0 and none["sell_regulatory"] == 0


def _business_series(spark, n, name="s"):
    dates = pd.bdate_range("2020-01-01", periods=n)
    r = 0.0005 + 0.0002 * np.sin(np.arange(n) / 15)
    prices = pd.Series(100 * (1 + r).cumprod(), index=dates)
    frame = pd.DataFrame({"series": name, "ts": dates.date, "price": prices.to_numpy()})
    return spark.createDataFrame(frame, "series string, ts date, price double"), prices


def test_statistics_match_pandas(spark):
    df, prices = _business_series(spark, 500)
    row = stats.perf_stats(df).first().asDict()
    r = prices.pct_change().dropna()
    assert row["total_return"] == pytest.approx(prices.iloc[-1] / prices.iloc[0] - 1)
    assert row["daily_skew"] == pytest.approx(r.skew()) and row["daily_kurt"] == pytest.approx(r.kurt())
    assert row["var_95"] == pytest.approx(r.quantile(0.05))
    assert row["cvar_95"] == pytest.approx(r[r <= r.quantile(0.05)].mean())
    assert row["incep"] == row["cagr"]
    monthly = prices.resample("ME").last()
    assert row["best_month"] == pytest.approx(monthly.pct_change().max())
    assert row["mtd"] == pytest.approx(prices.iloc[-1] / monthly.iloc[-2] - 1)
    short = stats.perf_stats(_business_series(spark, 100)[0]).first()
    assert short["incep"] == short["total_return"]


def test_negative_price_zeroes_growth(spark):
    df = spark.createDataFrame(
        [("s", day("2024-01-01"), 100.0), ("s", day("2024-01-02"), -5.0), ("s", day("2024-01-03"), 20.0)],
        "series string, ts date, price double",
    )
    row = stats.perf_stats(df).first()
    assert row["cagr"] == 0.0 and row["calmar"] == 0.0


def test_drawdown_of_several_prices_a_day(spark):
    # peaks inside a day, a day of negative prices, a start below zero
    lines = {"a": [10, 12, 9, 11, 6, 14, -3, 7, 0], "b": [-2, 5, 4, -1, 8, 8, 2, 9, 3], "c": [1, 2, 3, 4, 5, 6, 7, 8, 9]}
    rows = [
        (s, datetime.datetime(2024, 1, 1 + i // 3, 9 + i % 3), float(p)) for s, prices in lines.items() for i, p in enumerate(prices)
    ]
    df = spark.createDataFrame(rows, "series string, ts timestamp, price double")
    depth = panels.drawdown(df).groupBy("series").agg(F.min("drawdown"))
    days = df.groupBy("series", F.col("ts").cast("date").alias("ts")).agg(F.max_by("price", "ts").alias("price"))
    length = panels.dd_duration(days)
    got = {r["series"]: (r["max_drawdown"], r["max_drawdown_duration"]) for r in stats.perf_stats(df).collect()}
    length = {r[0]: r[1] for r in length.collect()}
    assert got == {r[0]: (r[1], length[r[0]]) for r in depth.collect()}


def test_statistics_use_one_partitioning_by_series(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        stats.perf_stats(_business_series(spark, 30)[0]).explain()
    assert out.getvalue().count("Exchange ") <= 2 and "Join" not in out.getvalue()


# ---------------------------------------------------------------- what must not pass in silence
def _book(spark, columns, weight=1.0):
    prices = panel(spark, columns)
    calendar = C.calendar_of(prices)
    second = sorted(r["date"] for r in calendar.collect())[1]
    plan = spark.createDataFrame([(second, a, weight) for a in columns], "date date, asset string, weight double")
    return prices, calendar, plan


def test_held_name_without_a_price_fails(spark):
    gap = _book(spark, {"A": [10, 10, None, 10], "B": [5, 5, 5, 5]}, 0.5)
    with pytest.raises(Exception, match="no price for A"):
        accounting.nav(*gap, 1000.0).collect()
    base = _book(spark, {"A": [None, 10, 10, 10], "B": [5, 5, 5, 5]}, 0.5)
    with pytest.raises(Exception, match="no price to trade at for A"):
        accounting.positions(*base, 1000.0).collect()


def test_weights_beyond_the_capital_fail_unless_margin_is_allowed(spark):
    args = _book(spark, {"A": [10, 10, 20]}, 1.7)
    with pytest.raises(Exception, match="add up to"):
        accounting.nav(*args, 1000.0).collect()
    last = accounting.nav(*args, 1000.0, margin=True).orderBy("date").collect()[-1]
    assert last["value"] == pytest.approx(2700.0)


def test_live_start_seeds_and_trades_after_it(spark):
    prices = panel(spark, {"A": [10.0, 20.0, 30.0, 60.0]})
    calendar = C.calendar_of(prices)
    dates = sorted(r["date"] for r in calendar.collect())
    plan = spark.createDataFrame([(d, "A", 1.0) for d in dates], "date date, asset string, weight double")
    line = accounting.nav(prices, calendar, plan, 1000.0, live_start=dates[2]).orderBy("date").collect()
    assert [(r["date"], r["value"]) for r in line] == [(dates[2], 1000.0), (dates[3], 2000.0)]
    with pytest.raises(Exception, match="no date of the calendar"):
        accounting.nav(prices, calendar, plan, 1000.0, live_start="2030-01-01").collect()


# ---------------------------------------------------------------- chains of affine steps
@pytest.mark.parametrize("block", [2, 5, 256])
def test_affine_scan_equals_a_loop(spark, block):
    pick = random.Random(3)
    rows, want = [], {}
    for key, n in (("a", 23), ("b", 1), (None, 11)):
        state = 7.0
        for i in range(n):
            gain, shift = pick.choice([0.0, -1.5, 0.25, 1.0, 1.1]), pick.uniform(-3, 3)
            rows.append((key, i * 2, gain, shift, [i]))
            want[key, i * 2] = state
            state = gain * state + shift
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at int, g double, s double, more array<int>").repartition(3)
    out = support.affine_scan(df, ["k"], "at", F.col("g"), F.col("s"), 7.0, "state", block).collect()
    assert len(out) == len(rows) and all(r["more"] == [r["at"] // 2] for r in out)
    assert all(r["state"] == pytest.approx(want[r["k"], r["at"]]) for r in out)
    assert support.affine_scan(df.limit(0), ["k"], "at", F.col("g"), F.col("s")).count() == 0
    # one group without keys
    one = support.affine_scan(df.where("k = 'a'"), [], "at", F.col("g"), F.col("s"), 7.0, "state", block).collect()
    assert all(r["state"] == pytest.approx(want["a", r["at"]]) for r in one)


def test_value_survives_a_total_loss_and_later_money(spark):
    df = panel(spark, {"A": [1, 0, 0, 5, 5, 5], "B": [1, 1, 1, 1, 2, 4]})
    cal = C.calendar_of(df)
    days = [r["date"] for r in cal.orderBy("pos").collect()]
    plan = spark.createDataFrame([(days[1], "A", 1.0), (days[3], "B", 1.0), (days[5], "B", 1.0)], "date date, asset string, weight double")
    money = spark.createDataFrame([(days[2], 100.0), (days[4], 10.0)], "date date, amount double")
    line = accounting.nav(df, cal, plan, 50.0, flows=money).orderBy("date").collect()
    # all is lost on the second date; what comes on the third waits for the trade on the fourth
    assert [r["value"] for r in line] == [50.0, 0.0, 100.0, 100.0, 210.0, 420.0]
    held = accounting.positions(df, cal, plan, 50.0, flows=money).collect()
    assert {(r["date"], r["asset"]): r["quantity"] for r in held if r["asset"] == "B"} == {
        (days[3], "B"): 100.0, (days[4], "B"): 100.0, (days[5], "B"): 105.0
    }


def test_closed_names_leave_the_book_for_cash(spark):
    df = panel(spark, {"A": [1, 1, 2, 9, 9], "B": [1, 1, 1, 1, 1], "C": [2, 2, 2, 1, 1]})
    cal = C.calendar_of(df)
    days = [r["date"] for r in cal.orderBy("pos").collect()]
    plan = spark.createDataFrame([(days[1], a, w) for a, w in (("A", 1.0), ("B", 0.5), ("C", -0.5))], "date date, asset string, weight double")
    cut = spark.createDataFrame([("A", days[3])], "asset string, cutoff date")
    inputs = {"cutoffs": cut, "margin": True}
    line = {r["date"]: (r["value"], r["cash"]) for r in accounting.nav(df, cal, plan, 100.0, **inputs).collect()}
    # A is sold at 2, the close before its closing date; C is short
    assert line[days[2]] == (200.0, 0.0) and line[days[3]] == (225.0, 200.0)
    held = {(r["date"], r["asset"]) for r in accounting.positions(df, cal, plan, 100.0, **inputs).collect()}
    assert (days[2], "A") in held and (days[3], "A") not in held and (days[4], "B") in held
    rows = {(r["date"], r["asset"]): (r["quantity"], r["execution"]) for r in accounting.trades(df, cal, plan, 100.0, **inputs).collect()}
    assert rows[days[3], "A"] == (-100.0, 2.0) and rows[days[1], "C"] == (-25.0, 2.0) and len(rows) == 4
    shares = {(r["date"], r["asset"]): r["weight"] for r in accounting.drifted_weights(df, cal, plan, 100.0, **inputs).collect()}
    assert shares[days[3], "Cash"] == pytest.approx(200 / 225) and shares[days[3], "C"] == pytest.approx(-25 / 225)
    with pytest.raises(Exception, match="add up to"):
        accounting.positions(df, cal, plan.withColumn("weight", F.abs("weight")), 100.0).collect()


def test_transition_over_thousands_of_targets(spark):
    first = day("2000-01-01")
    dates = [first + datetime.timedelta(days=i) for i in range(5_000)]
    targets = spark.createDataFrame([(d, "A", float(i % 7)) for i, d in enumerate(dates)], "date date, asset string, weight double")
    cal = C.calendar_of(targets)
    got = {r["date"]: r["weight"] for r in weights.transition_schedule(targets, cal, 4).collect()}
    at = 0.0
    for i, d in enumerate(dates):
        at += (i % 7 - at) / 4
        assert got.get(d, 0.0) == pytest.approx(at, abs=1e-9)
