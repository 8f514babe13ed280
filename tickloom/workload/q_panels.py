"""Panel, series and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import calendar as C
from tickloom.operators import panels as P
from tickloom.workload.base import cte, holdings, load, panel_a, panel_b, query, rnd, rs, series_a, snapshot


def cal_a(spark, sf):
    return C.calendar_of(load(spark, sf, "lineitem").select(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")))


def cal_b(spark, sf):
    return C.calendar_of(load(spark, sf, "events").select(F.col("ts").cast("date").alias("date")))


def _valued(df, digits=6):
    return df.select("date", "asset", rnd("value", digits).alias("value"))


# ------------------------------------------------------------------ panels
query("densify_panel", "SELECT date, asset, value FROM grid_b", ("grid_b",))(
    lambda spark, sf: P.densify(panel_b(spark, sf), cal_b(spark, sf)).drop("pos")
)
cte(
    "fill_b",
    """SELECT date, pos, asset, CASE WHEN pos <= lv OR (SELECT max(pos) FROM cal_b) - lv = 1 THEN carried END AS value FROM (
SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY pos ROWS UNBOUNDED PRECEDING) AS carried,
max(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY asset) AS lv FROM grid_b)""",
    "grid_b",
)
query("gap_fill_controlled", "SELECT date, asset, value FROM fill_b WHERE value IS NOT NULL", ("fill_b",))(
    lambda spark, sf: P.fill_gaps(panel_b(spark, sf), cal_b(spark, sf)).drop("pos")
)
# the calendar has dates that the monthly panel lacks: one after each January, which is
# isolated, and two after each July, which are not
query(
    "fill_single_null_row",
    """SELECT date, asset, value FROM pa
UNION ALL SELECT CAST(date + 14 AS DATE), asset, value FROM pa WHERE month(date) = 1 AND date < (SELECT max(date) FROM pa)""",
    ("pa",),
)(lambda spark, sf: _fill_isolated(spark, sf))


def _fill_isolated(spark, sf):
    panel = panel_a(spark, sf)
    month = F.month("date")
    later = F.when(month == 1, F.array(F.lit(14))).when(month == 7, F.array(F.lit(9), F.lit(19))).otherwise(F.array().cast("array<int>"))
    days = panel.select("date").distinct()
    extra = days.select(F.explode(F.transform(later, lambda k: F.date_add("date", k))).alias("date"))
    return P.fill_isolated(panel, C.calendar_of(days.union(extra)))


query(
    "ffill_bfill",
    """SELECT date, asset, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY pos ROWS UNBOUNDED PRECEDING),
first_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM grid_b""",
    ("grid_b",),
)(lambda spark, sf: P.ffill_bfill(panel_b(spark, sf), cal_b(spark, sf)).drop("pos"))


def _info(spark, sf):
    """Company attributes: the kind of the last event per load date; weekends are no price dates."""
    return snapshot(spark, sf).select(
        F.col("DATE").alias("date"), F.col("TICKER").alias("asset"), F.col("KIND").alias("sector"),
        F.col("TICKER").alias("ticker"), F.col("VALUE").alias("cap"), F.col("SEQ").alias("at"),
    )


def _weekdays(spark, sf):
    days = load(spark, sf, "events").select(F.col("ts").cast("date").alias("date"))
    return C.calendar_of(days.where(F.dayofweek("date").between(2, 6)))


@query(
    "info_panels",
    """WITH c AS (SELECT DISTINCT "DATE" AS date FROM snap WHERE isodow("DATE") <= 5),
v AS (SELECT date, asset, KIND AS sector, VALUE AS cap FROM (SELECT "DATE" AS date, TICKER AS asset, KIND, VALUE,
row_number() OVER (PARTITION BY "DATE", TICKER ORDER BY SEQ DESC) AS rn FROM snap) WHERE rn = 1 AND date IN (SELECT date FROM c)),
g AS (SELECT c.date, a.asset, v.sector, v.cap FROM c CROSS JOIN (SELECT DISTINCT asset FROM v) a LEFT JOIN v ON v.date = c.date AND v.asset = a.asset)
SELECT date, asset, coalesce(last_value(sector IGNORE NULLS) OVER f, first_value(sector IGNORE NULLS) OVER b) AS sector,
coalesce(last_value(cap IGNORE NULLS) OVER f, first_value(cap IGNORE NULLS) OVER b) AS cap, asset AS ticker FROM g
WINDOW f AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY asset ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    ("snap",),
)
def _info_panels(spark, sf):
    info, calendar = _info(spark, sf), _weekdays(spark, sf)
    out = None
    for column in ("sector", "ticker", "cap"):
        cells = P.info_panel(info, column, calendar, "at").withColumnRenamed("value", column)
        out = cells if out is None else out.join(cells, ["date", "asset"])
    return out


cte(
    "ret_a",
    """SELECT date, pos, asset, value, CASE WHEN prev <> 0 AND isfinite(value / prev) THEN value / prev - 1 END AS r FROM
(SELECT *, lag(value) OVER (PARTITION BY asset ORDER BY pos) AS prev FROM grid_a)""",
    "grid_a",
)
cte(
    "ret_b",
    """SELECT date, pos, asset, value, CASE WHEN prev <> 0 AND isfinite(value / prev) THEN value / prev - 1 END AS r FROM
(SELECT *, lag(value) OVER (PARTITION BY asset ORDER BY pos) AS prev FROM grid_b)""",
    "grid_b",
)
query("pct_change", f"SELECT date, asset, {rs('r')} AS value FROM ret_b WHERE value IS NOT NULL", ("ret_b",))(
    lambda spark, sf: _valued(P.returns(panel_b(spark, sf), cal_b(spark, sf)))
)
query("log_return", f"SELECT date, asset, {rs('ln(1 + r)')} AS value FROM ret_a WHERE value IS NOT NULL", ("ret_a",))(
    lambda spark, sf: _valued(P.log_returns(panel_a(spark, sf), cal_a(spark, sf)))
)
query(
    "pct_change_k",
    f"""SELECT date, asset, {rs('value / prev - 1')} AS value FROM (SELECT *, lag(value, 12) OVER (PARTITION BY asset ORDER BY pos) AS prev FROM grid_a)
WHERE value IS NOT NULL""",
    ("grid_a",),
)(lambda spark, sf: _valued(P.returns(panel_a(spark, sf), cal_a(spark, sf), 12)))
query(
    "rebase_100",
    f"""WITH r AS (SELECT date, pos, asset, value, CASE WHEN prev <> 0 THEN value / prev ELSE 1 END AS g FROM (SELECT *, lag(value) OVER (PARTITION BY asset ORDER BY pos) AS prev FROM fill_b))
SELECT date, asset, {rs('value', 4)} AS value FROM (SELECT date, asset, value AS v, 100 * product(coalesce(g, 1)) OVER (PARTITION BY asset ORDER BY pos ROWS UNBOUNDED PRECEDING) AS value FROM r) WHERE v IS NOT NULL""",
    ("fill_b",),
)(lambda spark, sf: _valued(P.rebase(P.fill_gaps(panel_b(spark, sf), cal_b(spark, sf)).drop("pos"), cal_b(spark, sf)), 4))
query(
    "rebase_100_windowed",
    f"""WITH s AS (SELECT * FROM grid_a WHERE date >= DATE '1998-03-01'), r AS (SELECT date, pos, asset, value, value / lag(value) OVER (PARTITION BY asset ORDER BY pos) AS g FROM s)
SELECT date, asset, {rs('v', 4)} AS value FROM (SELECT date, asset, value, 100 * product(coalesce(g, 1)) OVER (PARTITION BY asset ORDER BY pos ROWS UNBOUNDED PRECEDING) AS v FROM r) WHERE value IS NOT NULL""",
    ("grid_a",),
)(lambda spark, sf: _valued(P.rebase(panel_a(spark, sf), cal_a(spark, sf), "1998-03-01"), 4))
query(
    "pull_back_one_year",
    "SELECT date, asset, value FROM pa WHERE date >= DATE '1998-02-28' AND date <= DATE '2000-06-30'",
    ("pa",),
)(lambda spark, sf: P.load_range(panel_a(spark, sf), "1999-02-28", "2000-06-30"))
query(
    "last_valid_date",
    "SELECT asset, max(date) AS last_valid_date FROM pb GROUP BY 1 HAVING max(date) < (SELECT max(date) FROM pb)",
    ("pb",),
)(lambda spark, sf: P.delisted(panel_b(spark, sf), cal_b(spark, sf)))
query(
    "in_portfolio_flag",
    "SELECT date, asset, coalesce(value > 15, FALSE) AS held FROM grid_b",
    ("grid_b",),
)(lambda spark, sf: P.membership(panel_b(spark, sf).select("date", "asset", (F.col("value") - 15).alias("weight")), cal_b(spark, sf)))
query(
    "shift_one",
    "SELECT c.date, p.asset, p.value FROM pb p JOIN cal_b q ON q.date = p.date JOIN cal_b c ON c.pos = q.pos + 1",
    ("pb", "cal_b"),
)(lambda spark, sf: P.shift(panel_b(spark, sf), cal_b(spark, sf)))
for _unit in ("month", "quarter", "year"):
    query(
        "resample_last" if _unit == "month" else f"resample_last_{_unit}",
        f"""SELECT series, CAST(date_trunc('{_unit}', ts) AS DATE) AS period, max(ts) AS ts, arg_max(price, ts) AS price FROM ser GROUP BY 1, 2""",
        ("ser",),
    )(lambda spark, sf, unit=_unit: P.resample_last(series_a(spark, sf), unit))
query(
    "drawdown",
    f"SELECT series, ts, {rs('price / max(price) OVER (PARTITION BY series ORDER BY ts) - 1')} AS drawdown FROM ser",
    ("ser",),
)(lambda spark, sf: P.drawdown(series_a(spark, sf)).select("series", "ts", rnd("drawdown").alias("drawdown")))
query(
    "underwater_run",
    """WITH d AS (SELECT *, price < max(price) OVER (PARTITION BY series ORDER BY ts) AS u FROM ser),
g AS (SELECT *, sum(CASE WHEN u THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY ts) AS k FROM d)
SELECT series, max(n) AS max_drawdown_duration FROM (SELECT series, k, count(*) FILTER (WHERE u) AS n FROM g GROUP BY 1, 2) GROUP BY 1""",
    ("ser",),
)(lambda spark, sf: P.dd_duration(series_a(spark, sf)))


@query(
    "rf_per_period",
    f"""WITH rf AS (SELECT ts, price / lag(price) OVER (ORDER BY ts) - 1 AS r FROM ser WHERE series = 'MACHINERY')
SELECT s.series, s.ts, {rs('coalesce(rf.r, 0)')} AS rf, {rs('pow(1.05, 1.0 / 252) - 1', 10)} AS flat_rf FROM ser s LEFT JOIN rf ON rf.ts = s.ts""",
    ("ser",),
)
def _rf(spark, sf):
    rows = series_a(spark, sf)
    out = P.rf_returns(rows, rows.where("series = 'MACHINERY'"))
    return out.select("series", "ts", rnd("rf").alias("rf"), rnd(F.lit(P.period_rf(0.05, 252)), 10).alias("flat_rf"))


# ------------------------------------------------------------------ calendar gates
cte("cal_d", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () - 1 AS last FROM (SELECT DISTINCT ts AS date FROM ser)", "ser")


def cal_d(spark, sf):
    """Order days: a daily calendar of several years."""
    return C.calendar_of(load(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")))


_KEYS = {
    "run_daily": ("date", C.run_daily),
    "run_weekly": ("weekofyear(date)", C.run_weekly),
    "run_monthly": ("month(date)", C.run_monthly),
    "run_quarterly": ("quarter(date)", C.run_quarterly),
    "run_yearly": ("year(date)", C.run_yearly),
}
for _name, (_key, _gate) in _KEYS.items():
    query(
        _name,
        f"""SELECT date FROM (SELECT date, pos, last, {_key} <> lag({_key}) OVER (ORDER BY pos) AS turn FROM cal_d)
WHERE pos > 0 AND (pos = 1 OR (pos < last AND turn))""",
        ("cal_d",),
    )(lambda spark, sf, gate=_gate: gate(cal_d(spark, sf)))
query(
    "run_period_base",
    """SELECT date FROM (SELECT date, pos, last, month(date) <> lead(month(date)) OVER (ORDER BY pos) AS turn FROM cal_d)
WHERE pos > 1 AND (pos = last OR turn)""",
    ("cal_d",),
)(lambda spark, sf: C.run_monthly(cal_d(spark, sf), on_first=False, end_of_period=True, on_last=True))
query("run_on_date", "SELECT date FROM cal_d WHERE date IN (DATE '1997-03-03', DATE '1998-07-01', DATE '1890-01-01')", ("cal_d",))(
    lambda spark, sf: C.run_on_date(cal_d(spark, sf), ["1997-03-03", "1998-07-01", "1890-01-01"])
)
query("run_once", "SELECT date FROM cal_d WHERE pos = 1", ("cal_d",))(lambda spark, sf: C.run_once(cal_d(spark, sf)))
query("run_after_date", "SELECT date FROM cal_d WHERE date > DATE '1997-03-03'", ("cal_d",))(
    lambda spark, sf: C.run_after_date(cal_d(spark, sf), "1997-03-03")
)
query("run_after_days", "SELECT date FROM cal_d WHERE pos >= 10", ("cal_d",))(lambda spark, sf: C.run_after_days(cal_d(spark, sf), 10))
query(
    "run_after_months",
    "SELECT date FROM cal_d WHERE year(date) * 12 + month(date) - (SELECT min(year(date) * 12 + month(date)) FROM cal_d) >= 5",
    ("cal_d",),
)(lambda spark, sf: C.run_after_months(cal_d(spark, sf), 5))
query("run_every_n_periods", "SELECT date FROM cal_d WHERE pos % 5 = 2", ("cal_d",))(
    lambda spark, sf: C.run_every_n_periods(cal_d(spark, sf), 5, 2)
)
query(
    "run_every_n_months",
    """WITH RECURSIVE f AS (SELECT year(date) * 12 + month(date) AS m, min(date) AS date FROM cal_d WHERE pos > 0 GROUP BY 1),
t(m, date) AS (SELECT m, date FROM f WHERE m = (SELECT min(m) FROM f) UNION ALL
SELECT n.m, n.date FROM t JOIN f n ON n.m = (SELECT min(x.m) FROM f x WHERE x.m >= t.m + 3)) SELECT date FROM t""",
    ("cal_d",),
)(lambda spark, sf: C.run_every_n_months(cal_d(spark, sf), 3))

_W = "SELECT \"DATE\" AS date, TICKER AS asset, WEIGHT AS weight FROM hold"


def member_weights(spark, sf, index):
    return holdings(spark, sf).where(F.col("INDEX") == index).select(
        F.col("DATE").alias("date"), F.col("TICKER").alias("asset"), F.col("WEIGHT").alias("weight")
    )


@query(
    "run_if_out_of_bounds",
    f"""WITH c AS ({_W} WHERE "INDEX" = 'MACHINERY'), t AS ({_W} WHERE "INDEX" = 'FURNITURE'),
j AS (SELECT coalesce(c.date, t.date) AS date, coalesce(c.weight, 0) AS cw, coalesce(t.weight, 0) AS tw FROM c FULL JOIN t ON c.date = t.date AND c.asset = t.asset)
SELECT date, bool_or(CASE WHEN tw = 0 THEN abs(cw) ELSE abs((cw - tw) / tw) END > 5) AS flag, bool_or(abs(cw - tw) > 0.2) AS absolute_flag FROM j GROUP BY 1""",
    ("hold",),
)
def _out_of_bounds(spark, sf):
    current, target = member_weights(spark, sf, "MACHINERY"), member_weights(spark, sf, "FURNITURE")
    relative = C.out_of_bounds(current, target, 5.0)
    absolute = C.out_of_bounds(current, target, 0.2, "absolute").withColumnRenamed("flag", "absolute_flag")
    return relative.join(absolute, "date")


def balances(spark, sf):
    """Customer balances as a table of cash and value."""
    return load(spark, sf, "customer").select(
        F.col("c_custkey").alias("date"), F.col("c_acctbal").alias("cash"), F.when(F.col("c_custkey") % 9 != 0, F.lit(5000.0)).alias("value")
    )


query(
    "run_if_cash_out_of_bounds",
    "SELECT c_custkey AS date, CASE WHEN c_custkey % 9 = 0 THEN FALSE ELSE abs(c_acctbal / 5000 - 0.8) > 0.5 END AS flag FROM customer",
)(lambda spark, sf: C.cash_out_of_bounds(balances(spark, sf), 0.8, 0.5))
query(
    "require",
    "SELECT c_custkey AS date, CASE WHEN c_custkey % 9 = 0 THEN TRUE ELSE 5000.0 > 6000 END AS flag FROM customer",
)(lambda spark, sf: C.require(balances(spark, sf), lambda v: v > 6000, "value", if_none=True).select("date", "flag"))
query(
    "not_or_and_stack",
    """WITH m AS (SELECT date FROM (SELECT date, pos, last, month(date) <> lag(month(date)) OVER (ORDER BY pos) AS turn FROM cal_d) WHERE pos > 0 AND (pos = 1 OR (pos < last AND turn))),
x AS (SELECT date FROM m WHERE date > DATE '1997-03-03' UNION SELECT date FROM cal_d WHERE pos = 1)
SELECT date FROM cal_d WHERE date NOT IN (SELECT date FROM x)""",
    ("cal_d",),
)(lambda spark, sf: _combined(cal_d(spark, sf)))


def _combined(calendar):
    monthly_later = C.all_of(C.run_monthly(calendar), C.run_after_date(calendar, "1997-03-03"))
    return C.negate(calendar, C.any_of(monthly_later, C.run_once(calendar)))


query(
    "close_after_dates",
    """WITH k AS (SELECT c_custkey AS asset, CAST(DATE '1994-06-01' + CAST(c_custkey % 3000 AS INTEGER) AS DATE) AS cutoff FROM customer)
SELECT asset, min(date) AS date FROM k JOIN cal_d ON date >= cutoff GROUP BY 1""",
    ("cal_d",),
)(
    lambda spark, sf: C.close_after_dates(
        cal_d(spark, sf),
        load(spark, sf, "customer").select(
            F.col("c_custkey").alias("asset"),
            F.date_add(F.lit("1994-06-01").cast("date"), (F.col("c_custkey") % 3000).cast("int")).alias("cutoff"),
        ),
    )
)

# ------------------------------------------------------------------ range and as-of joins
cte(
    "win_a",
    """SELECT n.date AS now, h.date, h.asset, h.pos, h.value, h.r,
h.pos - (SELECT min(pos) FROM cal_a x WHERE x.date >= CAST(n.date - INTERVAL 3 MONTH AS DATE)) AS wpos
FROM cal_a n JOIN ret_a h ON h.date BETWEEN CAST(n.date - INTERVAL 3 MONTH AS DATE) AND n.date""",
    "ret_a",
)
query(
    "window_range_join",
    """SELECT n.date AS now, p.date, p.asset, p.value FROM cal_a n JOIN pa p ON p.date BETWEEN CAST(n.date - INTERVAL 3 MONTH AS DATE) AND CAST(n.date - INTERVAL 20 DAY AS DATE)""",
    ("cal_a",),
)(lambda spark, sf: _range_join(spark, sf))


def _range_join(spark, sf):
    calendar = cal_a(spark, sf)
    bridge = C.window_bridge(calendar, calendar, C.Offset(months=3), C.Offset(days=20))
    return C.window_range_join(panel_a(spark, sf), bridge).select("now", "date", "asset", "value")


query(
    "benchmark_align",
    f"""WITH b AS (SELECT date, r FROM ret_a WHERE asset = 'Brand#1') SELECT x.date, x.asset, {rs('x.r - b.r')} AS value FROM ret_a x JOIN b ON b.date = x.date
WHERE x.asset <> 'Brand#1' AND x.r - b.r IS NOT NULL""",
    ("ret_a",),
)(lambda spark, sf: _aligned(spark, sf))


def _aligned(spark, sf):
    from tickloom.operators.estimators import benchmark_relative

    changes = P.returns(panel_a(spark, sf), cal_a(spark, sf))
    bench = changes.where("asset = 'Brand#1'").select("date", F.col("value").alias("benchmark"))
    return _valued(benchmark_relative(changes.where("asset <> 'Brand#1'"), bench).where("value IS NOT NULL"))


query(
    "asof_last_price",
    """SELECT n.now, p.asset, p.value FROM (SELECT date AS now FROM cal_b) n
JOIN pb p ON p.date = (SELECT max(date) FROM cal_b c WHERE c.date <= n.now AND isodow(c.date) <= 5)""",
    ("pb", "cal_b"),
)(lambda spark, sf: _asof(spark, sf))


def _asof(spark, sf):
    from tickloom.operators.signals import asof_last_price

    return asof_last_price(panel_b(spark, sf), _weekdays(spark, sf), cal_b(spark, sf).select("date"))


query(
    "asof_offset",
    """SELECT series, arg_max(price, ts) AS price, max(ts) AS ts FROM (SELECT *, max(ts) OVER (PARTITION BY series) AS e FROM ser) WHERE ts <= CAST(e - INTERVAL 6 MONTH AS DATE) GROUP BY 1""",
    ("ser",),
)(lambda spark, sf: _asof_offset(spark, sf))


def _asof_offset(spark, sf):
    from tickloom.operators.stats import asof_offset

    return asof_offset(series_a(spark, sf), months=6)


query(
    "pair_self_join",
    f"""SELECT x.now, x.asset AS i, y.asset AS j, count(*) AS n, {rs('sum(x.r * y.r)', 9)} AS sxy FROM win_a x JOIN win_a y ON x.now = y.now AND x.date = y.date
WHERE x.wpos > 0 AND x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2, 3""",
    ("win_a",),
)(lambda spark, sf: _pairs(spark, sf))


def _pairs(spark, sf):
    from tickloom.operators.covariance import both_triangles, gram
    from tickloom.operators.estimators import window_returns

    calendar = cal_a(spark, sf)
    bridge = C.window_bridge(calendar, calendar, C.Offset(months=3))
    out = gram(window_returns(panel_a(spark, sf), calendar, bridge))
    return both_triangles(out.select("now", "i", "j", F.col("n").cast("long").alias("n"), rnd("sxy", 9).alias("sxy")))
