"""Accounting and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import fees as FE
from tickloom.operators import accounting as A
from tickloom.operators import calendar as C
from tickloom.operators import stats as ST
from tickloom.operators import weights as W
from tickloom.plans import research
from tickloom.session import cut_lineage
from tickloom.workload.base import cte, holdings, load, panel_a, query, rnd, rs, sectors_a, series_a
from tickloom.workload.q_panels import cal_a
from tickloom.workload.q_weights import filled_a, schedule_a, schedule_of, selected_a

CAPITAL = 1000.0


def _book_ctes(tag: str, prices: str, schedule: str, calendar: str = "cal_a") -> None:
    """Segments, growth, factors and values of a schedule as CTEs with a suffix."""
    cte(
        f"seg{tag}",
        f"""SELECT date AS seg, pos AS start, pos - 1 AS base_pos, coalesce(lead(pos) OVER (ORDER BY pos) - 1, (SELECT max(pos) FROM {calendar})) AS final
FROM (SELECT DISTINCT date FROM {schedule}) JOIN {calendar} USING (date) WHERE pos > 0""",
        schedule,
        calendar,
    )
    cte(
        f"gro{tag}",
        f"""SELECT s.seg, t.pos, t.date, h.asset, h.weight, b.value AS base, t.value AS price FROM seg{tag} s JOIN {schedule} h ON h.date = s.seg
JOIN {prices} b ON b.pos = s.base_pos AND b.asset = h.asset JOIN {prices} t ON t.pos BETWEEN s.start AND s.final AND t.asset = h.asset""",
        f"seg{tag}",
        prices,
    )
    cte(
        f"fac{tag}",
        f"SELECT seg, pos, 1 - sum(weight) + sum(weight * price / base) AS f, sum(weight) AS w FROM gro{tag} GROUP BY 1, 2",
        f"gro{tag}",
    )
    cte(
        f"val{tag}",
        f"""SELECT c.date, c.pos, f.seg, coalesce(f.f, 1) AS f, coalesce(f.w, 0) AS w, 1000 * coalesce(product(CASE WHEN f.pos = s.final THEN f.f END)
OVER (ORDER BY c.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS b FROM {calendar} c LEFT JOIN fac{tag} f ON f.pos = c.pos LEFT JOIN seg{tag} s ON s.seg = f.seg""",
        f"fac{tag}",
        f"seg{tag}",
        calendar,
    )


_book_ctes("", "fa", "sch")


def _args(spark, sf):
    """Filled panel, calendar and schedule; the first and the last are written once and read often."""
    prices = cut_lineage(filled_a(spark, sf))
    calendar = C.calendar_of(prices)
    return prices, calendar, cut_lineage(schedule_of(prices, calendar, sectors_a(spark, sf)))


def _line(df, digits=4):
    return df.select("date", *[rnd(c, digits).alias(c) for c in ("value", "cash", "index")])


_LINE_SQL = f"SELECT date, {rs('b * f', 4)} AS value, {rs('b * (1 - w)', 4)} AS cash, {rs('b * f / 10', 4)} AS \"index\" FROM "
query("nav", _LINE_SQL + "val", ("val",))(lambda spark, sf: _line(A.nav(*_args(spark, sf), CAPITAL)))
_LIVE = "1998-01-01"
_SHIFT = f"(SELECT pos FROM cal_a WHERE date = DATE '{_LIVE}')"
cte("cal_live", f"SELECT date, pos - {_SHIFT} AS pos FROM cal_a WHERE date >= DATE '{_LIVE}'", "cal_a")
cte("fa_live", f"SELECT date, pos - {_SHIFT} AS pos, asset, value FROM fa WHERE date >= DATE '{_LIVE}'", "fa", "cal_a")
cte("sch_live", "SELECT * FROM sch", "sch")
_book_ctes("_live", "fa_live", "sch_live", "cal_live")
query("nav_live_start", _LINE_SQL + "val_live", ("val_live",))(lambda spark, sf: _line(A.nav(*_args(spark, sf), CAPITAL, live_start=_LIVE)))
cte("sch_half", "SELECT date, asset, weight * (1 - 0.25) AS weight FROM sch", "sch")
_book_ctes("_half", "fa", "sch_half")
query("cash_reserve", _LINE_SQL + "val_half", ("val_half",))(lambda spark, sf: _line(A.nav(*_args(spark, sf), CAPITAL, cash=0.25)))

_CUTOFFS = "(VALUES ('Brand#2', DATE '1997-05-15'), ('Brand#7', DATE '1999-01-01'), ('Brand#11', DATE '2000-11-30')) k(asset, cutoff)"
cte(
    "cut",
    f"SELECT asset, min(date) AS date, min(pos) AS pos FROM {_CUTOFFS} JOIN cal_a ON date >= cutoff GROUP BY 1",
    "cal_a",
)
cte(
    "fa_cut",
    """SELECT f.date, f.pos, f.asset, CASE WHEN c.pos IS NOT NULL AND f.pos >= c.pos THEN g.value ELSE f.value END AS value FROM fa f
LEFT JOIN cut c ON c.asset = f.asset LEFT JOIN fa g ON g.asset = c.asset AND g.pos = c.pos - 1""",
    "fa",
    "cut",
)
cte("sch_cut", "SELECT s.* FROM sch s LEFT JOIN cut c ON c.asset = s.asset WHERE c.date IS NULL OR s.date < c.date", "sch", "cut")
_book_ctes("_cut", "fa_cut", "sch_cut")


def cutoffs(spark):
    rows = [("Brand#2", "1997-05-15"), ("Brand#7", "1999-01-01"), ("Brand#11", "2000-11-30")]
    return spark.createDataFrame(rows, "asset string, cutoff string").withColumn("cutoff", F.col("cutoff").cast("date"))


query(
    "auto_close",
    f"SELECT date, {rs('b * f', 4)} AS value, {rs('b * f / 10', 4)} AS \"index\" FROM val_cut",
    ("val_cut",),
)(lambda spark, sf: _line(A.nav(*_args(spark, sf), CAPITAL, cutoffs=cutoffs(spark))).select("date", "value", "index"))


# money in every May, out every July (a trade date)
_FLOW_SQL = "CASE WHEN month(c.date) = 5 THEN 50.0 WHEN month(c.date) = 7 THEN -20.0 ELSE 0.0 END"


def flows(spark, sf):
    amount = F.when(F.month("date") == 5, 50.0).when(F.month("date") == 7, -20.0)
    return cal_a(spark, sf).select("date", amount.alias("amount")).where(F.col("amount").isNotNull())


cte(
    "flowing",
    f"SELECT c.date, c.pos, v.seg, v.f, s.start = c.pos AS opens, {_FLOW_SQL} AS flow FROM cal_a c JOIN val v ON v.pos = c.pos LEFT JOIN seg s ON s.seg = v.seg",
    "val",
    "seg",
)
_FLOW_LOOP = """WITH RECURSIVE t(pos, date, flow, b, extra, v) AS (SELECT pos, date, flow, CAST(1000 AS DOUBLE), CAST(flow AS DOUBLE), CAST(1000 + flow AS DOUBLE) FROM flowing WHERE pos = 0 UNION ALL
SELECT n.pos, n.date, n.flow, CASE WHEN n.opens THEN t.v + n.flow ELSE t.b END, CASE WHEN n.opens THEN 0 ELSE t.extra + n.flow END,
CASE WHEN n.opens THEN (t.v + n.flow) * n.f ELSE t.b * n.f + t.extra + n.flow END FROM t JOIN flowing n ON n.pos = t.pos + 1),
i AS (SELECT *, v / (coalesce(lag(v) OVER (ORDER BY pos), 1000) + flow) AS step FROM t)"""
query(
    "capital_flow",
    f"{_FLOW_LOOP} SELECT date, {rs('v', 3)} AS value, {rs('100 * product(step) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING)', 4)} AS \"index\" FROM i",
    ("flowing",),
)(lambda spark, sf: _flow_line(spark, sf))


def _flow_line(spark, sf):
    out = A.nav(*_args(spark, sf), CAPITAL, flows=flows(spark, sf))
    return out.select("date", rnd("value", 3).alias("value"), rnd("index", 4).alias("index"))


query(
    "strategy_index",
    f"""{_FLOW_LOOP} SELECT date, {rs('100 * product(CASE WHEN pos = 0 THEN 1 ELSE step END) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING)', 4)} AS "index" FROM i""",
    ("flowing",),
)(lambda spark, sf: _index(spark, sf))


def _index(spark, sf):
    moves = flows(spark, sf)
    values = A.nav(*_args(spark, sf), CAPITAL, flows=moves).select("date", "value")
    return A.strategy_index(values, moves).select("date", rnd("index", 4).alias("index"))


_DRIFT = """SELECT g.date, g.asset, g.weight * g.price / g.base / f.f AS w FROM gro g JOIN fac f ON f.seg = g.seg AND f.pos = g.pos"""
query(
    "drifted_weights",
    f"SELECT date, asset, {rs('w', 9)} AS weight FROM ({_DRIFT} UNION ALL SELECT date, 'Cash', (1 - w) / f FROM val)",
    ("gro", "fac", "val"),
)(lambda spark, sf: A.drifted_weights(*_args(spark, sf), CAPITAL).select("date", "asset", rnd("weight", 9).alias("weight")))
query(
    "w_current",
    f"""WITH d AS ({_DRIFT}), l AS (SELECT d.date, d.asset, d.w / sum(d.w) OVER (PARTITION BY d.date) AS w FROM d JOIN sel USING (date, asset)),
e AS (SELECT date, asset, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM sel)
SELECT date, asset, {rs('w', 9)} AS weight FROM (SELECT * FROM l UNION ALL SELECT * FROM e WHERE date NOT IN (SELECT date FROM l))""",
    ("gro", "fac", "sel"),
)(lambda spark, sf: _current(spark, sf))


def _current(spark, sf):
    chosen = selected_a(spark, sf)
    drifted = A.drifted_weights(*_args(spark, sf), CAPITAL)
    out = W.w_current(chosen, drifted, W.w_equal(chosen))
    return out.select("date", "asset", rnd("weight", 9).alias("weight"))


query(
    "member_weights",
    f"""WITH d AS ({_DRIFT}) SELECT date, 'parent>S>' || asset AS member, {rs('w * 0.6', 9)} AS weight FROM d
UNION ALL SELECT DISTINCT date, 'parent>S', {rs('0.6', 9)} FROM cal_a""",
    ("gro", "fac", "cal_a"),
)(lambda spark, sf: _members(spark, sf))


def _members(spark, sf):
    child = A.drifted_weights(*_args(spark, sf), CAPITAL).where(F.col("asset") != A.CASH).withColumn("child", F.lit("S"))
    parent = cal_a(spark, sf).select("date", F.lit("S").alias("asset"), F.lit(0.6).alias("weight"))
    return A.member_weights(child, parent).select("date", "member", rnd("weight", 9).alias("weight"))


query(
    "positions",
    f"SELECT g.date, g.asset, {rs('g.weight * v.b / g.base', 8)} AS quantity FROM gro g JOIN val v ON v.pos = g.pos",
    ("gro", "val"),
)(lambda spark, sf: A.positions(*_args(spark, sf), CAPITAL).select("date", "asset", rnd("quantity", 8).alias("quantity")))
cte(
    "trd",
    """SELECT date, pos, asset, q - lag(q, 1, 0) OVER (PARTITION BY asset ORDER BY pos) AS dq, price, execution FROM (
SELECT s.seg AS date, s.start AS pos, a.asset, coalesce(h.weight * v.b / e.value, 0) AS q, t.value AS price, e.value AS execution FROM seg s
CROSS JOIN (SELECT DISTINCT asset FROM fa) a JOIN fa e ON e.pos = s.base_pos AND e.asset = a.asset JOIN fa t ON t.pos = s.start AND t.asset = a.asset
JOIN val v ON v.pos = s.start LEFT JOIN sch h ON h.date = s.seg AND h.asset = a.asset)""",
    "seg",
    "fa",
    "val",
    "sch",
)
query(
    "transactions",
    f"SELECT date, asset, {rs('dq', 8)} AS quantity, price FROM trd WHERE abs(dq) > 1e-12",
    ("trd",),
)(lambda spark, sf: A.transactions(*_args(spark, sf), CAPITAL).select("date", "asset", rnd("quantity", 8).alias("quantity"), "price"))
query(
    "outlays",
    f"SELECT date, asset, {rs('dq * execution', 5)} AS outlay FROM trd WHERE abs(dq) > 1e-12",
    ("trd",),
)(lambda spark, sf: A.outlays(*_args(spark, sf), CAPITAL).select("date", "asset", rnd("outlay", 5).alias("outlay")))
query(
    "turnover",
    f"""WITH s AS (SELECT pos, sum(greatest(dq * execution, 0)) AS buy, sum(greatest(-dq * execution, 0)) AS sell FROM trd GROUP BY 1)
SELECT v.date, {rs('coalesce(least(buy, sell), 0) / (b * f)', 8)} AS turnover FROM val v LEFT JOIN s ON s.pos = v.pos""",
    ("trd", "val"),
)(lambda spark, sf: A.turnover(*_args(spark, sf), CAPITAL).select("date", rnd("turnover", 8).alias("turnover")))

# ------------------------------------------------------------------ one book with every input at once
# long and short names on borrowed money, closings, flows, a reserve and a live start
_SIGNED = "CASE WHEN CAST(split_part(asset, '#', 2) AS INTEGER) % 3 = 0 THEN -0.5 ELSE 1.75 END"
cte("cut_mix", f"SELECT asset, min(date) AS date, min(pos) AS pos FROM {_CUTOFFS} JOIN cal_live ON date >= cutoff GROUP BY 1", "cal_live")
cte(
    "fa_mix",
    """SELECT f.date, f.pos, f.asset, CASE WHEN c.pos IS NOT NULL AND f.pos >= c.pos THEN g.value ELSE f.value END AS value FROM fa_live f
LEFT JOIN cut_mix c ON c.asset = f.asset LEFT JOIN fa_live g ON g.asset = c.asset AND g.pos = c.pos - 1 WHERE f.pos >= 0""",
    "fa_live",
    "cut_mix",
)
cte(
    "sch_mix",
    f"SELECT s.date, s.asset, s.weight * {_SIGNED.replace('asset', 's.asset')} * (1 - 0.1) AS weight FROM sch s LEFT JOIN cut_mix c ON c.asset = s.asset WHERE c.date IS NULL OR s.date < c.date",
    "sch",
    "cut_mix",
)
_book_ctes("_mix", "fa_mix", "sch_mix", "cal_live")
cte(
    "flow_mix",
    f"""SELECT c.date, c.pos, f.seg, coalesce(f.f, 1) AS f, coalesce(f.w, 0) AS w, coalesce(s.start = c.pos, FALSE) AS opens, {_FLOW_SQL} AS flow
FROM cal_live c LEFT JOIN fac_mix f ON f.pos = c.pos LEFT JOIN seg_mix s ON s.seg = f.seg""",
    "fac_mix",
    "seg_mix",
    "cal_live",
)
# day by day: base of the segment, money that waits for the next trade, value
_MIX = """WITH RECURSIVE m(pos, date, flow, w, b, extra, v) AS (SELECT pos, date, flow, CAST(w AS DOUBLE), CAST(1000 AS DOUBLE), CAST(flow AS DOUBLE), CAST(1000 + flow AS DOUBLE) FROM flow_mix WHERE pos = 0 UNION ALL
SELECT n.pos, n.date, n.flow, n.w, CASE WHEN n.opens THEN m.v + n.flow ELSE m.b END, CASE WHEN n.opens THEN 0 ELSE m.extra + n.flow END,
CASE WHEN n.opens THEN (m.v + n.flow) * n.f ELSE m.b * n.f + m.extra + n.flow END FROM m JOIN flow_mix n ON n.pos = m.pos + 1),
held AS (SELECT g.seg, g.pos, g.date, g.asset, g.weight * m.b / g.base AS q, g.price, coalesce(g.pos >= c.pos, FALSE) AS closed FROM gro_mix g JOIN m ON m.pos = g.pos LEFT JOIN cut_mix c ON c.asset = g.asset),
sold AS (SELECT pos, sum(q * price) AS s FROM held WHERE closed GROUP BY 1),
book AS (SELECT m.*, m.b * (1 - m.w) + m.extra + coalesce(s, 0) AS cash, product(CASE WHEN m.pos = 0 THEN 1 ELSE m.v / (p.v + m.flow) END) OVER (ORDER BY m.pos) * 100 * (SELECT v / (1000 + flow) FROM m WHERE pos = 0) AS idx
FROM m LEFT JOIN m p ON p.pos = m.pos - 1 LEFT JOIN sold ON sold.pos = m.pos),
day AS (SELECT a.asset, c.pos, c.date, coalesce(h.q, 0) AS q FROM (SELECT DISTINCT asset FROM fa) a CROSS JOIN cal_live c LEFT JOIN held h ON h.pos = c.pos AND h.asset = a.asset AND NOT h.closed),
turn AS (SELECT start AS pos FROM seg_mix UNION SELECT pos FROM cut_mix),
trade AS (SELECT d.date, d.pos, d.asset, d.q - lag(d.q, 1, 0) OVER (PARTITION BY d.asset ORDER BY d.pos) AS dq, t.value AS price, e.value AS execution FROM day d SEMI JOIN turn USING (pos)
LEFT JOIN fa_live t ON t.pos = d.pos AND t.asset = d.asset LEFT JOIN fa_live e ON e.pos = d.pos - 1 AND e.asset = d.asset)
"""
_MIX_CTES = ("flow_mix", "gro_mix", "cut_mix", "seg_mix", "fa_live", "fa", "cal_live")


def _mixed(report, spark, sf):
    prices, calendar, schedule = _args(spark, sf)
    number = F.split_part("asset", F.lit("#"), F.lit(2)).cast("int")
    signed = schedule.withColumn("weight", F.col("weight") * F.when(number % 3 == 0, -0.5).otherwise(1.75))
    return report(
        prices, calendar, signed, CAPITAL, cash=0.1, cutoffs=cutoffs(spark), flows=flows(spark, sf), live_start=_LIVE, margin=True
    )


def _mix_query(name: str, sql: str, report, digits: int, *rounded: str) -> None:
    def run(spark, sf):
        out = _mixed(report, spark, sf)
        return out.select(*[rnd(c, digits).alias(c) if c in rounded else c for c in out.columns])

    query(f"book_{name}", _MIX + sql, _MIX_CTES)(run)


_mix_query("nav", f"SELECT date, {rs('v', 3)} AS value, {rs('cash', 3)} AS cash, {rs('idx', 3)} AS \"index\" FROM book", A.nav, 3, "value", "cash", "index")
_mix_query("positions", f"SELECT date, asset, {rs('q', 6)} AS quantity FROM held WHERE NOT closed", A.positions, 6, "quantity")
_mix_query(
    "drifted_weights",
    f"""SELECT date, asset, {rs('w', 8)} AS weight FROM (SELECT h.date, h.asset, h.q * h.price / m.v AS w FROM held h JOIN m USING (pos) WHERE NOT closed
UNION ALL SELECT date, 'Cash', cash / v FROM book)""",
    A.drifted_weights, 8, "weight",
)
_mix_query("transactions", f"SELECT date, asset, {rs('dq', 6)} AS quantity, price FROM trade WHERE abs(dq) > 1e-12", A.transactions, 6, "quantity")
_mix_query("outlays", f"SELECT date, asset, {rs('dq * execution', 4)} AS outlay FROM trade WHERE abs(dq) > 1e-12", A.outlays, 4, "outlay")
_mix_query(
    "turnover",
    f"""SELECT b.date, {rs('coalesce(least(buy, sell), 0) / v', 7)} AS turnover FROM book b LEFT JOIN (
SELECT pos, sum(greatest(dq * execution, 0)) AS buy, sum(greatest(-dq * execution, 0)) AS sell FROM trade GROUP BY 1) t USING (pos)""",
    A.turnover, 7, "turnover",
)

# ------------------------------------------------------------------ fees, on order lines as trades
_Q = "(CASE WHEN l_linenumber % 5 = 0 THEN 0 WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE -l_quantity END)"
_N = f"(abs({_Q}) * l_extendedprice)"
_FEES = {
    "zero": ("0", {}),
    "quantity_tiered": (f"greatest(100, abs({_Q}) * 0.0021)", {}),
    "notional_bps": (f"{_N} * 0.0025", {}),
    "fixed": (f"CASE WHEN {_Q} = 0 THEN 0 ELSE 1 END", {}),
    "per_share": (f"abs({_Q}) * 0.005", {}),
    "per_share_bounded": (f"CASE WHEN {_Q} = 0 THEN 0 ELSE least(0.2, greatest(0.1, abs({_Q}) * 0.005)) END", {"minimum": 0.1, "maximum": 0.2}),
    "notional_bps_min": (f"CASE WHEN {_N} = 0 THEN 0 ELSE greatest(2000, {_N} * 0.0025) END", {"minimum": 2000.0}),
    "notional_tiers": (f"{_N} * CASE WHEN {_N} <= 100000 THEN 10 WHEN {_N} <= 1000000 THEN 5 ELSE 2.5 END / 10000", {}),
    "sell_regulatory": (
        f"CASE WHEN {_Q} < 0 THEN {_N} * 0.3 / 10000 + least(abs({_Q}) * 0.01, 0.3) ELSE 0 END",
        {"notional_bps": 0.3, "per_share": 0.01, "per_share_cap": 0.3},
    ),
}


def lines_as_trades(spark, sf):
    signed = (
        F.when(F.col("l_linenumber") % 5 == 0, 0.0)
        .when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity"))
        .otherwise(-F.col("l_quantity"))
    )
    return load(spark, sf, "lineitem").select(
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date"), signed.alias("quantity"), F.col("l_extendedprice").alias("execution")
    )


for _name, (_sql, _kw) in _FEES.items():
    query(
        f"commission_{_name}",
        f"SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, {rs(f'sum({_sql})', 3)} AS fee FROM lineitem GROUP BY 1",
    )(
        lambda spark, sf, name=_name, kw=_kw: A.fees(
            lines_as_trades(spark, sf), lambda q, p: FE.COMMISSIONS[name](q, p, **kw)
        ).withColumn("fee", rnd("fee", 3))
    )

# ------------------------------------------------------------------ failure states and balances

def falling(spark, sf):
    """Panel values as value lines, one portfolio per brand, some of which go under."""
    broke = F.when((F.col("date") >= F.lit("1999-06-01").cast("date")) & F.col("asset").isin("Brand#1", "Brand#9"), F.col("value") - 100000)
    return panel_a(spark, sf).select(F.col("asset").alias("book"), "date", F.coalesce(broke, F.col("value")).alias("value"))


query(
    "bankruptcy_flag",
    """WITH v AS (SELECT asset AS book, date, CASE WHEN date >= DATE '1999-06-01' AND asset IN ('Brand#1', 'Brand#9') THEN value - 100000 ELSE value END AS value FROM pa),
b AS (SELECT book, min(date) AS d FROM v WHERE value < -1e-12 GROUP BY 1)
SELECT v.book, v.date, v.value FROM v LEFT JOIN b USING (book) WHERE b.d IS NULL OR v.date <= b.d""",
    ("pa",),
)(lambda spark, sf: A.cut_at_bankruptcy(falling(spark, sf), ["book"]))
query(
    "missing_price_check",
    """SELECT c.date, h.asset FROM seg s JOIN sch h ON h.date = s.seg JOIN cal_a c ON c.pos BETWEEN s.base_pos AND s.final
LEFT JOIN (SELECT date, asset, CASE WHEN month(date) <> 6 THEN value END AS value FROM pa) p ON p.date = c.date AND p.asset = h.asset WHERE p.value IS NULL GROUP BY 1, 2""",
    ("seg", "pa"),
)(
    lambda spark, sf: A.missing_prices(
        # prices of June are null
        panel_a(spark, sf).withColumn("value", F.when(F.month("date") != 6, F.col("value"))), cal_a(spark, sf), schedule_a(spark, sf)
    )
)


@query(
    "nested_strategy",
    f"""WITH n AS (SELECT date, pos, asset, value FROM fa UNION ALL SELECT date, pos, 'child', b * f / 10 FROM val),
w AS (SELECT date, 'child' AS asset, 0.5 AS weight FROM cal_a WHERE month(date) = 1 UNION ALL SELECT date, 'Brand#4', 0.4 FROM cal_a WHERE month(date) = 1),
s AS (SELECT date AS seg, pos AS start, coalesce(lead(pos) OVER (ORDER BY pos) - 1, (SELECT max(pos) FROM cal_a)) AS final FROM (SELECT DISTINCT date FROM w) JOIN cal_a USING (date) WHERE pos > 0),
f AS (SELECT s.seg, t.pos, 1 - sum(w.weight) + sum(w.weight * t.value / b.value) AS f FROM s JOIN w ON w.date = s.seg JOIN n b ON b.pos = s.start - 1 AND b.asset = w.asset
JOIN n t ON t.pos BETWEEN s.start AND s.final AND t.asset = w.asset GROUP BY 1, 2)
SELECT c.date, {rs('1000 * coalesce(product(CASE WHEN f.pos = s.final THEN f.f END) OVER (ORDER BY c.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) * coalesce(f.f, 1)', 4)} AS value
FROM cal_a c LEFT JOIN f ON f.pos = c.pos LEFT JOIN s ON s.seg = f.seg""",
    ("fa", "val", "cal_a"),
)
def _nested(spark, sf):
    prices, calendar, schedule = _args(spark, sf)
    child = A.nav(prices, calendar, schedule, CAPITAL).select("date", F.lit("child").alias("child"), "index")
    names = F.explode(F.create_map(F.lit("child"), F.lit(0.5), F.lit("Brand#4"), F.lit(0.4))).alias("asset", "weight")
    parent = calendar.where("month(date) = 1").select("date", names)
    out = A.nav(A.nested_prices(prices, child), calendar, parent, CAPITAL)
    return out.select("date", rnd("value", 4).alias("value"))


query(
    "margin_interest",
    f"""SELECT book, date, {rs("CASE WHEN cash < 0 THEN coalesce(-cash * (pow(1.08, date_diff('day', lag(date) OVER w, date) / 365.25) - 1), 0) ELSE 0 END")} AS interest,
coalesce(value / nullif(exposure, 0) < 0.3, FALSE) AS breach FROM (SELECT c_mktsegment AS book, CAST(o_orderdate AS DATE) AS date, min(o_totalprice) - 60000 AS cash, avg(o_totalprice) AS value, max(o_totalprice) AS exposure
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WINDOW w AS (PARTITION BY book ORDER BY date)""",
)(lambda spark, sf: _margin(spark, sf))


def _margin(spark, sf):
    customers = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("book"))
    rows = (
        load(spark, sf, "orders")
        .join(customers, "o_custkey")
        .groupBy("book", F.col("o_orderdate").cast("date").alias("date"))
        .agg(
            (F.min("o_totalprice") - 60000).alias("cash"),
            F.avg("o_totalprice").alias("value"),
            F.max("o_totalprice").alias("exposure"),
        )
    )
    out = A.margin_interest(rows, 0.08, 0.3, ["book"])
    return out.select("book", "date", rnd("interest").alias("interest"), "breach")


# two decimals, halves to the even digit
_EVEN = "(CASE WHEN f.value * 100 - floor(f.value * 100) = 0.5 THEN 2 * round(f.value * 50) ELSE round(f.value * 100) END / 100)"


@query(
    "backfill_holdings",
    f"""WITH k AS (SELECT FIGI, TICKER, QUANTITY, WEIGHT FROM hold WHERE "INDEX" = 'MACHINERY' AND "DATE" = DATE '1997-01-01'),
c AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT "DATE" AS date FROM hold)),
p AS (SELECT c.date, c.pos, FIGI, round(avg(MARKET_VALUE / QUANTITY), 6) AS value FROM hold JOIN c ON c.date = hold."DATE" GROUP BY 1, 2, 3),
g AS (SELECT c.date, c.pos, a.FIGI, p.value FROM c CROSS JOIN (SELECT DISTINCT FIGI FROM p) a LEFT JOIN p ON p.pos = c.pos AND p.FIGI = a.FIGI),
f AS (SELECT date, pos, FIGI, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY FIGI ORDER BY pos ROWS UNBOUNDED PRECEDING), first_value(value IGNORE NULLS) OVER (PARTITION BY FIGI ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM g),
t AS (SELECT t.date, t.FIGI, k.WEIGHT * t.value / b.value AS x FROM k JOIN f b ON b.FIGI = k.FIGI AND b.date = DATE '1997-01-01' JOIN f t ON t.FIGI = k.FIGI AND t.date > DATE '1997-01-01' AND t.date <= DATE '1998-06-01'),
v AS (SELECT date, (SELECT 1 - sum(WEIGHT) FROM k) + sum(x) AS v FROM t GROUP BY 1)
SELECT t.date AS "DATE", t.FIGI, k.TICKER, k.QUANTITY, {rs('t.x / v.v', 9)} AS WEIGHT, {_EVEN} AS PRICE, {rs(f'k.QUANTITY * {_EVEN}', 4)} AS MARKET_VALUE
FROM t JOIN v USING (date) JOIN k USING (FIGI) JOIN f ON f.date = t.date AND f.FIGI = t.FIGI""",
    ("hold",),
)
def _backfill(spark, sf):
    from tickloom.operators.panels import ffill_bfill

    rows = holdings(spark, sf)
    quotes = rows.groupBy(F.col("DATE").alias("date"), F.col("FIGI").alias("asset")).agg(
        F.round(F.avg(F.col("MARKET_VALUE") / F.col("QUANTITY")), 6).alias("value")
    )
    calendar = C.calendar_of(rows.select(F.col("DATE").alias("date")))
    prices = ffill_bfill(quotes, calendar).drop("pos")
    out = A.backfill_holdings(rows, prices, calendar, "MACHINERY", "1997-01-01", "1998-06-01")
    return out.select(
        "DATE", "FIGI", "TICKER", "QUANTITY", rnd("WEIGHT", 9).alias("WEIGHT"), "PRICE", rnd("MARKET_VALUE", 4).alias("MARKET_VALUE")
    )


# ------------------------------------------------------------------ statistics
_TRAIL = {"3m": 3, "6m": 6, "1y": 12, "3y": 36, "5y": 60, "10y": 120}


def stats_sql(source: str, rf: float = 0.02, digits: int = 6) -> str:
    """The 37 statistics of ``source`` (series, ts, price) with daily rows."""
    per = f"(pow({1 + rf!r}, 1.0 / 252) - 1)"

    def periods(unit: str) -> str:
        return f"""SELECT series, p, price, price / lag(price) OVER (PARTITION BY series ORDER BY p) - 1 AS r, lag(price) OVER (PARTITION BY series ORDER BY p) AS prev,
price / lag(price, 12) OVER (PARTITION BY series ORDER BY p) - 1 AS r12, row_number() OVER (PARTITION BY series ORDER BY p DESC) AS k
FROM (SELECT series, date_trunc('{unit}', ts) AS p, arg_max(price, ts) AS price FROM {source} GROUP BY 1, 2)"""

    trailing = ", ".join(
        f"""(SELECT arg_max(x.price, x.ts) FROM {source} x WHERE x.series = a.series AND x.ts <= CAST(a.e - INTERVAL {m} MONTH AS DATE)) AS "a{n}" """
        for n, m in _TRAIL.items()
    )
    years = "(date_diff('day', s, e) * 86400.0 / 31557600)"
    cagr = f"(pow(l / f, 1 / {years}) - 1)"
    out = {
        "total_return": "l / f - 1",
        "incep": f"CASE WHEN {years} < 1 THEN l / f - 1 ELSE {cagr} END",
        "cagr": cagr,
        "mtd": "l / coalesce(am, f) - 1",
        "qtd": "l / coalesce(aq, f) - 1",
        "ytd": "l / coalesce(ay, f) - 1",
        **{n: f'l / "a{n}" - 1' for n in _TRAIL},
        "max_drawdown": "mdd",
        "calmar": f"{cagr} / abs(mdd)",
        "daily_mean_ann": "m * 252",
        "daily_vol_ann": "sd * sqrt(252)",
        "daily_skew": "sk",
        "daily_kurt": "ku",
        "var_95": "v5",
        "cvar_95": "(SELECT avg(d.r) FROM d WHERE d.series = z.series AND d.r <= z.v5)",
        "hit_rate_daily": "hit",
        "sharpe": "xm / xs * sqrt(252)",
        "sortino": "xm / ds * sqrt(252)",
        "best_day": "bd",
        "worst_day": "wd",
        "best_month": "bm",
        "worst_month": "wm",
        "best_year": "yb",
        "worst_year": "yw",
        "avg_up_month": "um",
        "avg_down_month": "dm",
        "pos_month_perc": "pm",
        "win_year_perc": "wy",
        "twelve_month_win_perc": "tw",
    }
    columns = ", ".join(f'{rs(expr, digits)} AS "{name}"' for name, expr in out.items())
    return f"""WITH d AS (SELECT series, ts, price, price / lag(price) OVER w - 1 AS r, price / max(price) OVER (PARTITION BY series ORDER BY ts) - 1 AS dd,
price < max(price) OVER (PARTITION BY series ORDER BY ts) AS u FROM {source} WINDOW w AS (PARTITION BY series ORDER BY ts)),
runs AS (SELECT series, max(n) AS n FROM (SELECT series, g, count(*) FILTER (WHERE u) AS n FROM (SELECT *, sum(CASE WHEN u THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY ts) AS g FROM d) GROUP BY 1, 2) GROUP BY 1),
mo AS ({periods('month')}), qu AS ({periods('quarter')}), yr AS ({periods('year')}),
a AS (SELECT series, min(ts) AS s, max(ts) AS e, arg_min(price, ts) AS f, arg_max(price, ts) AS l, min(dd) AS mdd, avg(r) AS m, stddev_samp(r) AS sd, skewness(r) AS sk, kurtosis(r) AS ku,
quantile_cont(r, 0.05) AS v5, avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) AS hit, avg(r - {per}) AS xm, stddev_samp(r - {per}) AS xs,
stddev_samp(CASE WHEN r IS NOT NULL THEN least(r - {per}, 0) END) AS ds, max(r) AS bd, min(r) AS wd FROM d GROUP BY 1),
b AS (SELECT series, max(prev) FILTER (WHERE k = 1) AS am, max(r) AS bm, min(r) AS wm, avg(r) FILTER (WHERE r > 0) AS um, avg(r) FILTER (WHERE r <= 0) AS dm,
avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) AS pm, avg(CASE WHEN r12 > 0 THEN 1.0 WHEN r12 IS NOT NULL THEN 0.0 END) AS tw FROM mo GROUP BY 1),
q AS (SELECT series, max(prev) FILTER (WHERE k = 1) AS aq FROM qu GROUP BY 1),
y AS (SELECT series, max(prev) FILTER (WHERE k = 1) AS ay, max(r) AS yb, min(r) AS yw, avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) AS wy FROM yr GROUP BY 1),
z AS (SELECT a.*, runs.n, b.* EXCLUDE (series), q.aq, y.* EXCLUDE (series), {trailing} FROM a JOIN runs USING (series) JOIN b USING (series) JOIN q USING (series) JOIN y USING (series))
SELECT series, s AS "start", e AS "end", n AS max_drawdown_duration, {columns} FROM z"""


def _rounded(df, digits=6):
    keep = ("start", "end", "max_drawdown_duration")
    return df.select("series", *[F.col(c) if c in keep else rnd(f"`{c}`", digits).alias(c) for c in ST.STATISTICS])


query("perf_stats", stats_sql("ser"), ("ser",))(lambda spark, sf: _rounded(ST.perf_stats(series_a(spark, sf), 0.02)))
query(
    "stats_table",
    f"""WITH w AS ({stats_sql('ser', 0.0)}) SELECT series, statistic, value FROM (SELECT series, CAST(date_diff('day', DATE '1970-01-01', "start") AS DOUBLE) AS "start",
CAST(date_diff('day', DATE '1970-01-01', "end") AS DOUBLE) AS "end", CAST(max_drawdown_duration AS DOUBLE) AS max_drawdown_duration, * EXCLUDE (series, "start", "end", max_drawdown_duration) FROM w)
UNPIVOT INCLUDE NULLS (value FOR statistic IN (* EXCLUDE (series)))""",
    ("ser",),
)(lambda spark, sf: ST.stats_table(series_a(spark, sf)).withColumn("value", rnd("value")))

# ------------------------------------------------------------------ the whole chain
cte(
    "mom_sch",
    """SELECT k.date, t.asset, 1.0 / 5 AS weight FROM (SELECT date, pos FROM (SELECT date, pos, quarter(date) <> lag(quarter(date)) OVER (ORDER BY pos) AS turn, max(pos) OVER () AS last FROM cal_a)
WHERE pos > 0 AND (pos = 1 OR (pos < last AND turn))) k JOIN (SELECT c.pos, x.asset, row_number() OVER (PARTITION BY x.now ORDER BY round(arg_max(x.value, x.date) / arg_min(x.value, x.date) - 1, 9) DESC, x.asset) AS rn FROM (
SELECT n.date AS now, f.date, f.asset, f.value FROM cal_a n JOIN fa f ON f.date BETWEEN CAST(n.date - INTERVAL 3 MONTH AS DATE) AND n.date) x JOIN cal_a c ON c.date = x.now GROUP BY c.pos, x.now, x.asset) t
ON t.pos = k.pos - 1 AND t.rn <= 5""",
    "fa",
)
_book_ctes("_mom", "fa", "mom_sch")
cte("mom_ser", "SELECT 'momentum' AS series, date AS ts, b * f / 10 AS price FROM val_mom", "val_mom")


def _chain(spark, sf):
    return research.run(
        panel_a(spark, sf),
        lambda prices, calendar: research.momentum_schedule(prices, calendar, C.run_quarterly),
        CAPITAL,
        "momentum",
    )


query("research_chain", stats_sql("mom_ser", 0.0, 5), ("mom_ser",))(lambda spark, sf: _rounded(_chain(spark, sf)[1], 5))
query("research_nav", _LINE_SQL + "val_mom", ("val_mom",))(lambda spark, sf: _line(_chain(spark, sf)[0]))
