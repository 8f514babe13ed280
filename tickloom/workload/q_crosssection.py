"""Factor, signal and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import factors as FA
from tickloom.operators import selection as S
from tickloom.operators import signals as SG
from tickloom.operators.calendar import Offset
from tickloom.workload.base import cte, panel_a, panel_b, query, rnd, rs, sectors_a
from tickloom.workload.q_joins import WEIGHTS_A_SQL, weights_a
from tickloom.workload.q_panels import cal_a, cal_b


def _factor(df, digits=9):
    return df.select("date", "asset", rnd("factor", digits).alias("factor"))


def tr_a(spark, sf, **kw):
    """Three-month total return of panel A on every date."""
    calendar = cal_a(spark, sf)
    return FA.total_return(panel_a(spark, sf), calendar, calendar, **kw)


cte(
    "tr_raw",
    """SELECT now AS date, asset, arg_max(value, date) / nullif(arg_min(value, date), 0) - 1 AS f FROM win_a WHERE value IS NOT NULL GROUP BY 1, 2""",
    "win_a",
)
cte("tr_a", "SELECT date, asset, round(f, 9) AS f FROM tr_raw", "tr_raw")


cte("tr_p", "SELECT t.date, t.asset, t.f FROM tr_a t JOIN pa p ON p.date = t.date AND p.asset = t.asset", "tr_a")


def metric_a(spark, sf):
    """The total return rounded, so that both engines rank the same numbers."""
    return tr_a(spark, sf).withColumn("factor", F.round("factor", 9))


# ------------------------------------------------------------------ factors
query("total_return", f"SELECT date, asset, {rs('f', 9)} AS factor FROM tr_a", ("tr_a",))(lambda spark, sf: _factor(tr_a(spark, sf)))
query(
    "total_return_lagged",
    f"""SELECT n.date, p.asset, {rs('arg_max(p.value, p.date) / nullif(arg_min(p.value, p.date), 0) - 1', 9)} AS factor FROM cal_b n
JOIN pb p ON p.date BETWEEN CAST(n.date - INTERVAL 10 DAY AS DATE) AND CAST(n.date - INTERVAL 2 DAY AS DATE) GROUP BY 1, 2""",
    ("pb", "cal_b"),
)(
    lambda spark, sf: _factor(
        FA.total_return(panel_b(spark, sf), cal_b(spark, sf), cal_b(spark, sf), Offset(days=10), Offset(days=2))
    )
)
query(
    "simple_moving_average",
    f"SELECT now AS date, asset, {rs('avg(value)', 9)} AS factor FROM win_a WHERE value IS NOT NULL GROUP BY 1, 2",
    ("win_a",),
)(lambda spark, sf: _factor(FA.simple_moving_average(panel_a(spark, sf), cal_a(spark, sf), cal_a(spark, sf))))
query(
    "simple_moving_median",
    f"SELECT now AS date, asset, {rs('median(value)', 9)} AS factor FROM win_a WHERE value IS NOT NULL GROUP BY 1, 2",
    ("win_a",),
)(lambda spark, sf: _factor(FA.simple_moving_average(panel_a(spark, sf), cal_a(spark, sf), cal_a(spark, sf), measure="median")))
_ALPHA = 1 - 2 ** (-1 / 5)
cte(
    "ew_b",
    f"""SELECT pos, asset, sum(b * value * exp(ln_n - ln_k)) AS y FROM (
SELECT n.pos, n.asset, k.value, k.b, n.l AS ln_n, k.l AS ln_k FROM (
  SELECT *, sum(la) OVER (PARTITION BY asset ORDER BY pos) AS l FROM (
    SELECT *, CASE WHEN g IS NULL THEN 1 ELSE {_ALPHA} / (pow({1 - _ALPHA}, g) + {_ALPHA}) END AS b,
    CASE WHEN g IS NULL THEN 0 ELSE ln(pow({1 - _ALPHA}, g) / (pow({1 - _ALPHA}, g) + {_ALPHA})) END AS la FROM (
      SELECT c.pos, p.asset, p.value, c.pos - lag(c.pos) OVER (PARTITION BY p.asset ORDER BY c.pos) AS g FROM pb p JOIN cal_b c USING (date)))) n
JOIN (
  SELECT *, sum(la) OVER (PARTITION BY asset ORDER BY pos) AS l FROM (
    SELECT *, CASE WHEN g IS NULL THEN 1 ELSE {_ALPHA} / (pow({1 - _ALPHA}, g) + {_ALPHA}) END AS b,
    CASE WHEN g IS NULL THEN 0 ELSE ln(pow({1 - _ALPHA}, g) / (pow({1 - _ALPHA}, g) + {_ALPHA})) END AS la FROM (
      SELECT c.pos, p.asset, p.value, c.pos - lag(c.pos) OVER (PARTITION BY p.asset ORDER BY c.pos) AS g FROM pb p JOIN cal_b c USING (date)))) k
ON k.asset = n.asset AND k.pos <= n.pos) GROUP BY 1, 2""",
    "cal_b",
    "pb",
)
query(
    "ewma",
    f"""SELECT g.date, g.asset, {rs('last_value(e.y IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.pos ROWS UNBOUNDED PRECEDING)', 9)} AS factor
FROM grid_b g LEFT JOIN ew_b e ON e.asset = g.asset AND e.pos = g.pos QUALIFY factor IS NOT NULL""",
    ("grid_b", "ew_b"),
)(lambda spark, sf: _factor(FA.ewma(panel_b(spark, sf), cal_b(spark, sf), cal_b(spark, sf), half_life=5)))
query(
    "kernel_moving_average",
    f"SELECT now AS date, asset, {rs('sum(pow(wpos + 1, 2) * value) / sum(pow(wpos + 1, 2))', 9)} AS factor FROM win_a WHERE value IS NOT NULL GROUP BY 1, 2",
    ("win_a",),
)(lambda spark, sf: _factor(FA.kernel_moving_average(panel_a(spark, sf), cal_a(spark, sf), cal_a(spark, sf), k=2)))
query("set_factor", "SELECT date, asset, value AS factor FROM pa", ("pa",))(
    lambda spark, sf: FA.set_factor(panel_a(spark, sf), cal_a(spark, sf))
)
query(
    "standardize",
    f"""SELECT date, asset, {rs('CASE WHEN s > 0 THEN (f - m) / s ELSE 0 END', 5)} AS factor FROM (SELECT *, avg(f) OVER (PARTITION BY date) AS m, stddev_pop(f) OVER (PARTITION BY date) AS s FROM tr_a)""",
    ("tr_a",),
)(lambda spark, sf: _factor(FA.standardize(metric_a(spark, sf)), 5))
query(
    "factor_stats",
    f"""SELECT date, {rs('avg(f)', 9)} AS MEAN, {rs('quantile_cont(f, 0.5)', 9)} AS MEDIAN, {rs('quantile_cont(f, 0.25)', 9)} AS "25TH", {rs('quantile_cont(f, 0.75)', 9)} AS "75TH" FROM tr_raw GROUP BY 1""",
    ("tr_raw",),
)(lambda spark, sf: _stats(FA.factor_stats(tr_a(spark, sf))))


def _stats(df):
    return df.select("date", *[rnd(f"`{c}`", 9).alias(c) for c in ("MEAN", "MEDIAN", "25TH", "75TH")])


def part_factor(spark, sf):
    """Total return with the brands 1 to 9 missing."""
    return tr_a(spark, sf).where("length(asset) > 7")


@query(
    "factor_coverage",
    f"""WITH {WEIGHTS_A_SQL}, m AS (SELECT p.date, p.asset, t.f, CASE WHEN length(p.asset) > 7 THEN t.f IS NOT NULL ELSE FALSE END AS known, coalesce(w.weight, 0) AS w FROM pa p
LEFT JOIN tr_a t ON t.date = p.date AND t.asset = p.asset LEFT JOIN wa w ON w.date = p.date AND w.asset = p.asset AND p.asset <> 'Brand#12')
SELECT date, count(*) FILTER (WHERE known) AS covered, {rs('avg(CASE WHEN known THEN 1.0 ELSE 0.0 END)')} AS share,
{rs('sum(CASE WHEN known THEN w ELSE 0 END) / sum(w)')} AS market_share FROM m GROUP BY 1""",
    ("pa", "tr_a"),
)
def _coverage(spark, sf):
    market = weights_a(spark, sf).where("asset <> 'Brand#12'")
    out = FA.factor_coverage(part_factor(spark, sf), panel_a(spark, sf).select("date", "asset"), market)
    return out.select("date", "covered", rnd("share").alias("share"), rnd("market_share").alias("market_share"))


query("generic_factor", f"SELECT date, asset, {rs('value * 0.5', 9)} AS factor FROM pa", ("pa",))(
    lambda spark, sf: _factor(
        FA.generic_factor(
            panel_a(spark, sf),
            cal_a(spark, sf),
            lambda panel, dates: panel.select("date", "asset", (F.col("value") * 0.5).alias("factor")),
        )
    )
)

# ------------------------------------------------------------------ signals
query(
    "price_crossover",
    """WITH m AS (SELECT now AS date, asset, avg(value) AS m FROM win_a WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT p.date, p.asset, coalesce(p.value > m.m, FALSE) AS flag FROM pa p LEFT JOIN m ON m.date = p.date AND m.asset = p.asset""",
    ("win_a", "pa"),
)(lambda spark, sf: SG.price_crossover(panel_a(spark, sf), cal_a(spark, sf), cal_a(spark, sf)))
query(
    "dual_ma_crossover",
    """WITH s AS (SELECT now AS date, asset, avg(value) AS m FROM win_a WHERE value IS NOT NULL GROUP BY 1, 2),
l AS (SELECT n.date, p.asset, avg(p.value) AS m FROM cal_a n JOIN pa p ON p.date BETWEEN CAST(n.date - INTERVAL 9 MONTH AS DATE) AND n.date GROUP BY 1, 2)
SELECT l.date, l.asset, coalesce(round(s.m - l.m, 9) > 0, FALSE) AS flag FROM l LEFT JOIN s ON s.date = l.date AND s.asset = l.asset""",
    ("win_a", "pa", "cal_a"),
)(
    lambda spark, sf: _dual(spark, sf)
)


def _dual(spark, sf):
    calendar = cal_a(spark, sf)
    short = {"lookback": Offset(months=3)}
    long = {"lookback": Offset(months=9)}
    return SG.dual_ma_crossover(panel_a(spark, sf), calendar, calendar, short, long)


query(
    "momentum",
    "SELECT date, asset FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY f DESC, asset) AS rn FROM tr_p) WHERE rn <= 5",
    ("tr_p",),
)(lambda spark, sf: _momentum(spark, sf))


def _momentum(spark, sf):
    calendar, panel = cal_a(spark, sf), panel_a(spark, sf)
    pool = S.select_all(panel)
    return SG.momentum(
        panel, calendar, calendar, lambda f: S.select_n(f.withColumn("factor", F.round("factor", 9)), pool, 5)
    )


query(
    "signal_history",
    "SELECT date, asset, coalesce(value > 20, FALSE) AS flag FROM grid_b",
    ("grid_b",),
)(
    lambda spark, sf: SG.signal_history(
        panel_b(spark, sf).where("value > 20"), cal_b(spark, sf), panel_b(spark, sf)
    )
)

# ------------------------------------------------------------------ selection

def pool_a(spark, sf):
    return S.select_all(panel_a(spark, sf))


query("select_all", "SELECT date, asset FROM pb WHERE value > 0", ("pb",))(lambda spark, sf: S.select_all(panel_b(spark, sf)))
query(
    "select_all_no_data",
    "SELECT date, asset FROM grid_b WHERE day(date) % 7 = 1",
    ("grid_b",),
)(lambda spark, sf: _all_no_data(spark, sf))


def _all_no_data(spark, sf):
    from tickloom.operators.panels import densify

    calendar = cal_b(spark, sf)
    return S.select_all(densify(panel_b(spark, sf), calendar), calendar.where("day(date) % 7 = 1"), include_no_data=True)


query(
    "select_has_data",
    """WITH w AS (SELECT n.date AS now, count(*) AS wlen FROM cal_b n JOIN cal_b c ON c.date BETWEEN n.date - 3 AND n.date GROUP BY 1)
SELECT n.date, p.asset FROM cal_b n JOIN pb p ON p.date BETWEEN n.date - 3 AND n.date JOIN w ON w.now = n.date
WHERE EXISTS (SELECT 1 FROM pb q WHERE q.date = n.date AND q.asset = p.asset AND q.value > 0) GROUP BY n.date, p.asset, w.wlen HAVING count(*) = w.wlen""",
    ("pb", "cal_b"),
)(lambda spark, sf: S.select_has_data(panel_b(spark, sf), cal_b(spark, sf), S.select_all(panel_b(spark, sf)), Offset(days=3)))
query(
    "select_active",
    "SELECT date, asset FROM pb WHERE NOT (asset IN ('U1', 'U2') AND date >= DATE '2024-01-10') AND NOT (asset = 'U3' AND date >= DATE '2024-01-20')",
    ("pb",),
)(
    lambda spark, sf: S.select_active(
        panel_b(spark, sf),
        panel_b(spark, sf)
        .where("asset IN ('U1', 'U2', 'U3')")
        .select("asset", F.when(F.col("asset") == "U3", "2024-01-20").otherwise("2024-01-10").cast("date").alias("since")),
    )
)
query(
    "select_is_open",
    f"WITH {WEIGHTS_A_SQL} SELECT p.date, p.asset FROM pa p WHERE EXISTS (SELECT 1 FROM wa WHERE wa.date = p.date AND wa.asset = p.asset AND weight > 0.04)",
    ("pa",),
)(lambda spark, sf: S.select_is_open(pool_a(spark, sf), weights_a(spark, sf).withColumn("weight", F.when(F.col("weight") > 0.04, F.col("weight")).otherwise(0.0))))
query("select_these", "SELECT date, asset FROM pb WHERE asset IN ('U1', 'U5', 'U7') AND value > 0", ("pb",))(
    lambda spark, sf: S.select_these(panel_b(spark, sf), panel_b(spark, sf), ["U1", "U5", "U7", "nobody"])
)
query("select_where", "SELECT date, asset FROM pb WHERE value > 25", ("pb",))(
    lambda spark, sf: S.select_where(
        panel_b(spark, sf), panel_b(spark, sf), panel_b(spark, sf).select("date", "asset", F.when(F.col("value") != 5, F.col("value") > 25).alias("flag"))
    )
)
query("select_sector", "SELECT date, asset FROM pa WHERE asset IN (SELECT asset FROM sec_a WHERE sector IN ('S1', 'S3'))", ("pa", "sec_a"))(
    lambda spark, sf: S.select_sector(pool_a(spark, sf), sectors_a(spark, sf), ["S1", "S3"])
)
query("remove_securities", "SELECT date, asset FROM pa WHERE asset NOT IN ('Brand#1', 'Brand#2')", ("pa",))(
    lambda spark, sf: S.remove_securities(pool_a(spark, sf), ["Brand#1", "Brand#2"])
)
query(
    "add_security",
    "SELECT date, asset FROM pb WHERE value > 0 AND (asset IN ('U1', 'U2') OR value > 25) AND date IN (SELECT date FROM pb WHERE value > 25)",
    ("pb",),
)(
    lambda spark, sf: S.add_security(
        panel_b(spark, sf),
        panel_b(spark, sf).where("value > 25"),
        ["U1", "U2", "U3"],
        closed=panel_b(spark, sf).where("asset = 'U3'"),
    )
)
query(
    "select_randomly",
    "SELECT date, asset FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY md5(CAST(date AS VARCHAR) || '|' || asset || '|7')) AS rn FROM pb) WHERE rn <= 10",
    ("pb",),
)(lambda spark, sf: S.select_randomly(panel_b(spark, sf), 10, seed=7))
query(
    "select_n",
    "SELECT date, asset FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY f, asset) AS rn FROM tr_p) WHERE rn <= 4",
    ("tr_p",),
)(lambda spark, sf: S.select_n(metric_a(spark, sf), pool_a(spark, sf), 4, descending=False))
query(
    "select_n_fraction",
    """SELECT date, asset FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY f DESC, asset) AS rn, count(*) OVER (PARTITION BY date) AS n FROM tr_p)
WHERE rn <= greatest(floor(n * 0.3), 1)""",
    ("tr_p",),
)(lambda spark, sf: S.select_n(metric_a(spark, sf), pool_a(spark, sf), 0.3))
query(
    "select_quantile",
    "SELECT date, asset FROM (SELECT *, ntile(4) OVER (PARTITION BY date ORDER BY f DESC, asset) AS t FROM tr_p) WHERE t = 2",
    ("tr_p",),
)(lambda spark, sf: S.select_quantile(metric_a(spark, sf), pool_a(spark, sf), 4, 2))
query(
    "sector_double_sort",
    """SELECT date, asset FROM (SELECT t.*, ntile(2) OVER (PARTITION BY date, sector ORDER BY f DESC, asset) AS t FROM tr_p t JOIN sec_a USING (asset) WHERE sector IS NOT NULL) WHERE t = 1""",
    ("tr_p", "sec_a"),
)(lambda spark, sf: S.sector_double_sort(metric_a(spark, sf), pool_a(spark, sf), sectors_a(spark, sf), 2))
query(
    "standard_double_sort",
    """WITH a AS (SELECT t.date, t.asset, p.value AS v, ntile(3) OVER (PARTITION BY t.date ORDER BY t.f DESC, t.asset) AS t1 FROM tr_p t JOIN pa p ON p.date = t.date AND p.asset = t.asset)
SELECT date, asset FROM (SELECT *, ntile(2) OVER (PARTITION BY date, t1 ORDER BY v, asset) AS t2 FROM a) WHERE t2 = 1""",
    ("tr_p", "pa"),
)(
    lambda spark, sf: S.standard_double_sort(
        metric_a(spark, sf), panel_a(spark, sf).withColumnRenamed("value", "factor"), pool_a(spark, sf), 3, 2, descending=False
    )
)
query(
    "selection_stats",
    f"SELECT date, count(*) AS TOTAL_NAMES, {rs('avg(f)', 9)} AS MEAN, {rs('median(f)', 9)} AS MEDIAN FROM tr_raw JOIN pa USING (date, asset) WHERE asset IN (SELECT asset FROM sec_a WHERE sector IS NOT NULL) GROUP BY 1",
    ("tr_raw", "pa", "sec_a"),
)(lambda spark, sf: _selection_stats(spark, sf))


def _selection_stats(spark, sf):
    chosen = S.select_sector(pool_a(spark, sf), sectors_a(spark, sf), ["S0", "S1", "S2", "S3", "S4"])
    out = S.selection_stats(tr_a(spark, sf), chosen)
    return out.select("date", "TOTAL_NAMES", rnd("MEAN", 9).alias("MEAN"), rnd("MEDIAN", 9).alias("MEDIAN"))


query(
    "ranked_metric",
    "SELECT date, asset, f AS factor FROM tr_p WHERE asset <> 'Brand#5' AND asset IN (SELECT asset FROM sec_a WHERE sector IS NOT NULL)",
    ("tr_p", "sec_a"),
)(
    lambda spark, sf: S.ranked_metric(
        metric_a(spark, sf).withColumn("factor", F.when(F.col("asset") == "Brand#5", float("nan")).otherwise(F.col("factor"))),
        S.select_sector(pool_a(spark, sf), sectors_a(spark, sf), ["S0", "S1", "S2", "S3", "S4"]),
    )
)
