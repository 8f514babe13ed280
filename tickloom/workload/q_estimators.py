"""Expected-return and covariance queries, over twelve-month windows of panel A."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import covariance as CV
from tickloom.operators import expected_returns as ER
from tickloom.operators.calendar import Offset, calendar_of
from tickloom.operators.estimators import coverage_filter, history, of_pool
from tickloom.operators.panels import returns
from tickloom.operators.selection import select_all
from tickloom.session import cut_lineage
from tickloom.workload.base import cte, panel_a, query, rnd, rs

YEAR = Offset(months=12)


def _edges(start: str, end: str) -> str:
    """Windows per calendar date as SQL: return rows with their position and the window's row count."""
    return f"""SELECT s.now, h.date, h.asset, h.r, h.pos - s.p0 - 1 AS rpos, s.n - 1 AS rlen FROM (
SELECT n.date AS now, min(c.pos) AS p0, max(c.pos) AS p1, count(*) AS n FROM cal_a n JOIN cal_a c ON c.date BETWEEN {start} AND {end} GROUP BY 1) s
JOIN ret_a h ON h.pos > s.p0 AND h.pos <= s.p1 WHERE h.r IS NOT NULL"""


_BACK = "CAST(n.date - INTERVAL 12 MONTH AS DATE)"
cte("w12", _edges(_BACK, "n.date"), "ret_a")
cte("w12p", "SELECT w.* FROM w12 w JOIN pa p ON p.date = w.now AND p.asset = w.asset", "w12")
cte("w12lag", _edges(_BACK, "CAST(n.date - INTERVAL 2 MONTH AS DATE)"), "ret_a")
cte("w12fwd", _edges(_BACK, "CAST(n.date + INTERVAL 3 MONTH AS DATE)"), "ret_a")
cte(
    "w12x",
    """SELECT w.now, w.asset, w.r - b.r AS r, w.rpos, w.rlen FROM w12p w JOIN (SELECT date, r FROM ret_a WHERE asset = 'Brand#1' AND r IS NOT NULL) b ON b.date = w.date""",
    "w12p",
)
cte(
    "cc12",
    """SELECT k.now, k.asset, k.r, c.q AS rpos, c.n AS rlen FROM w12p k
JOIN (SELECT now, asset FROM w12p GROUP BY now, asset, rlen HAVING count(*) * 1.0 / rlen >= 0.8) e ON e.now = k.now AND e.asset = k.asset
JOIN (SELECT now, rpos, row_number() OVER (PARTITION BY now ORDER BY rpos) - 1 AS q, count(*) OVER (PARTITION BY now) AS n FROM (
  SELECT k.now, k.rpos, count(*) AS m FROM w12p k JOIN (SELECT now, asset FROM w12p GROUP BY now, asset, rlen HAVING count(*) * 1.0 / rlen >= 0.8) e
  ON e.now = k.now AND e.asset = k.asset GROUP BY 1, 2) x
  JOIN (SELECT now, count(*) AS p FROM (SELECT now, asset FROM w12p GROUP BY now, asset, rlen HAVING count(*) * 1.0 / rlen >= 0.8) GROUP BY 1) y USING (now) WHERE m = p) c
ON c.now = k.now AND c.rpos = k.rpos""",
    "w12p",
)


def _args(spark, sf):
    panel = cut_lineage(panel_a(spark, sf))
    return panel, calendar_of(panel), select_all(panel)


def _er(df):
    return df.select("date", "asset", rnd("expected_return", 9).alias("expected_return"))


def _register(name, expr, fn, source="w12p", ctes=None):
    query(
        name,
        f"SELECT now AS date, asset, {rs(expr, 9)} AS expected_return FROM {source} GROUP BY 1, 2",
        ctes or (source,),
    )(lambda spark, sf: _er(fn(*_args(spark, sf))))


def _ew(decay: float, x: str) -> str:
    return f"(sum(pow({decay!r}, rlen - 1 - rpos) * {x}) / sum(pow({decay!r}, rlen - 1 - rpos)))"


# ------------------------------------------------------------------ expected returns
_register("er_mean", "avg(r)", lambda p, c, s: ER.er_mean(p, c, s, YEAR))
_register("er_log_mean", "avg(ln(1 + r))", lambda p, c, s: ER.er_log_mean(p, c, s, YEAR))
_register("er_median", "median(r)", lambda p, c, s: ER.er_median(p, c, s, YEAR))
_register("er_ewma", _ew(0.8, "r"), lambda p, c, s: ER.er_ewma(p, c, s, YEAR, alpha=0.2))
_LIVES = [2, 4, 8]
_register(
    "er_blended",
    "(" + " + ".join(_ew(0.5 ** (1 / h), "ln(1 + r)") for h in _LIVES) + ") / 3",
    lambda p, c, s: ER.er_blended(p, c, s, YEAR, halflives=_LIVES),
)
_QUANTILES = """(SELECT *, quantile_cont(r, 0.1) OVER (PARTITION BY now, asset) AS lo, quantile_cont(r, 0.9) OVER (PARTITION BY now, asset) AS hi FROM w12p)"""
_register("er_trimmed", "avg(r) FILTER (WHERE r BETWEEN lo AND hi)", lambda p, c, s: ER.er_trimmed(p, c, s, YEAR), _QUANTILES, ("w12p",))
_register("er_winsorized", "avg(least(greatest(r, lo), hi))", lambda p, c, s: ER.er_winsorized(p, c, s, YEAR), _QUANTILES, ("w12p",))
_register(
    "er_excess",
    "avg(r)",
    lambda p, c, s: ER.er_excess(p, c, s, _benchmark(p, c), lookback=YEAR),
    "w12x",
)
_register(
    "er_realized",
    "avg(r)",
    lambda p, c, s: ER.er_realized(p, c, s, Offset(months=3), lookback=YEAR),
    "(SELECT w.* FROM w12fwd w JOIN pa ON pa.date = w.now AND pa.asset = w.asset)",
    ("w12fwd", "pa"),
)
_register(
    "er_history",
    "median(r)",
    lambda p, c, s: ER.er_median(p, c, s, YEAR, Offset(months=2)),
    "(SELECT w.* FROM w12lag w JOIN pa ON pa.date = w.now AND pa.asset = w.asset)",
    ("w12lag", "pa"),
)


def _benchmark(panel, calendar):
    own = returns(panel, calendar).where("asset = 'Brand#1' AND value IS NOT NULL")
    return own.select("date", F.col("value").alias("benchmark"))


# ------------------------------------------------------------------ covariance
def _cov(df, digits=9):
    return CV.both_triangles(df).select("date", "i", "j", rnd("cov", digits).alias("cov"))


def _pairs_sql(value: str, source: str, x: str = "r", having: str = "", digits: int = 9) -> str:
    return f"""WITH s AS (SELECT now, asset, rpos, rlen, {x} AS v FROM {source})
SELECT a.now AS date, a.asset AS i, b.asset AS j, {rs(value, digits)} AS cov FROM s a JOIN s b ON a.now = b.now AND a.rpos = b.rpos GROUP BY 1, 2, 3 {having}"""


_SAMPLE = "(sum(a.v * b.v) - sum(a.v) * sum(b.v) / count(*)) / (count(*) - 1)"
_POP = "(sum(a.v * b.v) - sum(a.v) * sum(b.v) / count(*)) / count(*)"
_TWO = "HAVING count(*) > 1"
query("cov_sample", _pairs_sql(_SAMPLE, "w12p", having=_TWO), ("w12p",))(
    lambda spark, sf: _cov(CV.cov_sample(*_args(spark, sf), YEAR))
)
query("cov_log", _pairs_sql(_SAMPLE, "w12p", "ln(1 + r)", _TWO), ("w12p",))(
    lambda spark, sf: _cov(CV.cov_log(*_args(spark, sf), YEAR))
)
query("cov_semi", _pairs_sql("sum(a.v * b.v) / count(*)", "w12p", "least(r - 0.01, 0)"), ("w12p",))(
    lambda spark, sf: _cov(CV.cov_semi(*_args(spark, sf), YEAR, threshold_return=0.01))
)


def _ew_cov_sql(decay: float) -> str:
    w = f"pow({decay!r}, a.rlen - 1 - a.rpos)"
    return (
        f"(sum({w} * a.v * b.v) / sum({w}) - sum({w} * a.v) / sum({w}) * sum({w} * b.v) / sum({w}))"
        f" * pow(sum({w}), 2) / (pow(sum({w}), 2) - sum({w} * {w}))"
    )


query("cov_ewma", _pairs_sql(_ew_cov_sql(0.5 ** (1 / 4)), "w12p", having=_TWO), ("w12p",))(
    lambda spark, sf: _cov(CV.cov_ewma(*_args(spark, sf), YEAR, halflife=4))
)
_PAIRS = [(2, 3), (3, 6)]
_REGIME_TERMS = " + ".join(
    f"CASE WHEN x.i = x.j THEN 1.0 WHEN p.c{c} <= 0 OR q.c{c} <= 0 THEN 0.0 ELSE greatest(least(x.c{c} / sqrt(p.c{c}) / sqrt(q.c{c}), 1.0), -1.0) END * sqrt(greatest(p.c{v}, 0)) * sqrt(greatest(q.c{v}, 0))"
    for v, c in _PAIRS
)
query(
    "cov_regime_blended",
    f"""WITH s AS (SELECT now, asset, rpos, rlen, ln(1 + r) AS v FROM cc12),
g AS (SELECT a.now, a.asset AS i, b.asset AS j, {", ".join(f"{_ew_cov_sql(0.5 ** (1 / h))} AS c{h}" for h in (2, 3, 6))}
FROM s a JOIN s b ON a.now = b.now AND a.rpos = b.rpos GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT x.now AS date, x.i, x.j, {rs(f"({_REGIME_TERMS}) / 2")} AS cov FROM g x JOIN g p ON p.now = x.now AND p.i = x.i AND p.j = x.i JOIN g q ON q.now = x.now AND q.i = x.j AND q.j = x.j""",
    ("cc12",),
)(lambda spark, sf: _cov(CV.cov_regime_blended(*_args(spark, sf), YEAR, halflife_pairs=_PAIRS), 6))
query("cov_excess", _pairs_sql(_SAMPLE, "w12x", having=_TWO), ("w12x",))(lambda spark, sf: _excess(spark, sf))


def _excess(spark, sf):
    panel, calendar, pool = _args(spark, sf)
    return _cov(CV.cov_excess(panel, calendar, pool, _benchmark(panel, calendar), lookback=YEAR))


query(
    "cov_realized",
    _pairs_sql(_SAMPLE, "(SELECT w.* FROM w12fwd w JOIN pa ON pa.date = w.now AND pa.asset = w.asset)", having=_TWO),
    ("w12fwd", "pa"),
)(lambda spark, sf: _cov(CV.cov_realized(*_args(spark, sf), Offset(months=3), lookback=YEAR)))
query("cov_empirical", _pairs_sql(_POP, "cc12", "ln(1 + r)"), ("cc12",))(
    lambda spark, sf: _cov(CV.cov_empirical(*_args(spark, sf), YEAR))
)
_EMPIRICAL_CTES = f"""s AS (SELECT now, asset, rpos, rlen, r AS v FROM cc12),
g AS (SELECT a.now, a.asset AS i, b.asset AS j, count(*) AS n, {_POP} AS c FROM s a JOIN s b ON a.now = b.now AND a.rpos = b.rpos GROUP BY 1, 2, 3),
m AS (SELECT now, max(n) AS n, count(*) FILTER (WHERE i = j) AS p, sum(c) FILTER (WHERE i = j) AS tr, sum(c * c) AS sq FROM g GROUP BY 1)"""
query(
    "cov_oas",
    f"""WITH {_EMPIRICAL_CTES},
k AS (SELECT now, tr / p AS mu, CASE WHEN (n + 1) * (sq / (p * p) - pow(tr / p, 2) / p) = 0 THEN 1 ELSE least(1, (sq / (p * p) + pow(tr / p, 2)) / ((n + 1) * (sq / (p * p) - pow(tr / p, 2) / p))) END AS s FROM m)
SELECT g.now AS date, i, j, {rs("(1 - s) * c + CASE WHEN i = j THEN s * mu ELSE 0 END", 8)} AS cov FROM g JOIN k USING (now)""",
    ("cc12",),
)(lambda spark, sf: _cov(CV.cov_oas(*_args(spark, sf), YEAR), 8))
query(
    "cov_ledoit_wolf",
    f"""WITH {_EMPIRICAL_CTES}, z AS (SELECT now, rpos, v - avg(v) OVER (PARTITION BY now, asset) AS v FROM s),
f AS (SELECT now, sum(q * q) AS f FROM (SELECT now, rpos, sum(v * v) AS q FROM z GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT now, tr / p AS mu, (f / n - sq) / (p * n) AS beta, (sq - 2 * tr / p * tr + p * pow(tr / p, 2)) / p AS delta FROM m JOIN f USING (now)),
k AS (SELECT now, mu, CASE WHEN least(beta, delta) = 0 THEN 0 ELSE least(beta, delta) / delta END AS s FROM b)
SELECT g.now AS date, i, j, {rs("(1 - s) * c + CASE WHEN i = j THEN s * mu ELSE 0 END", 8)} AS cov FROM g JOIN k USING (now)""",
    ("cc12",),
)(lambda spark, sf: _cov(CV.cov_ledoit_wolf(*_args(spark, sf), YEAR), 8))
query("annualize_cov", _pairs_sql(f"252 * {_SAMPLE}", "w12p", having=_TWO, digits=7), ("w12p",))(
    lambda spark, sf: _cov(CV.annualize_cov(CV.cov_sample(*_args(spark, sf), YEAR)), 7)
)
query("coverage_filter", f"SELECT now, asset, rpos, rlen, {rs('r', 9)} AS value FROM cc12", ("cc12",))(
    lambda spark, sf: _coverage(spark, sf)
)


def _coverage(spark, sf):
    panel, calendar, pool = _args(spark, sf)
    rows = coverage_filter(of_pool(history(panel, calendar, pool, YEAR), pool))
    return rows.select("now", "asset", F.col("rpos").cast("long").alias("rpos"), F.col("rlen").cast("long").alias("rlen"), rnd("value", 9).alias("value"))
