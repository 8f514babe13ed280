"""Weight and modifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import covariance as CV
from tickloom.operators import expected_returns as ER
from tickloom.operators import panels as P
from tickloom.operators import selection as S
from tickloom.operators import weights as W
from tickloom.workload.base import cte, panel_a, query, rnd, rs, sectors_a
from tickloom.workload.q_estimators import YEAR
from tickloom.workload.q_joins import WEIGHTS_A_SQL, weights_a
from tickloom.workload.q_panels import cal_a


def _w(df, digits=9):
    return df.select("date", "asset", rnd("weight", digits).alias("weight"))


def selected_a(spark, sf):
    """Names of any sector with a price on the date; those without a sector are no names."""
    return S.select_sector(S.select_all(panel_a(spark, sf)), sectors_a(spark, sf), [f"S{k}" for k in range(5)])


cte("sel", "SELECT pa.date, pa.asset FROM pa JOIN sec_a USING (asset) WHERE sector IS NOT NULL", "pa", "sec_a")
cte("wa", WEIGHTS_A_SQL.partition("AS (")[2][:-1], "pa")


def normal_sql(inner: str) -> str:
    """Scale weights to one per date; ``inner`` yields date, asset, w."""
    return f"SELECT date, asset, {rs('w / sum(w) OVER (PARTITION BY date)', 9)} AS weight FROM ({inner})"


# ------------------------------------------------------------------ plain weights
query("w_equal", f"SELECT date, asset, {rs('1.0 / count(*) OVER (PARTITION BY date)', 9)} AS weight FROM sel", ("sel",))(
    lambda spark, sf: _w(W.w_equal(selected_a(spark, sf)))
)
_FIXED = {"Brand#1": 0.5, "Brand#5": 0.25, "Brand#7": 0.25}
query(
    "w_fixed",
    normal_sql("SELECT date, asset, CASE asset WHEN 'Brand#1' THEN 0.5 ELSE 0.25 END AS w FROM sel WHERE asset IN ('Brand#1', 'Brand#5', 'Brand#7')"),
    ("sel",),
)(lambda spark, sf: _w(W.w_fixed(cal_a(spark, sf), _FIXED, selected_a(spark, sf))))
query(
    "w_fixed_as_given",
    "SELECT date, asset, weight FROM cal_a, (VALUES ('Brand#1', CAST(0.5 AS DOUBLE)), ('Brand#5', 0.25), ('Brand#7', 0.25)) t(asset, weight)",
    ("cal_a",),
)(lambda spark, sf: _w(W.w_fixed(cal_a(spark, sf), _FIXED)))
query(
    "w_schedule",
    normal_sql("SELECT n.date, w.asset, w.weight AS w FROM wa w JOIN cal_a c ON c.date = w.date JOIN cal_a n ON n.pos = c.pos + 1 JOIN sel s ON s.date = n.date AND s.asset = w.asset"),
    ("wa", "cal_a", "sel"),
)(lambda spark, sf: _w(W.w_schedule(weights_a(spark, sf), cal_a(spark, sf), cal_a(spark, sf), selected_a(spark, sf))))
query(
    "w_market_cap",
    normal_sql("SELECT n.date, p.asset, p.value AS w FROM pa p JOIN cal_a c ON c.date = p.date JOIN cal_a n ON n.pos = c.pos + 1 JOIN sel s ON s.date = n.date AND s.asset = p.asset WHERE p.value > 0"),
    ("pa", "cal_a", "sel"),
)(lambda spark, sf: _w(W.w_market_cap(selected_a(spark, sf), panel_a(spark, sf), cal_a(spark, sf))))
query(
    "w_random",
    normal_sql(
        "SELECT date, asset, -ln((CAST(('0x' || substr(md5(CAST(date AS VARCHAR) || '|' || asset || '|3'), 1, 12)) AS BIGINT) + 0.5) / pow(16, 12)) AS w FROM sel"
    ),
    ("sel",),
)(lambda spark, sf: _w(W.w_random(selected_a(spark, sf), 3)))


def year_cov(spark, sf):
    return CV.cov_sample(panel_a(spark, sf), cal_a(spark, sf), selected_a(spark, sf), YEAR)


cte(
    "cov_sel",
    """SELECT a.now AS date, a.asset AS i, b.asset AS j, (sum(a.r * b.r) - sum(a.r) * sum(b.r) / count(*)) / (count(*) - 1) AS cov
FROM w12 a JOIN w12 b ON a.now = b.now AND a.rpos = b.rpos JOIN sel x ON x.date = a.now AND x.asset = a.asset JOIN sel y ON y.date = b.now AND y.asset = b.asset
GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "w12",
    "sel",
)
query(
    "w_inv_vol",
    normal_sql("SELECT date, i AS asset, 1 / sqrt(cov) AS w FROM cov_sel WHERE i = j AND cov > 0"),
    ("cov_sel",),
)(lambda spark, sf: _w(W.w_inv_vol(selected_a(spark, sf), year_cov(spark, sf))))

# ------------------------------------------------------------------ modifiers
query("normalize_to_one", normal_sql("SELECT date, asset, weight AS w FROM wa JOIN sel USING (date, asset)"), ("wa", "sel"))(
    lambda spark, sf: _w(W.normalize_to_one(weights_a(spark, sf).join(selected_a(spark, sf), ["date", "asset"], "left_semi")))
)
query("m_scale", f"SELECT date, asset, {rs('weight * 0.4', 9)} AS weight FROM wa", ("wa",))(
    lambda spark, sf: _w(W.m_scale(weights_a(spark, sf), 0.4))
)
query(
    "m_limit_weights",
    f"""WITH RECURSIVE t(i, date, asset, w) AS (SELECT 0, date, asset, weight FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM wa) WHERE 0.045 >= 1.0 / n UNION ALL
SELECT i + 1, date, asset, CASE WHEN w > 0.045 + 1e-12 THEN 0.045 WHEN w < 0.045 - 1e-12 AND excess > 0 THEN w + w / under * excess ELSE w END FROM (
SELECT *, coalesce(sum(CASE WHEN w > 0.045 + 1e-12 THEN w - 0.045 END) OVER (PARTITION BY date), 0) AS excess, sum(CASE WHEN w < 0.045 - 1e-12 THEN w END) OVER (PARTITION BY date) AS under FROM t WHERE i < 40))
SELECT date, asset, {rs('w', 9)} AS weight FROM t WHERE i = 40
UNION ALL SELECT date, asset, {rs('weight', 9)} FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM wa) WHERE 0.045 < 1.0 / n""",
    ("wa",),
)(lambda spark, sf: _w(W.m_limit_weights(weights_a(spark, sf), 0.045), 9))


def _bounded_sql(base: str, limit: float, steps: int = 400) -> str:
    """Clip and rescale, literally; ``base`` yields date, asset, w, b."""
    return f"""WITH RECURSIVE x AS ({base}),
e AS (SELECT date, asset, w, b, {limit} + greatest(0, (sum(b - {limit}) OVER (PARTITION BY date) - 1) / count(*) OVER (PARTITION BY date),
(1 - sum(b + {limit}) OVER (PARTITION BY date)) / count(*) OVER (PARTITION BY date)) AS l FROM x),
t(i, date, asset, w, b, l) AS (SELECT 0, date, asset, w, b, l FROM e UNION ALL
SELECT i + 1, date, asset, least(greatest(w, b - l), b + l) / sum(least(greatest(w, b - l), b + l)) OVER (PARTITION BY date), b, l FROM t WHERE i < {steps})
SELECT date, asset, {rs('w', 6)} AS weight FROM t WHERE i = {steps} AND abs(w) >= 1e-12"""


def targets_a(spark, sf):
    """Concentrated targets: squares of the panel's weights, scaled to one."""
    return W.normalize_to_one(weights_a(spark, sf).withColumn("weight", F.pow("weight", F.lit(4))))


_TARGETS = "SELECT date, asset, pow(weight, 4) / sum(pow(weight, 4)) OVER (PARTITION BY date) AS w FROM wa"
query(
    "m_limit_deltas",
    _bounded_sql(
        f"SELECT t.date, t.asset, t.w, coalesce(b.weight, 0) AS b FROM ({_TARGETS}) t LEFT JOIN (SELECT * FROM wa WHERE asset <> 'Brand#3') b ON b.date = t.date AND b.asset = t.asset",
        0.02,
    ),
    ("wa",),
)(lambda spark, sf: _w(W.m_limit_deltas(targets_a(spark, sf), weights_a(spark, sf).where("asset <> 'Brand#3'"), 0.02), 6))
query(
    "m_limit_benchmark",
    _bounded_sql(
        f"SELECT s.date, s.asset, coalesce(t.w, 0) AS w, a.weight / sum(a.weight) OVER (PARTITION BY s.date) AS b FROM sel s JOIN wa a ON a.date = s.date AND a.asset = s.asset LEFT JOIN ({_TARGETS}) t ON t.date = s.date AND t.asset = s.asset",
        0.03,
    ),
    ("wa", "sel"),
)(lambda spark, sf: _w(W.m_limit_benchmark(targets_a(spark, sf), weights_a(spark, sf), 0.03, selected_a(spark, sf)), 6))


def _on_months(frame, months):
    return frame.where(F.month("date").isin(months))


query(
    "long_short_combine",
    f"""WITH l AS (SELECT date, asset, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM sel WHERE month(date) IN (1, 4, 7, 10)),
s AS (SELECT date, asset, weight AS w FROM wa WHERE month(date) IN (2, 4, 8)),
d AS (SELECT date FROM l UNION SELECT date FROM s),
c AS (SELECT d.date, (SELECT max(l.date) FROM l WHERE l.date <= d.date) AS ld, (SELECT max(s.date) FROM s WHERE s.date <= d.date) AS sd FROM d),
b AS (SELECT c.date, l.asset, 1.3 * l.w AS w FROM c JOIN l ON l.date = c.ld UNION ALL SELECT c.date, s.asset, -0.3 * s.w FROM c JOIN s ON s.date = c.sd)
SELECT date, asset, {rs('sum(w)', 9)} AS weight FROM b GROUP BY 1, 2 HAVING abs(sum(w)) >= 1e-12""",
    ("sel", "wa"),
)(
    lambda spark, sf: _w(
        W.long_short_combine(
            _on_months(W.w_equal(selected_a(spark, sf)), [1, 4, 7, 10]), _on_months(weights_a(spark, sf), [2, 4, 8]), 1.3, 0.3
        )
    )
)


def schedule_of(filled, calendar, sectors):
    """Quarterly schedule with changing members: nine tenths in two sectors by the price before."""
    visible = P.shift(filled, calendar).join(sectors, "asset")
    month = F.month("date")
    winter = month.isin([1, 7]) & F.col("sector").isin(["S1", "S2"])
    summer = month.isin([4, 10]) & F.col("sector").isin(["S2", "S3"])
    rows = visible.where(winter | summer)
    total = rows.groupBy("date").agg(F.sum("value").alias("_t"))
    return rows.join(total, "date").select("date", "asset", F.round(0.9 * F.col("value") / F.col("_t"), 9).alias("weight"))


def schedule_a(spark, sf):
    return schedule_of(filled_a(spark, sf), cal_a(spark, sf), sectors_a(spark, sf))


def filled_a(spark, sf):
    return P.ffill_bfill(panel_a(spark, sf), cal_a(spark, sf)).drop("pos")


cte(
    "fa",
    """SELECT date, pos, asset, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY pos ROWS UNBOUNDED PRECEDING),
first_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM grid_a""",
    "grid_a",
)
cte(
    "sch",
    """SELECT k.date, f.asset, round(0.9 * f.value / sum(f.value) OVER (PARTITION BY k.date), 9) AS weight FROM cal_a k JOIN fa f ON f.pos = k.pos - 1
JOIN sec_a s ON s.asset = f.asset WHERE (month(k.date) IN (1, 7) AND sector IN ('S1', 'S2')) OR (month(k.date) IN (4, 10) AND sector IN ('S2', 'S3'))""",
    "fa",
    "sec_a",
)
query(
    "transition_schedule",
    f"""WITH RECURSIVE turns AS (SELECT date, pos, row_number() OVER (ORDER BY pos) AS turn, least(5, coalesce(lead(pos) OVER (ORDER BY pos), (SELECT max(pos) + 1 FROM cal_a)) - pos) AS steps
FROM (SELECT DISTINCT date FROM sch) JOIN cal_a USING (date)),
g AS (SELECT t.turn, t.pos, t.steps, s.asset, s.weight AS goal FROM sch s JOIN turns t USING (date)),
r(turn, pos, steps, asset, origin, goal) AS (SELECT turn, pos, steps, asset, CAST(0 AS DOUBLE), goal FROM g WHERE turn = 1 UNION ALL
SELECT g.turn, g.pos, g.steps, g.asset, coalesce(r.origin + (r.goal - r.origin) * r.steps / 5, 0), g.goal FROM g
LEFT JOIN r ON r.asset = g.asset WHERE g.turn = (SELECT max(turn) + 1 FROM r))
SELECT c.date, r.asset, {rs('r.origin + (r.goal - r.origin) * k.k / 5', 9)} AS weight FROM r JOIN range(1, 6) k(k) ON k.k <= r.steps JOIN cal_a c ON c.pos = r.pos + k.k - 1
WHERE abs(r.origin + (r.goal - r.origin) * k.k / 5) >= 1e-12""",
    ("sch", "cal_a"),
)(lambda spark, sf: _w(W.transition_schedule(schedule_a(spark, sf), cal_a(spark, sf), 5)))

# ------------------------------------------------------------------ portfolio statistics
query(
    "portfolio_sharpe",
    f"""WITH w AS (SELECT date, asset, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM sel),
m AS (SELECT now AS date, asset, avg(r) AS m FROM w12 GROUP BY 1, 2),
g AS (SELECT w.date, sum(w.w * m.m) AS g FROM w JOIN m ON m.date = w.date AND m.asset = w.asset GROUP BY 1),
v AS (SELECT c.date, sum(a.w * c.cov * b.w) AS v FROM cov_sel c JOIN w a ON a.date = c.date AND a.asset = c.i JOIN w b ON b.date = c.date AND b.asset = c.j GROUP BY 1)
SELECT date, {rs('(g - 0.001) / sqrt(v)', 8)} AS sharpe FROM g JOIN v USING (date) WHERE v > 0""",
    ("sel", "w12", "cov_sel"),
)(lambda spark, sf: _sharpe(spark, sf))


def year_er(spark, sf):
    return ER.er_mean(panel_a(spark, sf), cal_a(spark, sf), selected_a(spark, sf), YEAR)


def _sharpe(spark, sf):
    out = W.portfolio_sharpe(W.w_equal(selected_a(spark, sf)), year_er(spark, sf), year_cov(spark, sf), 0.001)
    return out.select("date", rnd("sharpe", 8).alias("sharpe"))
