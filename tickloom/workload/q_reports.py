"""Report-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import factors, reports
from tickloom.workload.base import load, panel_a, panel_b, query, rnd, rs, sectors_a, series_a
from tickloom.workload.q_crosssection import tr_a
from tickloom.workload.q_joins import weights_a


def brand_names(spark, sf):
    """Display names: brands as FIGIs, tickers shared by the brands of a sector number."""
    number = F.split_part("asset", F.lit("#"), F.lit(2)).cast("int")
    brands = panel_a(spark, sf).select("asset").distinct()
    mapping = brands.where(number % 10 != 0).select(F.col("asset").alias("FIGI"), F.concat(F.lit("T"), number % 20).alias("TICKER"))
    mapping = mapping.unionByName(
        brands.where(number % 10 == 0).select(F.col("asset").alias("FIGI"), F.lit(None).cast("string").alias("TICKER"))
    )
    reverse = mapping.where("TICKER IS NOT NULL").groupBy("TICKER").agg(F.min("FIGI").alias("FIGI"))
    return reports.display_names(mapping, reverse)


_NAMES = """bn AS (SELECT DISTINCT asset AS FIGI, CAST(split_part(asset, '#', 2) AS INTEGER) AS n FROM pa),
mp AS (SELECT FIGI, CASE WHEN n % 10 <> 0 THEN 'T' || (n % 20) END AS TICKER FROM bn),
rv AS (SELECT TICKER, min(FIGI) AS F FROM mp WHERE TICKER IS NOT NULL GROUP BY 1),
nm AS (SELECT mp.FIGI, CASE WHEN mp.TICKER IS NULL THEN mp.FIGI WHEN rv.F = mp.FIGI THEN mp.TICKER ELSE mp.TICKER || ' (' || mp.FIGI || ')' END AS NAME FROM mp LEFT JOIN rv USING (TICKER))"""
query("display_name", f"WITH {_NAMES} SELECT FIGI, NAME FROM nm", ("pa",))(lambda spark, sf: brand_names(spark, sf))
query(
    "rpt_current_weights",
    f"WITH {_NAMES} SELECT NAME AS name, weight FROM wa JOIN nm ON nm.FIGI = wa.asset WHERE date = (SELECT max(date) FROM wa)",
    ("wa", "pa"),
)(lambda spark, sf: reports.rpt_current_weights(weights_a(spark, sf), brand_names(spark, sf)))
query(
    "rpt_security_weights",
    f"WITH {_NAMES} SELECT date, NAME AS name, weight FROM wa JOIN nm ON nm.FIGI = wa.asset",
    ("wa", "pa"),
)(lambda spark, sf: reports.rpt_security_weights(weights_a(spark, sf), brand_names(spark, sf)))
query(
    "rpt_sector_weights",
    f"""WITH g AS (SELECT d.date, s.sector FROM (SELECT DISTINCT date FROM wa) d CROSS JOIN (SELECT DISTINCT sector FROM sec_a WHERE sector IS NOT NULL) s)
SELECT g.date, g.sector, {rs('coalesce(sum(w.weight), 0)', 9)} AS weight FROM g LEFT JOIN (SELECT wa.date, wa.weight, sector FROM wa JOIN sec_a USING (asset)) w ON w.date = g.date AND w.sector = g.sector GROUP BY 1, 2""",
    ("wa", "sec_a"),
)(lambda spark, sf: reports.rpt_sector_weights(weights_a(spark, sf), sectors_a(spark, sf)).withColumn("weight", rnd("weight", 9)))


def _flags(spark, sf):
    return panel_b(spark, sf).select("date", "asset", (F.col("value") > 20).alias("flag"))


query(
    "rpt_signal_state_counts",
    "SELECT asset AS name, count(*) FILTER (WHERE value > 20) AS true_count, count(*) FILTER (WHERE value <= 20) AS false_count FROM pb GROUP BY 1",
    ("pb",),
)(lambda spark, sf: reports.rpt_signal_state_counts(_flags(spark, sf)))
query(
    "rpt_signal_selection_counts",
    "SELECT asset AS name, count(*) FILTER (WHERE value > 20) AS days FROM pb GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    ("pb",),
)(lambda spark, sf: reports.rpt_signal_selection_counts(_flags(spark, sf)))
query(
    "rpt_factor_stats",
    f"""SELECT date, {rs('avg(f)', 9)} AS MEAN, {rs('median(f)', 9)} AS MEDIAN, {rs('quantile_cont(f, 0.25)', 9)} AS "25TH", {rs('quantile_cont(f, 0.75)', 9)} AS "75TH"
FROM tr_raw GROUP BY 1""",
    ("tr_raw",),
)(
    lambda spark, sf: factors.factor_stats(tr_a(spark, sf)).select(
        "date", *[rnd(f"`{c}`", 9).alias(c) for c in ("MEAN", "MEDIAN", "25TH", "75TH")]
    )
)
query(
    "rpt_factor_coverage",
    f"""SELECT p.date, count(*) FILTER (WHERE t.f IS NOT NULL) AS covered, {rs('avg(CASE WHEN t.f IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS share,
{rs('sum(CASE WHEN t.f IS NOT NULL THEN w.weight ELSE 0 END) / sum(w.weight)')} AS market_share
FROM pa p LEFT JOIN tr_raw t ON t.date = p.date AND t.asset = p.asset JOIN wa w ON w.date = p.date AND w.asset = p.asset GROUP BY 1""",
    ("pa", "tr_raw", "wa"),
)(
    lambda spark, sf: factors.factor_coverage(tr_a(spark, sf), panel_a(spark, sf), weights_a(spark, sf)).select(
        "date", "covered", rnd("share").alias("share"), rnd("market_share").alias("market_share")
    )
)
query(
    "rpt_prices",
    f"""SELECT coalesce(a.date, b.date) AS date, a.value AS strategy, b.value AS benchmark FROM (SELECT date, {rs('avg(value)')} AS value FROM pa GROUP BY 1) a
FULL JOIN (SELECT ts AS date, {rs('avg(price)')} AS value FROM ser GROUP BY 1) b ON a.date = b.date""",
    ("pa", "ser"),
)(
    lambda spark, sf: reports.rpt_prices(
        panel_a(spark, sf).groupBy("date").agg(rnd(F.avg("value")).alias("value")),
        series_a(spark, sf).groupBy(F.col("ts").alias("date")).agg(rnd(F.avg("price")).alias("value")),
    )
)
_BINS = """WITH l AS (SELECT 'quantity' AS "column", l_quantity AS x FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem),
s AS (SELECT *, min(x) OVER (PARTITION BY "column") AS lo, max(x) OVER (PARTITION BY "column") AS hi, count(*) OVER (PARTITION BY "column") AS n FROM l),
b AS (SELECT "column", CAST(least(floor((x - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, lo, hi, n, CAST(count(*) AS DOUBLE) AS c FROM s GROUP BY 1, 2, 3, 4, 5)"""


def _lines(spark, sf):
    return load(spark, sf, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))


def _bins(df):
    return df.select("column", "bin", rnd("low").alias("low"), rnd("high").alias("high"), rnd("value", 9).alias("value"))


query(
    "histogram_bins",
    f'{_BINS} SELECT "column", bin, {rs("lo + bin * ((hi - lo) / 10)")} AS low, {rs("lo + (bin + 1) * ((hi - lo) / 10)")} AS high, c AS value FROM b',
)(lambda spark, sf: _bins(reports.histogram(_lines(spark, sf), ["quantity", "discount"], 10)))
query(
    "histogram_cumulative",
    f"""{_BINS} SELECT "column", bin, {rs("lo + bin * ((hi - lo) / 10)")} AS low, {rs("lo + (bin + 1) * ((hi - lo) / 10)")} AS high,
{rs('sum(c / n) OVER (PARTITION BY "column" ORDER BY bin)', 9)} AS value FROM b""",
)(lambda spark, sf: _bins(reports.histogram(_lines(spark, sf), ["quantity", "discount"], 10, "probability", True)))
