"""Join and aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import aggregates, joins
from tickloom.workload.base import holdings, load, panel_a, panel_b, query, rnd, rs, sectors_a, snapshot
from tickloom.workload.q_cleaning import COMPANIES_SQL, companies
from tickloom.workload.q_tables import MASTER_SQL, master

query(
    "join_latest_dates",
    f"""WITH d AS (SELECT TICKER, max("DATE") AS m FROM snap GROUP BY 1) SELECT s."DATE", s.TICKER, s.FIGI, s.KIND, s.VALUE, s.SEQ
FROM snap s JOIN d ON d.TICKER = s.TICKER AND d.m = s."DATE" """,
    ("snap",),
)(lambda spark, sf: joins.join_latest_dates(snapshot(spark, sf), ["TICKER"]))


@query(
    "attach_figi_left",
    f"""WITH {MASTER_SQL}, m AS (SELECT TICKER, NAME, min(FIGI) AS FIGI FROM master WHERE SEQN % 2 = 0 GROUP BY 1, 2)
SELECT s.SEQ, s.TICKER, s.KIND AS NAME, m.FIGI FROM snap s LEFT JOIN m ON m.TICKER = s.TICKER AND upper(m.NAME) = upper(s.KIND)""".replace(
        "AS FIGI FROM snap)", "AS FIGI, SEQ AS SEQN FROM snap)"
    ),
    ("snap",),
)
def _attach(spark, sf):
    held = snapshot(spark, sf).select("SEQ", F.concat(F.lit(" "), F.lower("TICKER")).alias("TICKER"), F.col("KIND").alias("NAME"))
    known = master(spark, sf).where(F.substring("FIGI", 2, 12).cast("long") % 2 == 0)
    out = joins.attach_figi(held, known)
    return out.withColumn("TICKER", F.upper(F.trim("TICKER")))


query(
    "missing_in_master",
    "SELECT DISTINCT TICKER FROM snap WHERE TICKER NOT IN (SELECT TICKER FROM snap WHERE KIND = 'error' AND VALUE > 100)",
    ("snap",),
)(lambda spark, sf: joins.missing_in_master(snapshot(spark, sf), snapshot(spark, sf).where("KIND = 'error' AND VALUE > 100")))


def figi_map(spark, sf):
    """Mapped FIGI for users not divisible by four."""
    rows = snapshot(spark, sf).select("TICKER", "FIGI").distinct()
    return rows.where(F.substring("TICKER", 2, 9).cast("int") % 4 != 0)


FIGI_MAP_SQL = "fm AS (SELECT DISTINCT TICKER, FIGI FROM snap WHERE CAST(substr(TICKER, 2) AS INTEGER) % 4 <> 0)"
query(
    "map_figi_coalesce",
    f"""WITH {FIGI_MAP_SQL} SELECT s.SEQ, s.TICKER, coalesce(CASE WHEN s.KIND = 'view' THEN 'own' END, fm.FIGI) AS FIGI
FROM snap s LEFT JOIN fm ON fm.TICKER = s.TICKER""",
    ("snap",),
)(
    lambda spark, sf: joins.map_figi_coalesce(
        snapshot(spark, sf).select("SEQ", "TICKER", F.when(F.col("KIND") == "view", "own").alias("FIGI")), figi_map(spark, sf)
    )
)
query(
    "map_back",
    f"WITH {FIGI_MAP_SQL} SELECT DISTINCT TICKER FROM fm WHERE FIGI IN (SELECT FIGI FROM snap WHERE KIND = 'error' AND VALUE > 30)",
    ("snap",),
)(lambda spark, sf: joins.map_back(figi_map(spark, sf), snapshot(spark, sf).where("KIND = 'error' AND VALUE > 30")))
query(
    "ticker_figi_map",
    f"WITH {MASTER_SQL} SELECT TICKER, min(FIGI) AS FIGI FROM master GROUP BY 1",
    ("snap",),
)(lambda spark, sf: joins.ticker_figi_map(master(spark, sf)))


@query(
    "figi_ticker_bimap",
    """WITH i AS (SELECT KIND AS FIGI, TICKER, "DATE" FROM snap), f AS (SELECT upper(FIGI) AS FIGI, TICKER FROM
(SELECT *, row_number() OVER (PARTITION BY FIGI ORDER BY "DATE" DESC, TICKER DESC) AS rn FROM i) WHERE rn = 1)
SELECT f.FIGI, f.TICKER, r.FIGI AS FIRST_FIGI FROM f JOIN (SELECT TICKER, min(FIGI) AS FIGI FROM f GROUP BY 1) r USING (TICKER)""",
    ("snap",),
)
def _bimap(spark, sf):
    forward = joins.figi_to_ticker(snapshot(spark, sf).select("DATE", "TICKER", F.col("KIND").alias("FIGI")))
    back = joins.ticker_to_figi(forward).withColumnRenamed("FIGI", "FIRST_FIGI")
    return forward.join(back, "TICKER")


_UNIVERSE_SQL = f"""{MASTER_SQL}, known AS (SELECT * FROM master WHERE CAST(substr(FIGI, 2) AS BIGINT) % 5 < 2)"""
query(
    "anti_join_universe",
    f"""WITH {_UNIVERSE_SQL} SELECT DISTINCT TICKER, NAME, LOCATION FROM master m WHERE (LOCATION = 'United States' AND NOT EXISTS
(SELECT 1 FROM known k WHERE k.TICKER = m.TICKER AND k.NAME = m.NAME)) OR (LOCATION <> 'United States' AND NOT EXISTS
(SELECT 1 FROM known k WHERE k.TICKER = m.TICKER AND k.LOCATION = m.LOCATION))""",
    ("snap",),
)(
    lambda spark, sf: joins.anti_join_universe(
        master(spark, sf), master(spark, sf).where(F.substring("FIGI", 2, 12).cast("long") % 5 < 2)
    )
)
query(
    "metadata_merge",
    """SELECT p_partkey AS TICKER, p_type AS CATEGORY, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS TITLE,
CAST(NULL AS VARCHAR) AS NOTES FROM part""",
)(
    lambda spark, sf: joins.metadata_merge(
        load(spark, sf, "part").select(F.col("p_partkey").alias("TICKER"), F.col("p_type").alias("CATEGORY")),
        load(spark, sf, "part").where("p_partkey % 3 = 0").select(
            F.col("p_partkey").alias("TICKER"), F.lit("x").alias("CATEGORY"), F.col("p_name").alias("TITLE")
        ),
        ["TICKER", "CATEGORY", "TITLE", "NOTES"],
    )
)


@query(
    "address_cache_join",
    f"""WITH {COMPANIES_SQL}, cache AS (SELECT ADDRESS1, CITY, COUNTRY, min(ID) * 0.5 AS LAT, min(ID) * 0.25 AS LON FROM comp WHERE ID % 2 = 0 GROUP BY 1, 2, 3)
SELECT c.ID, c.ADDRESS1, c.CITY, c.STATE, c.ZIP, c.COUNTRY, CAST(k.LAT AS DOUBLE) AS LAT, CAST(k.LON AS DOUBLE) AS LON FROM comp c
LEFT JOIN cache k ON k.ADDRESS1 = c.ADDRESS1 AND k.CITY = c.CITY AND k.COUNTRY = c.COUNTRY""",
)
def _cache(spark, sf):
    rows = companies(spark, sf)
    cache = rows.where("ID % 2 = 0")
    cache = cache.withColumn("LAT", F.col("ID") * 0.5).withColumn("LON", F.col("ID") * 0.25)
    repeated = cache.withColumn("LAT", F.col("LAT") + 1)
    return joins.address_cache_join(rows, cache.unionByName(repeated))


query(
    "missing_addresses",
    f"""WITH {COMPANIES_SQL} SELECT ID, ADDRESS1, CITY, STATE, ZIP, COUNTRY FROM comp WHERE ID % 10 <> 3 AND ID % 4 <> 0""",
)(
    lambda spark, sf: joins.missing_addresses(
        companies(spark, sf).withColumn("ADDRESS1", F.when(F.col("ID") % 10 != 3, F.col("ADDRESS1"))),
        companies(spark, sf).where("ID % 4 = 0"),
    )
)


def _info_by_figi(spark, sf):
    return holdings(spark, sf).select("FIGI", "TICKER").distinct()


query(
    "weights_sector_join",
    f"""SELECT h."DATE", h.FIGI, h."INDEX", h.WEIGHT, 'S' || (CAST(substr(h.FIGI, 2) AS INTEGER) % 5) AS SECTOR FROM hold h
WHERE CAST(substr(h.FIGI, 2) AS INTEGER) % 7 <> 0""",
    ("hold",),
)(
    lambda spark, sf: joins.weights_sector_join(
        holdings(spark, sf).select("DATE", "FIGI", "INDEX", "WEIGHT"),
        holdings(spark, sf)
        .select("DATE", "FIGI", F.substring("FIGI", 2, 9).cast("int").alias("_n"))
        .distinct()
        .where("_n % 7 <> 0")
        .select("DATE", "FIGI", F.concat(F.lit("S"), F.col("_n") % 5).alias("SECTOR")),
    )
)
query(
    "backfill_joins",
    # prices are those of the month before: the first month and new members have none
    """WITH w AS (SELECT "DATE", "INDEX", FIGI, WEIGHT FROM hold), m AS (SELECT DISTINCT FIGI, TICKER FROM hold),
p AS (SELECT CAST("DATE" + INTERVAL 1 MONTH AS DATE) AS "DATE", FIGI, max(MARKET_VALUE) AS PRICE FROM hold GROUP BY 1, 2)
SELECT w."DATE", w."INDEX", w.FIGI, w.WEIGHT, m.TICKER, p.PRICE FROM w LEFT JOIN m ON m.FIGI = w.FIGI LEFT JOIN p ON p.FIGI = w.FIGI AND p."DATE" = w."DATE" """,
    ("hold",),
)(
    lambda spark, sf: joins.backfill_joins(
        holdings(spark, sf).select("DATE", "INDEX", "FIGI", "WEIGHT"),
        _info_by_figi(spark, sf),
        holdings(spark, sf)
        .withColumn("DATE", F.add_months("DATE", 1))
        .groupBy("DATE", "FIGI")
        .agg(F.max("MARKET_VALUE").alias("PRICE")),
    )
)

# ------------------------------------------------------------------ aggregations
query("max_date_per_key", 'SELECT FIGI, max("DATE") AS MAX_DATE FROM snap GROUP BY 1', ("snap",))(
    lambda spark, sf: _max_date(spark, sf)
)


def _max_date(spark, sf):
    from tickloom.operators.snapshots import max_date_per_key

    return max_date_per_key(snapshot(spark, sf))


query(
    "start_dates",
    """WITH m AS (SELECT TICKER, max("DATE") AS d FROM snap WHERE KIND = 'click' AND VALUE > 10 GROUP BY 1), r AS (SELECT DISTINCT TICKER FROM snap)
SELECT TICKER, CAST(CASE WHEN d IS NULL THEN DATE '2000-01-01' WHEN isodow(d) = 5 THEN d + 3 WHEN isodow(d) = 6 THEN d + 2 ELSE d + 1 END AS DATE) AS START_DATE
FROM r LEFT JOIN m USING (TICKER)""",
    ("snap",),
)(lambda spark, sf: aggregates.start_dates(snapshot(spark, sf), snapshot(spark, sf).where("KIND = 'click' AND VALUE > 10")))


def lines_as_holdings(spark, sf):
    """Order lines as fund lines: index = return flag, ticker = supplier, month as date."""
    return load(spark, sf, "lineitem").select(
        F.trunc(F.col("l_shipdate").cast("date"), "year").alias("DATE"),
        F.col("l_returnflag").alias("INDEX"),
        F.concat(F.lit("T"), F.col("l_suppkey")).alias("TICKER"),
        F.concat(F.lit("N"), F.col("l_partkey")).alias("NAME"),
        F.col("l_extendedprice").alias("MARKET_VALUE"),
        F.col("l_tax").alias("WEIGHT"),
        F.col("l_quantity").alias("QUANTITY"),
        F.col("l_discount").alias("PRICE"),
        F.col("l_linestatus").alias("LOCATION"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("_tie"),
    )


_LINES_SQL = """ln AS (SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS "DATE", l_returnflag AS "INDEX", 'T' || l_suppkey AS TICKER, 'N' || l_partkey AS NAME,
l_extendedprice AS MARKET_VALUE, l_tax AS WEIGHT, l_quantity AS QUANTITY, l_discount AS PRICE, l_linestatus AS LOCATION,
row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS tie FROM lineitem)"""


@query(
    "holdings_rollup",
    f"""WITH {_LINES_SQL} SELECT "DATE", "INDEX", TICKER, {rs('sum(MARKET_VALUE)', 3)} AS MARKET_VALUE, {rs('sum(WEIGHT)')} AS WEIGHT,
{rs('sum(QUANTITY)')} AS QUANTITY, {rs('sum(PRICE)')} AS PRICE, arg_min(NAME, tie) AS NAME, arg_min(LOCATION, tie) AS LOCATION FROM ln GROUP BY 1, 2, 3""",
)
def _rollup(spark, sf):
    out = aggregates.holdings_rollup(lines_as_holdings(spark, sf), tie="_tie")
    return out.withColumns({
        "MARKET_VALUE": rnd("MARKET_VALUE", 3), "WEIGHT": rnd("WEIGHT"), "QUANTITY": rnd("QUANTITY"), "PRICE": rnd("PRICE")
    })


query(
    "normalize_weights",
    f"""SELECT TICKER, "INDEX", {rs('WEIGHT / sum(WEIGHT) OVER (PARTITION BY "INDEX")', 12)} AS WEIGHT, MARKET_VALUE FROM hold""",
    ("hold",),
)(
    lambda spark, sf: aggregates.normalize_weights(
        holdings(spark, sf).select("TICKER", "INDEX", "WEIGHT", "MARKET_VALUE")
    ).withColumn("WEIGHT", rnd("WEIGHT", 12))
)


def vintages(spark, sf):
    """Macro-like vintages: observation date = day, vintage = a day offset of the event."""
    return snapshot(spark, sf).select(
        "TICKER",
        F.col("DATE").alias("OBSERVATION_DATE"),
        "VALUE",
        F.date_add("DATE", (F.col("SEQ") % 20).cast("int")).alias("REALTIME_START"),
        F.lit("9999-12-31").cast("date").alias("REALTIME_END"),
        "SEQ",
    )


VINTAGES_SQL = """vin AS (SELECT TICKER, "DATE" AS OBSERVATION_DATE, VALUE, CAST("DATE" + CAST(SEQ % 20 AS INTEGER) AS DATE) AS REALTIME_START,
DATE '9999-12-31' AS REALTIME_END, SEQ FROM snap)"""
query(
    "vintage_max",
    f"WITH {VINTAGES_SQL} SELECT TICKER, OBSERVATION_DATE, max(REALTIME_START) AS MAX_REALTIME_START FROM vin GROUP BY 1, 2",
    ("snap",),
)(lambda spark, sf: aggregates.vintage_max(vintages(spark, sf)))
query(
    "distinct_keys",
    "SELECT TICKER, min(SEQ) AS FIRST_SEEN FROM snap WHERE SEQ % 11 <> 0 GROUP BY 1",
    ("snap",),
)(
    lambda spark, sf: aggregates.distinct_keys(
        snapshot(spark, sf).withColumn(
            "TICKER", F.when(F.col("SEQ") % 11 == 0, "None").otherwise(F.concat(F.lower("TICKER"), F.lit(" ")))
        ),
        "TICKER",
        "SEQ",
    )
)
query(
    "missing_requested",
    "SELECT 'U' || i AS TICKER FROM range(140, 160) t(i) WHERE 'U' || i NOT IN (SELECT TICKER FROM snap)",
    ("snap",),
)(lambda spark, sf: aggregates.missing_requested(snapshot(spark, sf), "TICKER", [f"u{i}" for i in range(140, 160)]))
query(
    "pivot_last",
    """SELECT "DATE", max(CASE WHEN KIND = 'click' THEN VALUE END) AS click, max(CASE WHEN KIND = 'view' THEN VALUE END) AS view,
max(CASE WHEN KIND = 'purchase' THEN VALUE END) AS purchase, max(CASE WHEN KIND = 'signup' THEN VALUE END) AS signup, max(CASE WHEN KIND = 'error' THEN VALUE END) AS error FROM
(SELECT *, row_number() OVER (PARTITION BY "DATE", KIND ORDER BY SEQ DESC) AS rn FROM snap) WHERE rn = 1 GROUP BY 1""",
    ("snap",),
)(lambda spark, sf: aggregates.pivot_last(snapshot(spark, sf), "DATE", "KIND", "VALUE", "SEQ", ["click", "view", "purchase", "signup", "error"]))
query(
    "unpivot",
    """SELECT c_custkey, 'balance' AS asset, c_acctbal AS value FROM customer UNION ALL
SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer""",
)(
    lambda spark, sf: aggregates.unpivot(
        load(spark, sf, "customer").select(
            "c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation")
        ),
        ["c_custkey"],
    )
)


def weights_a(spark, sf):
    """Value-proportional weights of panel A per date."""
    panel = panel_a(spark, sf)
    total = panel.groupBy("date").agg(F.sum("value").alias("_t"))
    return panel.join(total, "date").select("date", "asset", F.round(F.col("value") / F.col("_t"), 9).alias("weight"))


WEIGHTS_A_SQL = "wa AS (SELECT date, asset, round(value / sum(value) OVER (PARTITION BY date), 9) AS weight FROM pa)"


@query(
    "sector_weights",
    f"""WITH {WEIGHTS_A_SQL}, g AS (SELECT d.date, s.sector FROM (SELECT DISTINCT date FROM wa) d CROSS JOIN (SELECT DISTINCT sector FROM sec_a WHERE sector IS NOT NULL) s),
t AS (SELECT date, sector, sum(weight) AS w FROM wa JOIN sec_a USING (asset) GROUP BY 1, 2)
SELECT g.date, g.sector, {rs('coalesce(w, 0)', 9)} AS weight FROM g LEFT JOIN t ON t.date = g.date AND t.sector = g.sector""",
    ("pa", "sec_a"),
)
def _sector_weights(spark, sf):
    return aggregates.sector_weights(weights_a(spark, sf), sectors_a(spark, sf)).withColumn("weight", rnd("weight", 9))


def flags_b(spark, sf):
    return panel_b(spark, sf).select("date", "asset", (F.col("value") > 15).alias("flag"))


query(
    "value_counts",
    "SELECT asset, count(*) FILTER (WHERE value > 15) AS true_count, count(*) FILTER (WHERE NOT value > 15) AS false_count FROM pb GROUP BY 1",
    ("pb",),
)(lambda spark, sf: aggregates.value_counts(flags_b(spark, sf)))
query(
    "persistence_topn",
    "SELECT asset, count(*) FILTER (WHERE value > 15) AS days FROM pb GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    ("pb",),
)(lambda spark, sf: aggregates.persistence_topn(flags_b(spark, sf), 20))
query(
    "nth_period",
    f"SELECT asset, count(*) FILTER (WHERE value > 15) AS positive, {rs('avg(CASE WHEN value > 15 THEN 1.0 ELSE 0.0 END)')} AS share FROM pb GROUP BY 1",
    ("pb",),
)(
    lambda spark, sf: aggregates.hit_rate(
        panel_b(spark, sf).select("asset", (F.col("value") - 15).alias("excess")), ["asset"], "excess"
    ).withColumn("share", rnd("share"))
)
