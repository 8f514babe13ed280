"""Registry, and the market-data tables derived from the given ones.

Every derivation exists twice: as a DataFrame for Spark and as a named CTE for
the SQL counterpart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.snapshots import pick_row
from tickloom.sources.catalog import MarketTables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register a query; ``ctes`` names the shared derivations its SQL uses."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_ctes(sql, *ctes)
        return fn

    return register


def with_ctes(sql: str, *names: str) -> str:
    """Prefix a statement with the CTEs it needs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTE_DEPS.get(name, ()):
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return sql
    body = ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {body},\n{sql[15:]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {body},\n{sql[5:]}"
    return f"WITH {body}\n{sql}"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    value = F.col(c) if isinstance(c, str) else c
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def rs(expr: str, digits: int = 6) -> str:
    """The SQL spelling of ``rnd``."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


CTES: dict[str, str] = {}
CTE_DEPS: dict[str, tuple[str, ...]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = sql
    CTE_DEPS[name] = deps


# ---------------------------------------------------------------- price panel A
def panel_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense monthly panel: asset = brand, value = mean unit price of the month."""
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return (
        lines.join(parts, "l_partkey")
        .groupBy(
            F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date"),
            F.col("p_brand").alias("asset"),
        )
        .agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("value"))
    )


cte(
    "pa",
    """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, p_brand AS asset,
       round(avg(l_extendedprice / l_quantity), 6) AS value
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)


# ---------------------------------------------------------------- price panel B
def panel_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gappy daily panel: asset = user, value = the last event of the day."""
    events = load(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("date"),
        F.concat(F.lit("U"), F.col("user_id")).alias("asset"),
        F.struct("ts", "event_id").alias("at"),
        "value",
    )
    return events.groupBy("date", "asset").agg(F.max_by("value", "at").alias("value"))


cte(
    "pb",
    """SELECT date, asset, value FROM (
  SELECT CAST(ts AS DATE) AS date, 'U' || user_id AS asset, value,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""",
)
cte("cal_a", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM pa)", "pa")
cte("cal_b", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM pb)", "pb")
cte("grid_a", "SELECT c.date, c.pos, a.asset, p.value FROM cal_a c CROSS JOIN (SELECT DISTINCT asset FROM pa) a LEFT JOIN pa p ON p.date = c.date AND p.asset = a.asset", "cal_a")
cte("grid_b", "SELECT c.date, c.pos, a.asset, p.value FROM cal_b c CROSS JOIN (SELECT DISTINCT asset FROM pb) a LEFT JOIN pb p ON p.date = c.date AND p.asset = a.asset", "cal_b")


# ---------------------------------------------------------------- sectors
def sectors_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector of a brand: its number modulo five; brands of sector 4 from 20 up have none."""
    number = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("int")
    return (
        load(spark, sf_dir, "part")
        .select(F.col("p_brand").alias("asset"))
        .distinct()
        .withColumn("_n", F.split_part("asset", F.lit("#"), F.lit(2)).cast("int"))
        .select(
            "asset",
            F.when((F.col("_n") % 5 == 4) & (F.col("_n") >= 20), F.lit(None))
            .otherwise(F.concat(F.lit("S"), F.col("_n") % 5))
            .alias("sector"),
        )
    )


cte(
    "sec_a",
    """SELECT asset, CASE WHEN n % 5 = 4 AND n >= 20 THEN NULL ELSE 'S' || (n % 5) END AS sector
FROM (SELECT DISTINCT p_brand AS asset, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS n FROM part)""",
)


# ---------------------------------------------------------------- holdings
def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index members: index = market segment, ticker = nation, weight = share of the month's orders."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    customers = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"
    )
    monthly = (
        orders.join(customers, "o_custkey")
        .groupBy(
            F.trunc(F.col("o_orderdate").cast("date"), "month").alias("DATE"),
            F.col("c_mktsegment").alias("INDEX"),
            F.concat(F.lit("T"), F.col("c_nationkey")).alias("TICKER"),
            F.concat(F.lit("F"), F.col("c_nationkey")).alias("FIGI"),
        )
        .agg(
            F.round(F.sum("o_totalprice"), 2).alias("MARKET_VALUE"),
            F.count(F.lit(1)).cast("double").alias("QUANTITY"),
        )
    )
    total = monthly.groupBy("DATE", "INDEX").agg(F.sum("MARKET_VALUE").alias("_t"))
    return (
        monthly.join(total, ["DATE", "INDEX"])
        .withColumn("WEIGHT", F.round(F.col("MARKET_VALUE") / F.col("_t"), 8))
        .drop("_t")
    )


cte(
    "hold0",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS "DATE", c_mktsegment AS "INDEX",
       'T' || c_nationkey AS TICKER, 'F' || c_nationkey AS FIGI,
       round(sum(o_totalprice), 2) AS MARKET_VALUE, CAST(count(*) AS DOUBLE) AS QUANTITY
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4""",
)
cte(
    "hold",
    """SELECT *, round(MARKET_VALUE / sum(MARKET_VALUE) OVER (PARTITION BY "DATE", "INDEX"), 8) AS WEIGHT FROM hold0""",
    "hold0",
)


# ---------------------------------------------------------------- snapshot rows
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor-like rows: one per event, load date = day, key = (user, event type)."""
    return load(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("DATE"),
        F.concat(F.lit("U"), F.col("user_id")).alias("TICKER"),
        F.concat(F.lit("G"), F.col("user_id")).alias("FIGI"),
        F.col("event_type").alias("KIND"),
        F.col("value").alias("VALUE"),
        F.col("event_id").alias("SEQ"),
    )


cte(
    "snap",
    """SELECT CAST(ts AS DATE) AS "DATE", 'U' || user_id AS TICKER, 'G' || user_id AS FIGI, event_type AS KIND,
       value AS VALUE, event_id AS SEQ FROM events""",
)

SNAP = 'SELECT "DATE", TICKER, FIGI, KIND, VALUE, SEQ'


def market(spark: SparkSession, sf_dir: str) -> MarketTables:
    """Every table of the catalogue as a view on the given tables."""
    snap = snapshot(spark, sf_dir)

    def renamed(**names: str):
        out = snap
        for old, new in names.items():
            out = out.withColumnRenamed(old, new)
        return out

    from tickloom.sources.catalog import DATASETS

    tables = {name: snap for name in DATASETS}
    tables["prices"] = renamed(VALUE="ADJ_CLOSE")
    tables["holdings"] = renamed(KIND="INDEX")
    tables["llm"] = renamed(KIND="STRATEGY")
    tables["security_master"] = renamed(KIND="NAME")
    tables["options"] = renamed(KIND="CONTRACTSYMBOL")
    for name, dataset in DATASETS.items():
        if "REPORT_DATE" in dataset.keys:
            tables[name] = snap.withColumn("REPORT_DATE", F.date_add(F.lit("2023-01-01").cast("date"), (F.col("SEQ") % 4).cast("int")))
        elif "PERIOD" in dataset.keys:
            tables[name] = renamed(KIND="PERIOD")
    tables["fred_economic_data"] = renamed(DATE="OBSERVATION_DATE")
    tables["fred_series"] = renamed(DATE="OBSERVATION_START")
    return MarketTables(spark, tables=tables)


# ---------------------------------------------------------------- NAV-like series
def series_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price series per market segment: cumulated order values on a base of 100.

    (series, ts, price) over the days with orders, without gaps in time order.
    """
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return (
        orders.join(customers, "o_custkey")
        .groupBy(F.col("c_mktsegment").alias("series"), F.col("o_orderdate").cast("date").alias("ts"))
        .agg(F.round(F.avg("o_totalprice"), 4).alias("price"))
    )


cte(
    "ser",
    """SELECT c_mktsegment AS series, CAST(o_orderdate AS DATE) AS ts, round(avg(o_totalprice), 4) AS price
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
)

__all__ = [
    "CTES", "QUERIES", "SQL", "SNAP", "cte", "holdings", "load", "market", "panel_a", "panel_b", "pick_row", "query",
    "rnd", "rs", "sectors_a", "series_a", "snapshot", "with_ctes",
]
