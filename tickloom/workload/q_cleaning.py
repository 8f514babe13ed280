"""Projection and cleaning queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tickloom.functions import places
from tickloom.functions import text as T
from tickloom.operators import cleaning
from tickloom.workload.base import SNAP, load, query, snapshot

query("normalize_columns", 'SELECT event_id AS EVENT_ID, event_type AS EVENT_TYPE, value AS LAST_VALUE FROM events')(
    lambda spark, sf: cleaning.normalize_columns(
        load(spark, sf, "events").select("event_id", "event_type", F.col("value").alias("last value"))
    )
)
query("dedupe_column_names", 'SELECT event_id AS X, user_id AS X_2, event_type AS Y, value AS X_3 FROM events')(
    lambda spark, sf: cleaning.dedupe_column_names(load(spark, sf, "events").select("event_id", "user_id", "event_type", "value").toDF("X", "X", "Y", "X"))
)
query(
    "to_numeric_columns",
    """SELECT event_id, CAST(value AS DOUBLE) AS good,
CASE WHEN event_id % 1000 = 7 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS mixed FROM events""",
)(
    lambda spark, sf: cleaning.to_numeric_columns(
        load(spark, sf, "events").select(
            "event_id",
            F.col("value").cast("string").alias("good"),
            F.when(F.col("event_id") % 1000 == 7, "n/a").otherwise(F.col("event_id").cast("string")).alias("mixed"),
        )
    )
)
query(
    "coerce_datetime",
    """SELECT event_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE date_trunc('second', ts) END AS stamp FROM events""",
)(
    lambda spark, sf: cleaning.coerce_datetime(
        load(spark, sf, "events").select(
            "event_id",
            F.when(F.col("event_id") % 10 == 3, "soon")
            .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+02:00").otherwise("Z")))
            .alias("stamp"),
        ),
        ["stamp"],
        errors="coerce",
    )
)
query("date_only", "SELECT event_id, CAST(ts AS DATE) AS ts FROM events")(
    lambda spark, sf: cleaning.date_only(load(spark, sf, "events").select("event_id", "ts"), ["ts"])
)
query("require_finite", "SELECT event_id, value FROM events")(
    lambda spark, sf: cleaning.require_finite(load(spark, sf, "events").select("event_id", "value"), ["value"])
)
query(
    "null_nonfinite",
    "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN NULL ELSE value END AS value FROM events",
)(
    lambda spark, sf: cleaning.null_nonfinite(
        load(spark, sf, "events").select(
            "event_id",
            F.when(F.col("event_id") % 5 == 0, float("inf"))
            .when(F.col("event_id") % 5 == 1, float("-inf"))
            .when(F.col("event_id") % 5 == 2, float("nan"))
            .otherwise(F.col("value"))
            .alias("value"),
        )
    )
)
_TOKENS = ["nan ", " None", "", "ok"]
query(
    "null_tokens",
    "SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'ok' END AS word FROM events",
)(
    lambda spark, sf: cleaning.null_tokens(
        load(spark, sf, "events").select(
            "event_id",
            F.element_at(F.array(*[F.lit(t) for t in _TOKENS]), (F.col("event_id") % 4 + 1).cast("int")).alias("word"),
        )
    )
)
query(
    "epoch_to_date",
    "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS \"LASTSPLITDATE\" FROM events",
)(
    lambda spark, sf: cleaning.epoch_to_date(
        load(spark, sf, "events").select(
            "event_id",
            F.when(F.col("event_id") % 6 == 0, "unknown")
            .otherwise(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
            .alias("LASTSPLITDATE"),
        )
    )
)
query(
    "add_ingest_meta",
    "SELECT DATE '2024-02-01' AS \"DATE\", 'U' || user_id AS TICKER, event_id, value FROM events",
)(
    lambda spark, sf: cleaning.add_ingest_meta(
        load(spark, sf, "events").select("event_id", "value", "user_id"),
        F.concat(F.lit("U"), F.col("user_id")),
        F.lit(datetime.date(2024, 2, 1)),
    ).drop("user_id")
)
query(
    "blank_to_null",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS url FROM events",
)(
    lambda spark, sf: load(spark, sf, "events").select(
        "event_id", T.blank_to_null(F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type"))).alias("url")
    )
)
query(
    "drop_all_null_rows",
    """SELECT "DATE", TICKER, FIGI, CASE WHEN SEQ % 2 = 0 THEN VALUE END AS REVENUE, CASE WHEN SEQ % 3 = 0 THEN VALUE END AS PROFIT
FROM snap WHERE SEQ % 2 = 0 OR SEQ % 3 = 0""",
    ("snap",),
)(
    lambda spark, sf: cleaning.drop_all_null_rows(
        snapshot(spark, sf).select(
            "DATE",
            "TICKER",
            "FIGI",
            F.when(F.col("SEQ") % 2 == 0, F.col("VALUE")).alias("REVENUE"),
            F.when(F.col("SEQ") % 3 == 0, F.col("VALUE")).alias("PROFIT"),
        )
    )
)
query("drop_columns", 'SELECT "DATE", TICKER, FIGI, KIND, SEQ FROM snap', ("snap",))(
    lambda spark, sf: cleaning.drop_columns(snapshot(spark, sf), ["VALUE", "CURRENT"])
)
query("lists_to_null", "SELECT vec_id, label, CAST(NULL AS VARCHAR) AS embedding FROM embeddings")(
    lambda spark, sf: cleaning.lists_to_null(load(spark, sf, "embeddings"))
)
query("label_estimates", f"{SNAP}, 'EPS' AS ESTIMATE_TYPE FROM snap", ("snap",))(
    lambda spark, sf: cleaning.label_estimates(snapshot(spark, sf), "eps")
)
query(
    "transpose_statement",
    """SELECT TICKER, REPORT_DATE, min(VALUE) FILTER (WHERE KIND = 'click') AS click, min(VALUE) FILTER (WHERE KIND = 'view') AS view,
min(VALUE) FILTER (WHERE KIND = 'purchase') AS purchase, min(VALUE) FILTER (WHERE KIND = 'signup') AS signup, min(VALUE) FILTER (WHERE KIND = 'error') AS error FROM (SELECT *, "DATE" AS REPORT_DATE FROM snap) GROUP BY 1, 2""",
    ("snap",),
)(
    lambda spark, sf: cleaning.statement_to_rows(
        snapshot(spark, sf).withColumnRenamed("DATE", "REPORT_DATE").withColumnRenamed("KIND", "ITEM"),
        ["click", "view", "purchase", "signup", "error"],
    )
)
query(
    "union_call_put",
    """SELECT TICKER, SEQ, VALUE, CASE WHEN KIND IN ('click', 'purchase') THEN 'Call' ELSE 'Put' END AS OPTION_TYPE FROM snap""",
    ("snap",),
)(
    lambda spark, sf: cleaning.union_call_put(
        snapshot(spark, sf).where("KIND IN ('click', 'purchase')").select("TICKER", "SEQ", "VALUE"),
        snapshot(spark, sf).where("KIND NOT IN ('click', 'purchase')").select("TICKER", "SEQ", "VALUE"),
    )
)
query(
    "explode_officers",
    "SELECT conv_id AS TICKER, turn AS \"DATE\", role AS NAME, length(text) AS PAY FROM conversations".replace(
        "length(text)", "CAST(length(text) AS INTEGER)"
    ),
)(
    lambda spark, sf: cleaning.explode_officers(
        load(spark, sf, "conversations").select(
            F.col("conv_id").alias("TICKER"),
            F.col("turn").alias("DATE"),
            F.array(F.struct(F.col("role").alias("NAME"), F.length("text").alias("PAY"))).alias("COMPANYOFFICERS"),
        )
    )
)
query(
    "classify_transaction",
    """SELECT doc_id, CASE WHEN lower(text) LIKE '%purchase%' THEN 'BUY' WHEN lower(text) LIKE '%conversion%' THEN 'CONVERSION'
WHEN lower(text) LIKE '%grant%' THEN 'GRANT' WHEN lower(text) LIKE '%gift%' THEN 'GIFT' WHEN lower(text) LIKE '%sale%' THEN 'SELL' ELSE 'BUY' END AS "TRANSACTION"
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Sale at price ' WHEN 1 THEN 'Stock GIFT ' WHEN 2 THEN 'Stock Grant, sale ' WHEN 3 THEN 'Conversion of gift '
WHEN 4 THEN 'Purchase after conversion ' ELSE '' END || text AS text FROM documents)""",
)(
    lambda spark, sf: cleaning.classify_transactions(
        load(spark, sf, "documents").select(
            "doc_id",
            F.concat(
                F.element_at(
                    F.array(*[F.lit(w) for w in ["Sale at price ", "Stock GIFT ", "Stock Grant, sale ", "Conversion of gift ", "Purchase after conversion ", ""]]),
                    (F.col("doc_id") % 6 + 1).cast("int"),
                ),
                "text",
            ).alias("TEXT"),
        )
    ).drop("TEXT")
)
query(
    "clean_macro_values",
    """SELECT TICKER, "DATE" AS OBSERVATION_DATE, "DATE" AS REALTIME_START, DATE '9999-12-31' AS REALTIME_END, VALUE, SEQ FROM snap WHERE SEQ % 4 <> 0""",
    ("snap",),
)(
    lambda spark, sf: cleaning.clean_observations(
        snapshot(spark, sf).select(
            F.concat(F.lit(" "), F.lower("TICKER")).alias("TICKER"),
            F.col("DATE").cast("string").alias("DATE"),
            F.col("DATE").cast("string").alias("REALTIME_START"),
            F.lit("9999-12-31").alias("REALTIME_END"),
            F.when(F.col("SEQ") % 8 == 0, ".").when(F.col("SEQ") % 8 == 4, "nan").otherwise(F.col("VALUE").cast("string")).alias("VALUE"),
            "SEQ",
        )
    )
)
query(
    "clean_macro_metadata",
    "SELECT upper(p_brand) || '_' || p_partkey AS TICKER, p_name AS TITLE, p_type AS FREQUENCY FROM part",
)(
    lambda spark, sf: cleaning.clean_metadata(
        load(spark, sf, "part").select(
            F.lit("2024-01-01").alias("REALTIME_START"),
            F.concat(F.lower("p_brand"), F.lit("_"), "p_partkey", F.lit(" ")).alias("ID"),
            F.col("p_name").alias("TITLE"),
            F.lit("x").alias("LAST_UPDATED"),
            F.col("p_type").alias("FREQUENCY"),
        )
    )
)
query(
    "vintage_dates",
    """SELECT o_orderkey AS TICKER, CAST(unnest([CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 30]) AS DATE) AS VINTAGE_DATE FROM orders""",
)(
    lambda spark, sf: cleaning.vintage_dates(
        load(spark, sf, "orders").select(
            F.col("o_orderkey").alias("TICKER"),
            F.array(
                F.col("o_orderdate").cast("date").cast("string"), F.date_add(F.col("o_orderdate").cast("date"), 30).cast("string")
            ).alias("VINTAGE_DATES"),
        )
    )
)
query(
    "normalize_zip",
    "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') ELSE CAST(c_custkey AS VARCHAR) END AS zip FROM customer",
)(
    lambda spark, sf: load(spark, sf, "customer").select(
        "c_custkey",
        places.normalize_zip(
            F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit("-1234")))
            .otherwise(F.col("c_custkey").cast("string"))
        ).alias("zip"),
    )
)


def companies(spark, sf):
    """Customers as companies in five countries, some without a city."""
    customers = load(spark, sf, "customer")
    country = F.element_at(
        F.array(*[F.lit(c) for c in ["United States", "Canada", "Netherlands", "Japan", "Ireland"]]),
        (F.col("c_nationkey") % 5 + 1).cast("int"),
    )
    return customers.select(
        F.col("c_custkey").alias("ID"),
        F.concat(F.col("c_custkey").cast("string"), F.lit(" Main St")).alias("ADDRESS1"),
        F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_mktsegment")).alias("CITY"),
        F.concat(F.lit("ST"), F.col("c_nationkey")).alias("STATE"),
        F.concat(F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit("-99")).alias("ZIP"),
        country.alias("COUNTRY"),
    )


COMPANIES_SQL = """comp AS (SELECT c_custkey AS ID, c_custkey || ' Main St' AS ADDRESS1, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS CITY,
'ST' || c_nationkey AS STATE, lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '-99' AS ZIP, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS Z,
['United States', 'Canada', 'Netherlands', 'Japan', 'Ireland'][c_nationkey % 5 + 1] AS COUNTRY FROM customer)"""
FULL_SQL = """CASE COUNTRY WHEN 'Canada' THEN ADDRESS1 || ', ' || CITY || ', ' || STATE || ' ' || Z || ', ' || COUNTRY
WHEN 'Netherlands' THEN ADDRESS1 || ', ' || Z || ' ' || CITY || ', ' || COUNTRY
WHEN 'Ireland' THEN ADDRESS1 || ', ' || CITY || ', ' || Z || ', ' || COUNTRY
ELSE ADDRESS1 || ', ' || CITY || ', ' || STATE || ', ' || Z || ', ' || COUNTRY END"""
FALLBACK_SQL = """CASE WHEN COUNTRY = 'Netherlands' THEN trim(Z || ' ' || CITY) || ', ' || COUNTRY
WHEN COUNTRY IN ('United States', 'Canada') THEN (CASE WHEN CITY = '' THEN '' ELSE CITY || ', ' END) || STATE || ', ' || Z || ', ' || COUNTRY
ELSE (CASE WHEN CITY = '' THEN '' ELSE CITY || ', ' END) || Z || ', ' || COUNTRY END"""
query(
    "build_address",
    f"""WITH {COMPANIES_SQL} SELECT ID, {FULL_SQL} AS full_address, {FALLBACK_SQL} AS fallback_address,
CASE WHEN CITY <> '' THEN CITY || ', ' || COUNTRY END AS city_address FROM comp""",
)(
    lambda spark, sf: companies(spark, sf).select(
        "ID",
        places.address("full").alias("full_address"),
        places.address("fallback").alias("fallback_address"),
        places.address("city").alias("city_address"),
    )
)


@query(
    "symbol_variants",
    """WITH t AS (SELECT p_partkey, p_partkey % 2 = 0 AS us, CASE p_partkey % 4 WHEN 0 THEN 'A' || p_partkey WHEN 1 THEN 'A' || p_partkey || '.L'
WHEN 2 THEN 'A' || p_partkey || '-B' ELSE 'A' || p_partkey || '-B.L' END AS base FROM part),
v AS (SELECT p_partkey, CASE WHEN us THEN [base] ELSE [split_part(base, '.', 1), base] END
 || CASE WHEN base LIKE '%-%' THEN [replace(base, '-', '/'), replace(base, '-', '.'),
   replace(split_part(base, '.', 1), '-', '/'), replace(split_part(base, '.', 1), '-', '.')] ELSE [] END AS l FROM t),
u AS (SELECT p_partkey, unnest(l) AS VARIANT, generate_subscripts(l, 1) AS i FROM v),
d AS (SELECT p_partkey, VARIANT, min(i) AS i FROM u GROUP BY 1, 2)
SELECT p_partkey, VARIANT, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS INTEGER) AS VARIANT_RANK FROM d""",
)
def _variants(spark, sf):
    part = load(spark, sf, "part")
    key = F.concat(F.lit("a"), F.col("p_partkey").cast("string"))
    kind = F.col("p_partkey") % 4
    ticker = (
        F.when(kind == 0, key)
        .when(kind == 1, F.concat(key, F.lit(".L")))
        .when(kind == 2, F.concat(key, F.lit("-b ")))
        .otherwise(F.concat(key, F.lit("-B.L")))
    )
    rows = part.select("p_partkey", ticker.alias("ticker"))
    return cleaning.symbol_variants(rows, "ticker", F.col("p_partkey") % 2 == 0).drop("ticker")


@query(
    "market_hints",
    """WITH hints AS (SELECT * FROM (VALUES ('united states', 0, 'micCode', 'XNYS'), ('united states', 1, 'micCode', 'XNAS'), ('united states', 2, 'exchCode', 'US'),
('canada', 0, 'micCode', 'XTSE'), ('canada', 1, 'exchCode', 'CN'), ('canada', 2, 'exchCode', 'CA'), ('netherlands', 0, 'micCode', 'XAMS'), ('netherlands', 1, 'exchCode', 'NA'),
('japan', 0, 'micCode', 'XTKS'), ('japan', 1, 'exchCode', 'JP')) t(loc, r, kind, code)),
c AS (SELECT c_custkey AS ID, ['United States', 'Canada', 'Netherlands', 'Japan', 'Ireland'][c_nationkey % 5 + 1] AS LOCATION FROM customer)
SELECT ID, LOCATION, CAST(r AS INTEGER) AS HINT_RANK, kind AS CODE_KIND, code AS CODE FROM c JOIN hints ON loc = lower(LOCATION)
UNION ALL SELECT ID, LOCATION, CAST((SELECT count(*) FROM hints WHERE loc = lower(LOCATION)) AS INTEGER), '', '' FROM c""",
)
def _hints(spark, sf):
    rows = companies(spark, sf).select("ID", F.col("COUNTRY").alias("LOCATION"))
    return places.with_market_hints(rows, "LOCATION")
