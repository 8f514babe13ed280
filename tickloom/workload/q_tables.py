"""Scans, sinks, the table-read API, filters and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from tickloom.operators import filters, snapshots
from tickloom.session import checkpoint_root
from tickloom.sources import sheets, sinks, tables
from tickloom.workload.base import SNAP, holdings, load, market, panel_a, panel_b, query, rnd, snapshot

# ------------------------------------------------------------------ scans
query("scan_table", f"{SNAP} FROM snap", ("snap",))(lambda spark, sf: tables.scan_table(market(spark, sf), "officers"))
query(
    "scan_filtered",
    f"""{SNAP} FROM snap WHERE TICKER IN ('U1', 'U2', 'U3') AND "DATE" BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
    ("snap",),
)(lambda spark, sf: tables.scan_filtered(market(spark, sf), "officers", ["u1 ", "U2", "U3"], None, "2024-01-05", "2024-01-20"))

_DEST = StructType([
    StructField("TICKER", StringType()),
    StructField("DATE", DateType()),
    StructField("SECTOR", StringType()),
    StructField("VALUE", DoubleType()),
    StructField("SEQ", LongType()),
])
query(
    "align_to_schema",
    'SELECT TICKER, "DATE", CAST(NULL AS VARCHAR) AS SECTOR, VALUE, SEQ FROM snap',
    ("snap",),
)(lambda spark, sf: sinks.align(snapshot(spark, sf), _DEST))


@query(
    "evolve_schema",
    """SELECT "DATE", TICKER, VALUE, CAST(NULL AS VARCHAR) AS KIND FROM snap WHERE KIND = 'view'
UNION ALL SELECT "DATE", TICKER, VALUE, KIND FROM snap WHERE KIND <> 'view'""",
    ("snap",),
)
def _evolve(spark, sf):
    snap = snapshot(spark, sf)
    old = snap.where(F.col("KIND") == "view").select("DATE", "TICKER", "VALUE")
    return sinks.append_evolving(snap.where(F.col("KIND") != "view").select("DATE", "TICKER", "VALUE", "KIND"), old)


query("delete_where", f"{SNAP} FROM snap WHERE NOT (KIND = 'error' AND VALUE > 5)", ("snap",))(
    lambda spark, sf: sinks.delete_where(snapshot(spark, sf), (F.col("KIND") == "error") & (F.col("VALUE") > 5))
)
query(
    "validate_write",
    """SELECT TICKER, "DATE" FROM (SELECT DISTINCT TICKER, "DATE" FROM snap)
EXCEPT SELECT TICKER, "DATE" FROM snap WHERE KIND <> 'click'""",
    ("snap",),
)(lambda spark, sf: sinks.missing_keys(snapshot(spark, sf), snapshot(spark, sf).where(F.col("KIND") != "click")))
query(
    "validate_write_counts",
    """SELECT count(*) AS EXPECTED, count(*) FILTER (WHERE NOT stored) AS MISSING FROM
(SELECT TICKER, "DATE", bool_or(KIND <> 'click') AS stored FROM snap GROUP BY 1, 2)""",
    ("snap",),
)(lambda spark, sf: sinks.validate_write(snapshot(spark, sf), snapshot(spark, sf).where(F.col("KIND") != "click")))
query(
    "ticker_rename",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'CLK' WHEN 'view' THEN 'VW' ELSE event_type END AS symbol FROM events",
)(
    lambda spark, sf: sinks.replace_values(
        load(spark, sf, "events").select("event_id", F.col("event_type").alias("symbol")),
        "symbol",
        {"click": "CLK", "view": "VW"},
    )
)


@query(
    "parquet_sink",
    """SELECT "DATE", count(*) AS n, round(sum(VALUE), 4) + 0.0 AS total FROM snap GROUP BY 1""",
    ("snap",),
)
def _parquet_sink(spark, sf):
    """Write a date-partitioned table, overwrite one day in place, read it back."""
    path = _scratch(spark, "sink")
    snap = snapshot(spark, sf)
    sinks.write_table(snap, path, "overwrite", partition_by=["DATE"])
    day = snap.where(F.col("DATE") == F.lit("2024-01-05").cast("date"))
    sinks.write_table(day, path, "overwrite", partition_by=["DATE"])
    back = spark.read.parquet(path)
    return back.groupBy("DATE").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("VALUE"), 4).alias("total"))


def _scratch(spark, name: str) -> str:
    """A new folder in the shared checkpoint area."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "xml_sheet_source",
    """SELECT CAST("DATE" AS VARCHAR) AS LOAD_DATE, "INDEX" AS INDEX_NAME, TICKER, CAST(QUANTITY AS BIGINT) AS QUANTITY FROM hold""",
    ("hold",),
)
def _sheet(spark, sf):
    """Holdings as XML spreadsheets, one per index and year, read back as a table.

    A sheet holds at most twelve months of one index, so no row of text grows
    with the table.
    """
    path = _scratch(spark, "sheet")

    def cells(*values):
        return F.concat(
            F.lit("<ss:Row>"),
            *[F.concat(F.lit('<ss:Cell><ss:Data ss:Type="String">'), v, F.lit("</ss:Data></ss:Cell>")) for v in values],
            F.lit("</ss:Row>"),
        )

    body = holdings(spark, sf).select(
        F.concat_ws("-", "INDEX", F.year("DATE")).alias("part"),
        cells(F.col("DATE").cast("string"), F.col("INDEX"), F.col("TICKER"), F.col("QUANTITY").cast("long").cast("string")).alias("row"),
    )
    sheet = body.groupBy("part").agg(F.concat_ws("", F.collect_list("row")).alias("rows"))
    head = cells(F.lit("Load date"), F.lit("Index name"), F.lit("Ticker"), F.lit("Quantity (%)"))
    title = cells(F.lit("Fund holdings"))
    space = 'xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"'
    sheet.select(
        "part",
        F.concat(
            F.lit(f'<ss:Workbook {space}><ss:Worksheet ss:Name="Info"><ss:Table><ss:Row/></ss:Table></ss:Worksheet>'),
            F.lit('<ss:Worksheet ss:Name="Holdings"><ss:Table>'),
            title,
            head,
            F.col("rows"),
            F.lit("</ss:Table></ss:Worksheet></ss:Workbook>"),
        ).alias("value"),
    ).write.mode("overwrite").partitionBy("part").text(path)
    read = sheets.read_sheet(spark, path, sheet=1, skip=1)
    return read.select("LOAD_DATE", "INDEX_NAME", "TICKER", F.col("QUANTITY").cast("long").alias("QUANTITY"))


# ------------------------------------------------------------------ table reads
_TICKERS = ["U1", "U2", "U5", "U8"]
_IN = "TICKER IN ('U1', 'U2', 'U5', 'U8')"
_SPAN = "\"DATE\" BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'"


def _dated(alias: str) -> str:
    """SNAP columns with KIND under the table's own name."""
    return SNAP.replace("KIND", f"KIND AS {alias}") if alias != "KIND" else SNAP


def _latest_rows_sql(alias: str, keys: str, where: str = "TRUE") -> str:
    return f"""{_dated(alias)} FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY "DATE" DESC) AS rk
FROM snap WHERE {where}) WHERE rk = 1"""


def _latest_one_sql(alias: str, keys: str, where: str = "TRUE") -> str:
    return f"""{_dated(alias)} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY "DATE" DESC, SEQ DESC) AS rk
FROM snap WHERE {where}) WHERE rk = 1"""


query(
    "get_prices",
    f'SELECT "DATE", TICKER, FIGI, KIND, VALUE AS ADJ_CLOSE, SEQ FROM snap WHERE {_IN} AND {_SPAN}',
    ("snap",),
)(lambda spark, sf: tables.get_prices(market(spark, sf), _TICKERS, None, "2024-01-03", "2024-01-25"))

for _name, _fn in {
    "get_analyst_price_targets": tables.get_analyst_price_targets,
    "get_officers": tables.get_officers,
    "get_eps_revisions": tables.get_eps_revisions,
    "get_earnings_surprises": tables.get_earnings_surprises,
    "get_institutional_holders": tables.get_institutional_holders,
    "get_major_holders": tables.get_major_holders,
    "get_insider_transactions": tables.get_insider_transactions,
    "get_analyst_recommendations": tables.get_analyst_recommendations,
    "get_analyst_upgrades_downgrades": tables.get_analyst_upgrades_downgrades,
}.items():
    query(_name, _latest_rows_sql("KIND", "TICKER"), ("snap",))(
        lambda spark, sf, fn=_fn: fn(market(spark, sf), get_latest=True)
    )
    query(f"{_name}_filtered", f"{SNAP} FROM snap WHERE {_IN} AND {_SPAN}", ("snap",))(
        lambda spark, sf, fn=_fn: fn(market(spark, sf), _TICKERS, None, "2024-01-03", "2024-01-25")
    )

query("get_company_info", _latest_one_sql("KIND", "TICKER"), ("snap",))(
    lambda spark, sf: tables.get_company_info(market(spark, sf), get_latest=True, ties=["SEQ"])
)
query("get_options", _latest_one_sql("CONTRACTSYMBOL", "TICKER, KIND"), ("snap",))(
    lambda spark, sf: tables.get_options(market(spark, sf), get_latest=True, ties=["SEQ"])
)
query("get_security_master", _latest_rows_sql("NAME", "TICKER", "KIND IN ('click', 'view')"), ("snap",))(
    lambda spark, sf: tables.get_security_master(market(spark, sf), [" click", "view "], get_latest=True)
)
query(
    "get_index_holdings",
    f"""{_dated('"INDEX"')} FROM (SELECT *, rank() OVER (PARTITION BY KIND ORDER BY "DATE" DESC) AS rk
FROM snap WHERE KIND IN ('click', 'view') AND "DATE" <= DATE '2024-01-20') WHERE rk = 1 AND FIGI <> 'none' AND TICKER IN
(SELECT 'U' || user_id FROM events WHERE user_id < 60)""",
    ("snap",),
)(
    lambda spark, sf: tables.get_index_holdings(
        market(spark, sf), ["click", "view"], [f"U{i}" for i in range(60)], end_date="2024-01-20", get_latest=True
    )
)
query("get_llm_holdings", _latest_rows_sql("STRATEGY", "KIND", _IN), ("snap",))(
    lambda spark, sf: tables.get_llm_holdings(market(spark, sf), None, _TICKERS, get_latest=True)
)
_REPORT = "DATE '2023-01-01' + CAST(SEQ % 4 AS INTEGER)"
query(
    "get_fundamentals",
    f"""SELECT "DATE", TICKER, FIGI, KIND, VALUE, SEQ, REPORT_DATE FROM (
SELECT *, rank() OVER (PARTITION BY TICKER, REPORT_DATE ORDER BY "DATE" DESC) AS rk
FROM (SELECT *, CAST({_REPORT} AS DATE) AS REPORT_DATE FROM snap)) WHERE rk = 1""",
    ("snap",),
)(lambda spark, sf: tables.get_fundamentals(market(spark, sf), "cashflow", annual=False, get_latest=True))
for _kind in ("eps", "revenue", "growth"):
    query(f"get_{_kind}_estimates", _latest_rows_sql("PERIOD", "TICKER, KIND"), ("snap",))(
        lambda spark, sf, kind=_kind: tables.get_estimates(market(spark, sf), kind, get_latest=True)
    )
query(
    "get_economic_data",
    f'SELECT "DATE" AS OBSERVATION_DATE, TICKER, FIGI, KIND, VALUE, SEQ FROM snap WHERE {_IN} AND {_SPAN}',
    ("snap",),
)(lambda spark, sf: tables.get_economic_data(market(spark, sf), _TICKERS, "2024-01-03", "2024-01-25"))
query(
    "get_economic_metadata",
    f'SELECT "DATE" AS OBSERVATION_START, TICKER, FIGI, KIND, VALUE, SEQ FROM snap WHERE {_IN} AND "DATE" >= DATE \'2024-01-03\'',
    ("snap",),
)(lambda spark, sf: tables.get_economic_metadata(market(spark, sf), _TICKERS, "2024-01-03"))

# ------------------------------------------------------------------ filters
query("in_filter", f"{SNAP} FROM snap WHERE KIND IN ('click', 'error')", ("snap",))(
    lambda spark, sf: filters.in_filter(snapshot(spark, sf), "KIND", ["click", "error", "click"])
)
query("date_filter", f"{SNAP} FROM snap WHERE \"DATE\" >= DATE '2024-01-10'", ("snap",))(
    lambda spark, sf: filters.date_filter(snapshot(spark, sf), "DATE", start="2024-01-10")
)
query(
    "end_date_filter",
    "SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-10'",
)(lambda spark, sf: filters.date_filter(load(spark, sf, "events"), "ts", end="2024-01-10").select("event_id", "ts"))
query("security_filter", f"{SNAP} FROM snap WHERE FIGI IN ('G3', 'G4')", ("snap",))(
    lambda spark, sf: filters.security_filter(snapshot(spark, sf), figis=["g3", "G4 "])
)


def raw_sheet(spark, sf):
    """Order lines as raw fund rows, all text: asset class, ticker, exchange, weight."""
    lines = load(spark, sf, "lineitem")
    return lines.select(
        F.when(F.col("l_returnflag") == "N", "Bond").otherwise("Equity").alias("ASSET_CLASS"),
        F.when(F.col("l_linenumber") == 7, "--").otherwise(F.concat(F.lit("T"), F.col("l_suppkey"))).alias("TICKER"),
        F.concat(F.lit("E"), F.col("l_linenumber") % 3).alias("EXCHANGE"),
        F.when(F.col("l_tax") == 0, "n/a").otherwise(F.col("l_tax").cast("string")).alias("WEIGHT"),
        F.col("l_orderkey").alias("ID"),
        F.col("l_partkey").alias("PART"),
        F.col("l_extendedprice").alias("AMOUNT"),
    )


query(
    "holdings_filter",
    """SELECT l_orderkey AS ID, l_partkey AS PART, l_extendedprice AS AMOUNT, 'T' || l_suppkey AS TICKER, 'E' || (l_linenumber % 3) AS EXCHANGE
FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <> 7 AND l_linenumber % 3 IN (0, 1) AND l_tax > 0""",
)(lambda spark, sf: filters.clean_holdings(raw_sheet(spark, sf), ["E0", "E1"]).select("ID", "PART", "AMOUNT", "TICKER", "EXCHANGE"))


def _starts(spark, sf):
    """A start date for two users of three, some of them late."""
    return (
        snapshot(spark, sf)
        .select("TICKER")
        .distinct()
        .withColumn("_n", F.substring("TICKER", 2, 9).cast("int"))
        .where(F.col("_n") % 3 != 0)
        .select("TICKER", F.date_add(F.lit("2024-01-01").cast("date"), F.col("_n") % 40).alias("START_DATE"))
    )


_STARTS_SQL = """starts AS (SELECT TICKER, CAST(DATE '2024-01-01' + CAST(n % 40 AS INTEGER) AS DATE) AS START_DATE FROM
(SELECT DISTINCT TICKER, CAST(substr(TICKER, 2) AS INTEGER) AS n FROM snap) WHERE n % 3 <> 0)"""
query(
    "from_start_date",
    f"""WITH {_STARTS_SQL} SELECT s."DATE", s.TICKER, s.FIGI, s.KIND, s.VALUE, s.SEQ FROM snap s LEFT JOIN starts t USING (TICKER)
WHERE t.START_DATE IS NULL OR s."DATE" >= t.START_DATE""",
    ("snap",),
)(lambda spark, sf: filters.rows_from_start(snapshot(spark, sf), _starts(spark, sf)))
query(
    "drop_future_starts",
    f"WITH {_STARTS_SQL} SELECT TICKER, START_DATE, START_DATE <= DATE '2024-01-20' AS ELIGIBLE FROM starts",
    ("snap",),
)(lambda spark, sf: filters.eligible_starts(_starts(spark, sf), "2024-01-20"))
query(
    "corporate_actions",
    "SELECT DISTINCT TICKER FROM snap WHERE (KIND = 'error' AND VALUE > 40) OR (KIND = 'purchase' AND VALUE > 45)",
    ("snap",),
)(
    lambda spark, sf: filters.adjusted_keys(
        snapshot(spark, sf)
        .withColumn("DIVIDENDS", F.when((F.col("KIND") == "error") & (F.col("VALUE") > 40), F.col("VALUE")).otherwise(0.0))
        .withColumn("STOCK_SPLITS", F.when((F.col("KIND") == "purchase") & (F.col("VALUE") > 45), 1.0).otherwise(0.0))
    )
)
query("current_price_ok", "SELECT date, asset, value FROM pb WHERE value > 0", ("pb",))(
    lambda spark, sf: filters.tradable(panel_b(spark, sf))
)
query("items_in_pool", "SELECT date, asset, value FROM pa WHERE asset IN (SELECT asset FROM sec_a WHERE sector = 'S1')", ("pa", "sec_a"))(
    lambda spark, sf: filters.items_in_pool(panel_a(spark, sf), _sector_pool(spark, sf), ["asset"])
)
query("items_not_in_pool", "SELECT date, asset, value FROM pa WHERE asset NOT IN (SELECT asset FROM sec_a WHERE sector = 'S1')", ("pa", "sec_a"))(
    lambda spark, sf: filters.items_not_in_pool(panel_a(spark, sf), _sector_pool(spark, sf), ["asset"])
)


def _sector_pool(spark, sf):
    from tickloom.workload.base import sectors_a

    return sectors_a(spark, sf).where(F.col("sector") == "S1")


query(
    "row_count_bounds",
    """SELECT "INDEX", count(*) AS "ROWS", CASE "INDEX" WHEN 'AUTOMOBILE' THEN 1 WHEN 'MACHINERY' THEN 100000000 END AS LOW,
CASE "INDEX" WHEN 'AUTOMOBILE' THEN 100000000 WHEN 'MACHINERY' THEN 200000000 END AS HIGH,
CASE WHEN "INDEX" = 'MACHINERY' THEN FALSE ELSE TRUE END AS OK FROM hold GROUP BY 1""".replace(
        "THEN 1 ", "THEN CAST(1 AS BIGINT) "
    ).replace("THEN 100000000 WHEN", "THEN CAST(100000000 AS BIGINT) WHEN"),
    ("hold",),
)(
    lambda spark, sf: filters.row_counts(
        holdings(spark, sf), "INDEX", {"AUTOMOBILE": (1, 100_000_000), "MACHINERY": (100_000_000, 200_000_000)}
    )
)

# ------------------------------------------------------------------ snapshots
query("latest_row", _latest_one_sql("KIND", "TICKER"), ("snap",))(
    lambda spark, sf: snapshots.latest_row(snapshot(spark, sf), ["TICKER"], ties=["SEQ"])
)
query("latest_row_multi", _latest_one_sql("KIND", "TICKER, KIND"), ("snap",))(
    lambda spark, sf: snapshots.latest_row(snapshot(spark, sf), ["TICKER", "KIND"], ties=["SEQ"])
)
query("latest_date_rows", _latest_rows_sql("KIND", "TICKER"), ("snap",))(
    lambda spark, sf: snapshots.latest_date_rows(snapshot(spark, sf), ["TICKER"])
)
query("latest_by_partition", _latest_rows_sql("KIND", "TICKER, KIND"), ("snap",))(
    lambda spark, sf: snapshots.latest_date_rows(snapshot(spark, sf), ["TICKER", "KIND"])
)
query(
    "latest_then_filter",
    f"""{SNAP} FROM (SELECT *, rank() OVER (PARTITION BY KIND ORDER BY "DATE" DESC) AS rk FROM snap) WHERE rk = 1 AND VALUE > 5""",
    ("snap",),
)(lambda spark, sf: snapshots.latest_date_rows(snapshot(spark, sf), ["KIND"]).where(F.col("VALUE") > 5))
query("filter_then_latest", _latest_rows_sql("KIND", "KIND", "VALUE > 20"), ("snap",))(
    lambda spark, sf: snapshots.latest_date_rows(snapshot(spark, sf).where(F.col("VALUE") > 20), ["KIND"])
)
query("latest_named", _latest_rows_sql("KIND", "TICKER", "KIND = 'click'"), ("snap",))(
    lambda spark, sf: snapshots.latest_date_rows(filters.in_filter(snapshot(spark, sf), "KIND", ["click"]), ["TICKER"])
)
query("last_snapshot", f"""{SNAP} FROM snap WHERE "DATE" = (SELECT max("DATE") FROM snap) ORDER BY VALUE DESC""", ("snap",))(
    lambda spark, sf: snapshots.last_snapshot(snapshot(spark, sf), weight="VALUE", ties=["SEQ"])
)
_LINE_COLS = (
    "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, "
    "l_linestatus, l_shipdate"
)
_LINE_ORDER = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
query(
    "dedup_rownum",
    f"""SELECT {_LINE_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) AS rn
FROM lineitem) WHERE rn = 1""",
)(lambda spark, sf: snapshots.dedup_rownum(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]))


def master(spark, sf):
    """Security-master-like rows: name = event type, country flag from the value, date with gaps."""
    return snapshot(spark, sf).select(
        F.when(F.col("SEQ") % 7 == 0, F.lit(None)).otherwise(F.col("DATE")).alias("DATE"),
        "TICKER",
        F.col("KIND").alias("NAME"),
        F.when(F.col("SEQ") % 3 == 0, "United States").otherwise("Canada").alias("LOCATION"),
        F.format_string("F%012d", "SEQ").alias("FIGI"),
    )


MASTER_SQL = """master AS (SELECT CASE WHEN SEQ % 7 = 0 THEN NULL ELSE "DATE" END AS "DATE", TICKER, KIND AS NAME,
CASE WHEN SEQ % 3 = 0 THEN 'United States' ELSE 'Canada' END AS LOCATION, 'F' || lpad(CAST(SEQ AS VARCHAR), 12, '0') AS FIGI FROM snap)"""
query(
    "dedupe_master",
    f"""WITH {MASTER_SQL} SELECT "DATE", TICKER, NAME, LOCATION, FIGI FROM (SELECT *, row_number() OVER (PARTITION BY TICKER, NAME
ORDER BY (LOCATION = 'United States') DESC, "DATE" ASC NULLS LAST, FIGI) AS rn FROM master) WHERE rn = 1""",
    ("snap",),
)(lambda spark, sf: _deduped_master(spark, sf))


def _deduped_master(spark, sf):
    from tickloom.functions.places import is_us

    return snapshots.dedupe_master(master(spark, sf), is_us("LOCATION"))


query(
    "keep_last_per_key",
    f"{SNAP} FROM (SELECT *, row_number() OVER (PARTITION BY TICKER ORDER BY SEQ DESC) AS rn FROM snap) WHERE rn = 1",
    ("snap",),
)(lambda spark, sf: snapshots.keep_last_per_key(snapshot(spark, sf), ["TICKER"], "SEQ"))
