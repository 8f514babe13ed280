"""Row differences, upserts, set operations and the ingest jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import diff, macro
from tickloom.plans import ingest as jobs
from tickloom.streaming import jobs as streams
from tickloom.session import cut_lineage
from tickloom.sources.catalog import ESTIMATES, STATEMENTS
from tickloom.workload.base import SNAP, SQL, cte, load, panel_b, query, rnd, rs, series_a, snapshot
from tickloom.workload.q_cleaning import COMPANIES_SQL, FALLBACK_SQL, FULL_SQL, companies
from tickloom.workload.q_joins import FIGI_MAP_SQL, VINTAGES_SQL, figi_map, vintages
from tickloom.workload.q_tables import MASTER_SQL, master


def stored_rows(spark, sf):
    """The table before the batch: nine rows of ten."""
    return snapshot(spark, sf).where("SEQ % 10 <> 0").drop("SEQ")


def landed_rows(spark, sf):
    """The batch: one row of three, a ninth of all rows with a changed value, without FIGI."""
    return snapshot(spark, sf).where("SEQ % 3 = 0").select(
        F.date_add("DATE", 40).alias("DATE"),
        "TICKER",
        "KIND",
        (F.col("VALUE") + F.when(F.col("SEQ") % 9 == 0, 1000.0).otherwise(0.0)).alias("VALUE"),
    )


_STORED = """stored AS (SELECT "DATE", TICKER, FIGI, KIND, VALUE FROM snap WHERE SEQ % 10 <> 0)"""
_LANDED = f"""{FIGI_MAP_SQL}, landed AS (SELECT CAST("DATE" + 40 AS DATE) AS "DATE", TICKER, KIND, VALUE + CASE WHEN SEQ % 9 = 0 THEN 1000.0 ELSE 0.0 END AS VALUE
FROM snap WHERE SEQ % 3 = 0), batch AS (SELECT l."DATE", l.TICKER, fm.FIGI, l.KIND, l.VALUE FROM landed l LEFT JOIN fm USING (TICKER)), {_STORED},
part_stored AS (SELECT * FROM stored WHERE FIGI IN (SELECT FIGI FROM batch))"""


def _new_sql(columns: str, stored: str = "part_stored") -> str:
    """First batch row per compared columns that the stored slice lacks (null-safe)."""
    same = " AND ".join(f"s.{c} IS NOT DISTINCT FROM f.{c}" for c in columns.split(", "))
    return f"""first_rows AS (SELECT min("DATE") AS "DATE", {columns} FROM batch GROUP BY {columns}),
fresh AS (SELECT f."DATE", {", ".join("f." + c for c in columns.split(", "))} FROM first_rows f WHERE NOT EXISTS (SELECT 1 FROM {stored} s WHERE {same}))"""


query(
    "row_signature",
    """SELECT SEQ, TICKER AS text_sig, CAST("DATE" AS VARCHAR) AS date_sig, CASE WHEN SEQ % 2 = 0 THEN '1' ELSE '0' END AS bool_sig,
CASE SEQ % 4 WHEN 0 THEN '<NA>' WHEN 1 THEN '1' WHEN 2 THEN '2024-01-05' ELSE '42' END AS word_sig, VALUE / 3 AS number FROM snap""".replace(
        "VALUE / 3 AS number", "round(VALUE, 9) AS number"
    ),
    ("snap",),
)(
    lambda spark, sf: _signatures(spark, sf)
)


def _signatures(spark, sf):
    from tickloom.functions.text import signature

    words = F.element_at(
        F.array(F.lit(" NaT"), F.lit("TRUE"), F.lit("2024-01-05T10:00:00Z"), F.lit("42.0")), (F.col("SEQ") % 4 + 1).cast("int")
    )
    rows = snapshot(spark, sf).withColumn("WORD", words).withColumn("EVEN", F.col("SEQ") % 2 == 0)
    return rows.select(
        "SEQ",
        signature("TICKER", "string").alias("text_sig"),
        signature("DATE", "date").alias("date_sig"),
        signature("EVEN", "boolean").alias("bool_sig"),
        signature("WORD", "string").alias("word_sig"),
        signature("VALUE", "double").cast("double").alias("number"),
    )


query(
    "new_or_changed_rows",
    f"""WITH batch AS (SELECT CAST("DATE" + 40 AS DATE) AS "DATE", TICKER, KIND, VALUE + CASE WHEN SEQ % 9 = 0 THEN 1000.0 ELSE 0.0 END AS VALUE
FROM snap WHERE SEQ % 3 = 0), {_STORED}, {_new_sql("TICKER, KIND, VALUE", "stored")} SELECT "DATE", TICKER, KIND, VALUE FROM fresh""",
    ("snap",),
)(lambda spark, sf: diff.diff_rows(landed_rows(spark, sf), stored_rows(spark, sf)))
query(
    "new_rows_count",
    f"""WITH batch AS (SELECT CAST("DATE" + 40 AS DATE) AS "DATE", TICKER, KIND, VALUE FROM snap WHERE SEQ % 3 = 0), {_STORED}, {_new_sql("TICKER, KIND", "stored")}
SELECT (SELECT count(*) FROM fresh) AS WRITTEN, (SELECT count(*) FROM batch) - (SELECT count(*) FROM fresh) AS SKIPPED""".replace(
        "SEQ % 10 <> 0", "SEQ % 50 = 0"
    ),
    ("snap",),
)(lambda spark, sf: _new_count(spark, sf))


def _new_count(spark, sf):
    batch = snapshot(spark, sf).where("SEQ % 3 = 0").select("DATE", "TICKER", "KIND", "VALUE")
    stored = snapshot(spark, sf).where("SEQ % 50 = 0")
    return diff.diff_counts(batch, diff.diff_rows(batch, stored, compare=["TICKER", "KIND"]))


query(
    "existing_slice",
    f"""{SNAP} FROM snap WHERE TICKER IN (SELECT TICKER FROM snap WHERE KIND = 'error' AND VALUE > 100)""",
    ("snap",),
)(
    lambda spark, sf: diff.existing_for(
        snapshot(spark, sf), snapshot(spark, sf).where("KIND = 'error' AND VALUE > 100"), ["TICKER"]
    )
)

_VIN_BOTH = f"""{VINTAGES_SQL}, inc AS (SELECT DISTINCT TICKER, OBSERVATION_DATE, VALUE, REALTIME_START, REALTIME_END FROM vin WHERE SEQ % 2 = 0),
exi AS (SELECT TICKER, OBSERVATION_DATE, VALUE, REALTIME_START, REALTIME_END FROM vin WHERE SEQ % 3 <> 0),
gi AS (SELECT TICKER, OBSERVATION_DATE, max(REALTIME_START) AS m FROM inc GROUP BY 1, 2),
ge AS (SELECT TICKER, OBSERVATION_DATE, max(REALTIME_START) AS m FROM exi GROUP BY 1, 2),
act AS (SELECT gi.TICKER, gi.OBSERVATION_DATE, CASE WHEN ge.m IS NULL THEN 'insert' WHEN gi.m > ge.m THEN 'replace' ELSE 'keep' END AS "ACTION"
FROM gi LEFT JOIN ge USING (TICKER, OBSERVATION_DATE)),
due AS (SELECT inc.*, act."ACTION" FROM inc JOIN act USING (TICKER, OBSERVATION_DATE) WHERE act."ACTION" <> 'keep')"""
_VIN_COLS = "TICKER, OBSERVATION_DATE, VALUE, REALTIME_START, REALTIME_END"


def _incoming(spark, sf):
    return vintages(spark, sf).where("SEQ % 2 = 0").drop("SEQ")


def _existing(spark, sf):
    return vintages(spark, sf).where("SEQ % 3 <> 0").drop("SEQ")


query("vintage_refresh", f'WITH {_VIN_BOTH} SELECT {_VIN_COLS}, "ACTION" FROM due', ("snap",))(
    lambda spark, sf: diff.refresh_groups(_incoming(spark, sf), _existing(spark, sf))
)
query(
    "existing_groups_semi",
    f"WITH {_VIN_BOTH} SELECT {_VIN_COLS} FROM exi WHERE (TICKER, OBSERVATION_DATE) IN (SELECT (TICKER, OBSERVATION_DATE) FROM inc)",
    ("snap",),
)(lambda spark, sf: diff.existing_for(_existing(spark, sf), _incoming(spark, sf), ["TICKER", "OBSERVATION_DATE"]))
query(
    "replace_groups",
    f"""WITH {_VIN_BOTH} SELECT {_VIN_COLS} FROM exi WHERE NOT EXISTS (SELECT 1 FROM due WHERE due.TICKER = exi.TICKER AND due.OBSERVATION_DATE = exi.OBSERVATION_DATE)
UNION ALL SELECT {_VIN_COLS} FROM due""",
    ("snap",),
)(
    lambda spark, sf: diff.replace_groups(
        _existing(spark, sf),
        diff.refresh_groups(_incoming(spark, sf), _existing(spark, sf)),
        ["TICKER", "OBSERVATION_DATE"],
    )
)
query(
    "upsert_by_key",
    f"""SELECT "DATE", TICKER, FIGI, KIND, VALUE, SEQ FROM snap WHERE TICKER NOT IN (SELECT TICKER FROM snap WHERE SEQ % 100 = 0)
UNION ALL SELECT "DATE", TICKER, FIGI, KIND, VALUE + 1, SEQ FROM snap WHERE SEQ % 100 = 0""",
    ("snap",),
)(
    lambda spark, sf: diff.upsert(
        snapshot(spark, sf), snapshot(spark, sf).where("SEQ % 100 = 0").withColumn("VALUE", F.col("VALUE") + 1), "TICKER"
    )
)
query(
    "overwrite_adjusted",
    f"""WITH due AS (SELECT DISTINCT TICKER FROM snap WHERE KIND = 'error' AND VALUE > 100 AND TICKER IN (SELECT TICKER FROM snap WHERE SEQ % 4 = 1))
SELECT "DATE", TICKER, FIGI, KIND, VALUE, SEQ FROM snap WHERE SEQ % 4 = 1 AND TICKER NOT IN (SELECT TICKER FROM due)
UNION ALL SELECT "DATE", TICKER, FIGI, KIND, VALUE * 2, SEQ FROM snap WHERE TICKER IN (SELECT TICKER FROM due)""",
    ("snap",),
)(
    lambda spark, sf: diff.reload_keys(
        snapshot(spark, sf).where("SEQ % 4 = 1"),
        snapshot(spark, sf).withColumn("VALUE", F.col("VALUE") * 2),
        snapshot(spark, sf).where("KIND = 'error' AND VALUE > 100"),
    )
)
query(
    "union_frames",
    "SELECT DISTINCT TICKER, KIND, CASE WHEN KIND IN ('view', 'signup') THEN \"DATE\" END AS \"DATE\" FROM snap",
    ("snap",),
)(
    lambda spark, sf: diff.union_all(
        [
            snapshot(spark, sf).where("KIND NOT IN ('view', 'signup')").select("TICKER", "KIND"),
            snapshot(spark, sf).where("KIND IN ('view', 'signup')").select("TICKER", "KIND", "DATE"),
        ],
        distinct=True,
    )
)
query(
    "cache_merge",
    """WITH o AS (SELECT KIND || TICKER AS K, min(SEQ) AS N FROM snap GROUP BY 1), n AS (SELECT KIND || TICKER AS K, max(SEQ) AS N FROM snap WHERE VALUE > 20 GROUP BY 1)
SELECT K AS TICKER, coalesce(n.N, o.N) AS N FROM o FULL JOIN n USING (K)""",
    ("snap",),
)(
    lambda spark, sf: diff.merge_latest(
        snapshot(spark, sf).groupBy(F.concat("KIND", "TICKER").alias("TICKER")).agg(F.min("SEQ").alias("N")),
        snapshot(spark, sf).where("VALUE > 20").groupBy(F.concat("KIND", "TICKER").alias("TICKER")).agg(F.max("SEQ").alias("N")),
    )
)
query(
    "set_difference",
    "SELECT DISTINCT TICKER FROM snap EXCEPT SELECT TICKER FROM snap WHERE KIND = 'purchase' AND VALUE > 100",
    ("snap",),
)(lambda spark, sf: diff.missing_keys(snapshot(spark, sf).where("KIND = 'purchase' AND VALUE > 100"), snapshot(spark, sf), "TICKER"))
query(
    "inactive_union",
    "SELECT date, asset FROM pb WHERE asset NOT IN ('U1', 'U2', 'U3', 'U4')",
    ("pb",),
)(
    lambda spark, sf: diff.drop_inactive(
        panel_b(spark, sf).select("date", "asset"),
        panel_b(spark, sf).where("asset IN ('U1', 'U2')"),
        panel_b(spark, sf).where("asset IN ('U3', 'U4', 'U1')"),
    )
)

# ------------------------------------------------------------------ ingest jobs
_STATEMENT_TABLES = tuple(f"{s}_{p}" for s in STATEMENTS for p in ("annual", "quarterly"))
_ESTIMATE_TABLES = tuple(f"{e}_estimates" for e in ESTIMATES)
_HOLDERS = ("institutional_holders", "major_holders")  # their VALUE is not stored; SHARES is


def _tables_sql(names) -> str:
    return f"(VALUES {', '.join(f"('{n}')" for n in names)}) t(DATASET)"


def _each(spark, sf, tables, landed, stored, shape=lambda rows, name: rows):
    """The same batch landed in every one of the tables; the given rows are derived once."""
    landed, stored, mapping = (cut_lineage(df) for df in (landed, stored, figi_map(spark, sf)))
    return diff.union_all(
        [jobs.ingest(name, landed, shape(stored, name), mapping).withColumn("DATASET", F.lit(name)) for name in tables]
    )


_DIFFED = {
    "ingest_recommendations": "analyst_recommendations",
    "ingest_upgrades": "analyst_upgrades_downgrades",
    "ingest_eps_revisions": "eps_revisions",
    "ingest_surprises": "earnings_surprises",
    "ingest_insiders": "insider_transactions",
    "ingest_options": "options",
    "ingest_officers": "officers",
}
for _job, _table in _DIFFED.items():
    query(
        _job,
        f"""WITH {_LANDED}, {_new_sql("TICKER, FIGI, KIND, VALUE")} SELECT "DATE", TICKER, FIGI, KIND, VALUE FROM fresh""",
        ("snap",),
    )(lambda spark, sf, table=_table: jobs.ingest(table, landed_rows(spark, sf), stored_rows(spark, sf), figi_map(spark, sf)))
query(
    "ingest_price_targets",
    f"""WITH {_LANDED}, {_new_sql("TICKER, FIGI, KIND, VALUE")} SELECT "DATE", TICKER, FIGI, KIND, VALUE FROM fresh""",
    ("snap",),
)(
    lambda spark, sf: jobs.ingest(
        "analyst_price_targets", landed_rows(spark, sf).withColumn("current", F.lit(1)), stored_rows(spark, sf), figi_map(spark, sf)
    )
)
query(
    "ingest_statements",
    f"""WITH {_LANDED.replace('FROM snap WHERE SEQ % 3 = 0)', 'FROM snap WHERE SEQ % 3 = 0 AND SEQ % 2 = 0)')}, {_new_sql("TICKER, FIGI, KIND, VALUE")}
SELECT "DATE", TICKER, FIGI, KIND, VALUE, DATASET FROM fresh, {_tables_sql(_STATEMENT_TABLES)}""",
    ("snap",),
)(lambda spark, sf: _statements(spark, sf))


def _statements(spark, sf):
    """The same batch lands in every statement table; every second of its rows has no payload and is dropped."""
    rows = snapshot(spark, sf).where("SEQ % 3 = 0")
    has = F.col("SEQ") % 2 == 0
    landed = rows.select(
        F.date_add("DATE", 40).alias("DATE"),
        "TICKER",
        F.when(has, F.col("KIND")).alias("KIND"),
        F.when(has, F.col("VALUE") + F.when(F.col("SEQ") % 9 == 0, 1000.0).otherwise(0.0)).alias("VALUE"),
    )
    return _each(spark, sf, _STATEMENT_TABLES, landed, stored_rows(spark, sf))


query(
    "ingest_estimates",
    f"""WITH {_LANDED}, {_new_sql("TICKER, FIGI, KIND, VALUE")}
SELECT "DATE", TICKER, FIGI, KIND, VALUE, upper(split_part(DATASET, '_', 1)) AS ESTIMATE_TYPE, DATASET FROM fresh, {_tables_sql(_ESTIMATE_TABLES)}""",
    ("snap",),
)(
    lambda spark, sf: _each(
        spark, sf, _ESTIMATE_TABLES, landed_rows(spark, sf), stored_rows(spark, sf),
        lambda rows, name: rows.withColumn("ESTIMATE_TYPE", F.lit(name.partition("_")[0].upper())),
    )
)
query(
    "ingest_holders",
    f"""WITH {_LANDED}, {_new_sql("TICKER, FIGI, KIND, SHARES")} SELECT "DATE", TICKER, FIGI, KIND, SHARES, DATASET FROM fresh, {_tables_sql(_HOLDERS)}""".replace(
        "l.KIND, l.VALUE", "l.KIND, l.VALUE AS SHARES"
    ).replace('FIGI, KIND, VALUE FROM snap WHERE SEQ % 10', 'FIGI, KIND, VALUE AS SHARES FROM snap WHERE SEQ % 10'),
    ("snap",),
)(
    lambda spark, sf: _each(
        spark, sf, _HOLDERS, landed_rows(spark, sf).withColumn("SHARES", F.col("VALUE")), stored_rows(spark, sf).withColumnRenamed("VALUE", "SHARES")
    )
)
query(
    "ingest_company_info",
    f"""WITH {_LANDED} SELECT "DATE", TICKER, FIGI, CASE WHEN KIND = 'view' THEN NULL ELSE KIND END AS KIND, VALUE FROM batch""",
    ("snap",),
)(
    lambda spark, sf: jobs.ingest(
        "company_info",
        landed_rows(spark, sf).withColumn("KIND", F.when(F.col("KIND") == "view", " NaN").otherwise(F.col("KIND"))),
        stored_rows(spark, sf),
        figi_map(spark, sf),
    )
)


@query(
    "ingest_prices",
    f"""WITH {FIGI_MAP_SQL}, st AS (SELECT "DATE", TICKER, FIGI, VALUE AS ADJ_CLOSE, 0.0 AS DIVIDENDS, 0.0 AS STOCK_SPLITS, SEQ FROM snap WHERE "DATE" <= DATE '2024-01-12' AND SEQ % 5 <> 0),
m AS (SELECT TICKER, max("DATE") AS d FROM st GROUP BY 1),
land AS (SELECT s."DATE", s.TICKER, fm.FIGI, s.VALUE AS ADJ_CLOSE, CASE WHEN s.KIND = 'error' AND s.VALUE > 45 THEN 1.0 ELSE 0.0 END AS DIVIDENDS, 0.0 AS STOCK_SPLITS, s.SEQ
FROM snap s LEFT JOIN fm ON fm.TICKER = s.TICKER WHERE s."DATE" >= DATE '2024-01-10'),
due AS (SELECT l.* FROM land l LEFT JOIN m USING (TICKER) WHERE l."DATE" >= CASE WHEN m.d IS NULL THEN DATE '2000-01-01' WHEN isodow(m.d) = 5 THEN m.d + 3 WHEN isodow(m.d) = 6 THEN m.d + 2 ELSE m.d + 1 END),
adj AS (SELECT DISTINCT TICKER FROM due WHERE DIVIDENDS > 0 AND TICKER IN (SELECT TICKER FROM st)),
uni AS (SELECT * FROM st UNION ALL SELECT * FROM due)
SELECT "DATE", TICKER, FIGI, ADJ_CLOSE, CAST(DIVIDENDS AS DOUBLE) AS DIVIDENDS, CAST(STOCK_SPLITS AS DOUBLE) AS STOCK_SPLITS, SEQ FROM uni WHERE TICKER NOT IN (SELECT TICKER FROM adj)
UNION ALL SELECT s."DATE", s.TICKER, fm.FIGI, s.VALUE * 0.5, 0.0, 0.0, s.SEQ FROM snap s LEFT JOIN fm ON fm.TICKER = s.TICKER WHERE s.TICKER IN (SELECT TICKER FROM adj)""",
    ("snap",),
)
def _prices(spark, sf):
    landed, stored, fresh = _price_frames(spark, sf)
    return jobs.ingest_prices(landed, stored, figi_map(spark, sf), fresh)


def _price_frames(spark, sf):
    """(landed, stored, whole history) of the prices."""
    base = snapshot(spark, sf).withColumnRenamed("VALUE", "ADJ_CLOSE")
    none = {"DIVIDENDS": F.lit(0.0), "STOCK_SPLITS": F.lit(0.0)}
    columns = ["DATE", "TICKER", "FIGI", "ADJ_CLOSE", "DIVIDENDS", "STOCK_SPLITS", "SEQ"]
    stored = base.where("DATE <= DATE'2024-01-12' AND SEQ % 5 <> 0").withColumns(none).select(columns)
    landed = (
        base.where("DATE >= DATE'2024-01-10'")
        .withColumns({**none, "DIVIDENDS": F.when((F.col("KIND") == "error") & (F.col("ADJ_CLOSE") > 45), 1.0).otherwise(0.0)})
        .drop("FIGI", "KIND")
    )
    fresh = base.withColumn("ADJ_CLOSE", F.col("ADJ_CLOSE") * 0.5).withColumns(none).drop("FIGI", "KIND")
    return landed, stored, fresh


@query(
    "ingest_holdings",
    f"""WITH {MASTER_SQL}, raw AS (SELECT l_returnflag AS "INDEX", 'U' || l_suppkey AS TICKER, CASE l_linenumber WHEN 1 THEN 'click' ELSE 'view' END AS NAME,
l_extendedprice AS MV, l_tax AS W, l_quantity AS Q, l_discount AS P, l_linestatus AS LOCATION, l_linenumber, 'E' || (l_linenumber % 3) AS EXCHANGE FROM lineitem),
ok AS (SELECT * FROM raw WHERE l_linenumber <> 7 AND EXCHANGE IN ('E0', 'E1') AND W > 0),
n AS (SELECT *, W / sum(W) OVER (PARTITION BY "INDEX") AS NW FROM ok),
r AS (SELECT "INDEX", TICKER, min(NAME) AS NAME, sum(MV) AS MARKET_VALUE, sum(NW) AS WEIGHT, sum(Q) AS QUANTITY, sum(P) AS PRICE, count(*) AS n FROM n GROUP BY 1, 2),
dm AS (SELECT TICKER, NAME, FIGI FROM (SELECT *, row_number() OVER (PARTITION BY TICKER, NAME ORDER BY (LOCATION = 'United States') DESC, "DATE" ASC NULLS LAST, FIGI) AS rn FROM master) WHERE rn = 1)
SELECT DATE '2024-02-01' AS "DATE", r."INDEX", r.TICKER, {rs('MARKET_VALUE', 3)} AS MARKET_VALUE, {rs('WEIGHT', 9)} AS WEIGHT, {rs('QUANTITY')} AS QUANTITY, {rs('PRICE')} AS PRICE, r.NAME, dm.FIGI
FROM r LEFT JOIN dm ON dm.TICKER = r.TICKER AND dm.NAME = r.NAME""",
    ("snap",),
)
def _holdings(spark, sf):
    out = jobs.ingest_holdings(_sheets(spark, sf), master(spark, sf), ["E0", "E1"], "2024-02-01")
    return out.select(
        "DATE", "INDEX", "TICKER", rnd("MARKET_VALUE", 3).alias("MARKET_VALUE"), rnd("WEIGHT", 9).alias("WEIGHT"),
        rnd("QUANTITY").alias("QUANTITY"), rnd("PRICE").alias("PRICE"), "NAME", "FIGI",
    )


def _sheets(spark, sf):
    """Raw fund sheets: lines as members of the funds named by their return flag."""
    lines = load(spark, sf, "lineitem")
    raw = lines.select(
        F.col("l_returnflag").alias("INDEX"),
        F.when(F.col("l_linenumber") == 7, "--").otherwise(F.concat(F.lit("U"), F.col("l_suppkey"))).alias("TICKER"),
        F.when(F.col("l_linenumber") == 1, "click").otherwise("view").alias("NAME"),
        F.lit("Equity").alias("ASSET_CLASS"),
        F.concat(F.lit("E"), F.col("l_linenumber") % 3).alias("EXCHANGE"),
        F.col("l_extendedprice").cast("string").alias("MARKET_VALUE"),
        F.col("l_tax").cast("string").alias("WEIGHT"),
        F.col("l_quantity").cast("string").alias("QUANTITY"),
        F.col("l_discount").cast("string").alias("PRICE"),
    )
    # the first attribute is the smallest name here, as the roll-up orders by the row itself
    return raw.select("NAME", *[c for c in raw.columns if c != "NAME"])


def _known_master(spark, sf):
    """The master before the day: one row of fifty."""
    return master(spark, sf).where(F.substring("FIGI", 2, 12).cast("long") % 50 == 0)


query(
    "ingest_security_master",
    f"""WITH {MASTER_SQL}, known AS (SELECT * FROM master WHERE CAST(substr(FIGI, 2) AS BIGINT) % 50 = 0) SELECT DISTINCT TICKER, NAME, LOCATION FROM master m
WHERE (LOCATION = 'United States' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.TICKER = m.TICKER AND k.NAME = m.NAME))
OR (LOCATION <> 'United States' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.TICKER = m.TICKER AND k.LOCATION = m.LOCATION))""",
    ("snap",),
)(lambda spark, sf: jobs.ingest_security_master(master(spark, sf), _known_master(spark, sf)))


def series_metadata(spark, sf):
    """Every third user's series is daily, by its short or its long label."""
    n = F.substring("TICKER", 2, 9).cast("int")
    return snapshot(spark, sf).select("TICKER").distinct().select(
        "TICKER",
        F.when(n % 3 == 0, " D ").when(n % 3 == 1, "").otherwise("M").alias("FREQUENCY_SHORT"),
        F.when(n % 2 == 0, "Daily").otherwise("Monthly").alias("FREQUENCY"),
        F.date_add(F.lit("2020-01-01").cast("date"), n).alias("OBSERVATION_START"),
    )


cte(
    "meta",
    """SELECT TICKER, CASE n % 3 WHEN 0 THEN ' D ' WHEN 1 THEN '' ELSE 'M' END AS FREQUENCY_SHORT, CASE WHEN n % 2 = 0 THEN 'Daily' ELSE 'Monthly' END AS FREQUENCY,
CAST(DATE '2020-01-01' + n AS DATE) AS OBSERVATION_START, CASE WHEN n % 3 = 0 OR (n % 3 = 1 AND n % 2 = 0) THEN 'daily' ELSE 'revised' END AS ROUTE
FROM (SELECT DISTINCT TICKER, CAST(substr(TICKER, 2) AS INTEGER) AS n FROM snap)""",
    "snap",
)


@query(
    "ingest_macro",
    f"""WITH {_VIN_BOTH.replace("FROM vin WHERE SEQ % 2 = 0)", "FROM (SELECT vin.TICKER, OBSERVATION_DATE, VALUE, CASE WHEN ROUTE = 'daily' THEN OBSERVATION_DATE ELSE REALTIME_START END AS REALTIME_START, CASE WHEN ROUTE = 'daily' THEN OBSERVATION_DATE ELSE REALTIME_END END AS REALTIME_END, SEQ FROM vin JOIN meta USING (TICKER)) WHERE SEQ % 2 = 0)")}
SELECT {_VIN_COLS} FROM exi WHERE NOT EXISTS (SELECT 1 FROM due WHERE due.TICKER = exi.TICKER AND due.OBSERVATION_DATE = exi.OBSERVATION_DATE)
UNION ALL SELECT {_VIN_COLS} FROM due""",
    ("snap", "meta"),
)
def _macro(spark, sf):
    landed = _incoming(spark, sf).withColumn("TICKER", F.lower("TICKER"))
    return jobs.ingest_macro(landed, _existing(spark, sf), series_metadata(spark, sf))


@query(
    "ingest_macro_metadata",
    """SELECT TICKER, TITLE, POPULARITY FROM (SELECT 'P' || p_partkey AS TICKER, CASE WHEN p_partkey % 4 = 0 THEN 'new ' || p_name ELSE p_name END AS TITLE, p_size AS POPULARITY FROM part)""",
)
def _macro_meta(spark, sf):
    part = load(spark, sf, "part")
    stored = part.select(F.concat(F.lit("P"), "p_partkey").alias("TICKER"), F.col("p_name").alias("TITLE"), F.col("p_size").alias("POPULARITY"))
    landed = part.where("p_partkey % 2 = 0").select(
        F.concat(F.lit("p"), "p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("new "), "p_name")).otherwise(F.col("p_name")).alias("title"),
        F.col("p_size").cast("string").alias("popularity"),
        F.lit("2024-01-01").alias("last updated"),
    )
    return jobs.ingest_macro_metadata(landed, stored)


query(
    "ingest_addresses",
    f"""WITH {COMPANIES_SQL} SELECT ADDRESS1, CITY, STATE, ZIP, COUNTRY, {FULL_SQL} AS FULL_ADDRESS, {FALLBACK_SQL} AS FALLBACK_ADDRESS,
CASE WHEN CITY <> '' THEN CITY || ', ' || COUNTRY END AS CITY_ADDRESS FROM comp WHERE ID % 4 <> 0""",
)(lambda spark, sf: jobs.ingest_addresses(companies(spark, sf), companies(spark, sf).where("ID % 4 = 0")))


_COMMON = ["DATE", "TICKER", "FIGI", "KIND", "VALUE"]


def _run(frames):
    """The results of a run in one frame; each job's own columns under common names."""
    names = {
        "holdings": {"NAME": "KIND", "WEIGHT": "VALUE"},
        "security_master": {"NAME": "KIND"},
        "prices": {"ADJ_CLOSE": "VALUE"},
        "fred_series": {"OBSERVATION_START": "DATE", "FREQUENCY": "KIND"},
        "fred_economic_data": {"OBSERVATION_DATE": "DATE"},
        "addresses": {"FULL_ADDRESS": "KIND"},
    } | dict.fromkeys(_HOLDERS, {"SHARES": "VALUE"})
    types = ["date", "string", "string", "string", "double"]
    out = []
    for name, rows in frames.items():
        rows = rows.withColumnsRenamed(names.get(name, {}))
        common = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in zip(_COMMON, types)]
        out.append(rows.select(*common, F.lit(name).alias("DATASET")))
    return diff.union_all(out).withColumn("VALUE", rnd("VALUE", 9))


def _company_rows(spark, sf):
    return companies(spark, sf).select(
        F.lit("2024-02-01").cast("date").alias("DATE"), F.concat(F.lit("U"), "ID").alias("TICKER"), F.col("ID").cast("double").alias("VALUE"),
        "ADDRESS1", "CITY", "STATE", "ZIP", "COUNTRY",
    )


def _day(spark, sf):
    """(landed, stored) frames of every job; those that many jobs read are derived once."""
    landed, stored = (cut_lineage(f(spark, sf)) for f in (landed_rows, stored_rows))
    prices, had, history = _price_frames(spark, sf)
    index_prices = series_a(spark, sf).select(
        F.add_months("ts", 120).alias("DATE"), F.col("series").alias("TICKER"), F.col("price").alias("ADJ_CLOSE"),
        F.lit(0.0).alias("DIVIDENDS"), F.lit(0.0).alias("STOCK_SPLITS"),
    )
    series = series_metadata(spark, sf)
    came = {n: landed.withColumn("SHARES", F.col("VALUE")) if n in _HOLDERS else landed for n in jobs.SPECS}
    had_ = {n: stored.withColumnRenamed("VALUE", "SHARES") if n in _HOLDERS else stored for n in jobs.SPECS}
    return came | {
        "holdings": _sheets(spark, sf),
        "security_master": master(spark, sf),
        "index_prices": index_prices,
        "prices": prices,
        "prices_history": history,
        "company_info": _company_rows(spark, sf),
        "fred_series": series.select(
            F.lower("TICKER").alias("id"), "FREQUENCY_SHORT", "FREQUENCY", F.date_add("OBSERVATION_START", 1).alias("observation start")
        ),
        "fred_economic_data": _incoming(spark, sf).withColumn("TICKER", F.lower("TICKER")),
    }, had_ | {
        "security_master": _known_master(spark, sf),
        "prices": had,
        "fred_series": series,
        "fred_economic_data": _existing(spark, sf),
        "addresses": companies(spark, sf).where("ID % 4 = 0"),
    }


def _daily(spark, sf):
    landed, stored = _day(spark, sf)
    return _run(jobs.daily_run(landed, stored, cut_lineage(figi_map(spark, sf)), ["E0", "E1"], "2024-02-01"))


_COLS = '"DATE", TICKER, FIGI, KIND, VALUE, DATASET'
_VENDORS = [n for n in jobs.SPECS if n != "company_info"]
_SERIES_ROWS = """SELECT CAST(ts + INTERVAL 120 MONTH AS DATE) AS "DATE", series AS TICKER, CAST(NULL AS VARCHAR) AS FIGI, price AS ADJ_CLOSE FROM ser"""


def _prices_sql(landed: str, figis: str) -> str:
    """The price job over the landed rows that meet a condition, with ``figis`` as FIGI of a ticker.

    A ticker whose FIGI is another than the stored one is another security.
    """
    return f"""st AS (SELECT "DATE", TICKER, FIGI, VALUE AS ADJ_CLOSE FROM snap WHERE "DATE" <= DATE '2024-01-12' AND SEQ % 5 <> 0),
m AS (SELECT TICKER, max("DATE") AS d FROM st GROUP BY 1),
land AS (SELECT s."DATE", s.TICKER, fm.FIGI, s.VALUE AS ADJ_CLOSE, s.KIND = 'error' AND s.VALUE > 45 AS acted, fm.FIGI IS NULL OR fm.FIGI LIKE 'G%' AS same
FROM snap s LEFT JOIN {figis} fm ON fm.TICKER = s.TICKER WHERE s."DATE" >= DATE '2024-01-10' AND {landed}),
dues AS (SELECT l.* FROM land l LEFT JOIN m ON m.TICKER = l.TICKER AND l.same WHERE l."DATE" >= CASE WHEN m.d IS NULL THEN DATE '2000-01-01' WHEN isodow(m.d) = 5 THEN m.d + 3 WHEN isodow(m.d) = 6 THEN m.d + 2 ELSE m.d + 1 END),
adj AS (SELECT DISTINCT TICKER FROM dues WHERE acted AND same AND TICKER IN (SELECT TICKER FROM st)),
uni AS (SELECT * FROM st UNION ALL SELECT "DATE", TICKER, FIGI, ADJ_CLOSE FROM dues),
px AS (SELECT "DATE", TICKER, FIGI, ADJ_CLOSE FROM uni WHERE TICKER NOT IN (SELECT TICKER FROM adj)
UNION ALL SELECT s."DATE", s.TICKER, fm.FIGI, s.VALUE * 0.5 FROM snap s LEFT JOIN {figis} fm ON fm.TICKER = s.TICKER WHERE s.TICKER IN (SELECT TICKER FROM adj))"""


# the members of the funds, with what the master knew, extend the identifiers
_DAY_FIGIS = f"""hd AS ({SQL["ingest_holdings"].replace("FROM master)", "FROM master WHERE CAST(substr(FIGI, 2) AS BIGINT) % 50 = 0)")}),
{FIGI_MAP_SQL.replace("fm AS", "fm0 AS")}, fm AS (SELECT * FROM fm0 UNION ALL SELECT TICKER, max(FIGI) FROM hd WHERE FIGI IS NOT NULL AND TICKER NOT IN (SELECT TICKER FROM fm0) GROUP BY 1)"""
_DAY_MACRO = SQL["ingest_macro"]
query(
    "daily_run",
    f"""WITH {_LANDED.replace(FIGI_MAP_SQL, _DAY_FIGIS)}, {_new_sql("TICKER, FIGI, KIND, VALUE")}, {COMPANIES_SQL}, {_prices_sql("TRUE", "fm")},
al AS (SELECT "DATE", TICKER, FIGI, KIND, VALUE, DATASET FROM fresh, {_tables_sql(_VENDORS)}
UNION ALL SELECT DATE '2024-02-01', 'U' || c.ID, fm.FIGI, NULL, c.ID, 'company_info' FROM comp c LEFT JOIN fm ON fm.TICKER = 'U' || c.ID
UNION ALL SELECT NULL, NULL, NULL, {FULL_SQL}, NULL, 'addresses' FROM comp WHERE ID % 4 <> 0
UNION ALL SELECT "DATE", TICKER, FIGI, NAME, WEIGHT, 'holdings' FROM hd
UNION ALL SELECT NULL, TICKER, NULL, NAME, NULL, 'security_master' FROM ({SQL["ingest_security_master"]})
UNION ALL SELECT "DATE", TICKER, FIGI, NULL, ADJ_CLOSE, 'prices' FROM px
UNION ALL SELECT "DATE", TICKER, FIGI, NULL, ADJ_CLOSE, 'prices' FROM ({_SERIES_ROWS}) WHERE "DATE" >= DATE '2000-01-01'
UNION ALL SELECT CAST(OBSERVATION_START + 1 AS DATE), TICKER, NULL, FREQUENCY, NULL, 'fred_series' FROM meta
UNION ALL SELECT OBSERVATION_DATE, TICKER, NULL, NULL, VALUE, 'fred_economic_data' FROM ({_DAY_MACRO}))
SELECT "DATE", TICKER, FIGI, KIND, {rs("VALUE", 9)} AS VALUE, DATASET FROM al""",
    ("snap", "ser", "meta"),
)(_daily)

_NOT_HELD = "TICKER NOT IN (SELECT TICKER FROM snap WHERE KIND = 'purchase' AND VALUE > 100)"


@query(
    "subset_run",
    f"""WITH {_LANDED.replace('FROM snap WHERE SEQ % 3 = 0)', f"FROM snap WHERE SEQ % 3 = 0 AND {_NOT_HELD})")}, {_new_sql("TICKER, FIGI, KIND, VALUE")},
{_prices_sql("s." + _NOT_HELD, "fm")},
al AS (SELECT "DATE", TICKER, FIGI, KIND, VALUE, DATASET FROM fresh, {_tables_sql(_VENDORS)}
UNION ALL SELECT "DATE", TICKER, FIGI, KIND, VALUE, 'company_info' FROM batch
UNION ALL SELECT "DATE", TICKER, FIGI, NULL, ADJ_CLOSE, 'prices' FROM px)
SELECT "DATE", TICKER, FIGI, KIND, {rs("VALUE", 9)} AS VALUE, DATASET FROM al""",
    ("snap",),
)
def _subset(spark, sf):
    landed, stored = _day(spark, sf)
    per_name = ("prices", "prices_history", *jobs.SPECS)
    landed = {n: landed[n] for n in per_name} | {"company_info": landed["officers"]}
    rows = snapshot(spark, sf)
    mapping = cut_lineage(figi_map(spark, sf))
    stored = {n: stored[n] for n in ("prices", *jobs.SPECS)}
    return _run(jobs.subset_run(landed, stored, mapping, rows.where("KIND = 'purchase' AND VALUE > 100"), rows))


# ------------------------------------------------------------------ macro windows
query(
    "batch_windows",
    """WITH b AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INTEGER) AS e FROM orders),
w AS (SELECT o_orderkey, i, CAST(s + to_years(CAST(i AS INTEGER)) AS DATE) AS bs, CAST(s + to_years(CAST(i + 1 AS INTEGER)) AS DATE) - 1 AS be, e FROM b, range(0, 4) r(i))
SELECT o_orderkey, CAST(i AS INTEGER) AS BATCH, bs AS BATCH_START, least(be, e) AS BATCH_END FROM w WHERE bs <= e""",
)(
    lambda spark, sf: macro.date_batches(
        load(spark, sf, "orders").select(
            "o_orderkey",
            F.col("o_orderdate").cast("date").alias("START"),
            F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 900).cast("int")).alias("END"),
        )
    ).select("o_orderkey", "BATCH", "BATCH_START", "BATCH_END")
)
query(
    "lookback_start",
    "SELECT min(OBSERVATION_START) AS \"START\", DATE '2024-02-01' - 365 AS LOOKBACK FROM meta".replace(
        "DATE '2024-02-01' - 365", "CAST(DATE '2024-02-01' - 365 AS DATE)"
    ),
    ("meta",),
)(
    lambda spark, sf: macro.full_history_start(series_metadata(spark, sf)).withColumn("LOOKBACK", macro.lookback_start("2024-02-01"))
)
query(
    "per_series_start",
    "SELECT TICKER, greatest(DATE '2020-03-01', OBSERVATION_START) AS \"START\" FROM meta",
    ("meta",),
)(
    lambda spark, sf: macro.per_series_start(series_metadata(spark, sf), F.lit("2020-03-01").cast("date")).select("TICKER", "START")
)
query("split_by_frequency", "SELECT TICKER, ROUTE FROM meta", ("meta",))(
    lambda spark, sf: macro.split_by_frequency(series_metadata(spark, sf)).select("TICKER", "ROUTE")
)
query(
    "stabilise_daily",
    f"WITH {VINTAGES_SQL} SELECT TICKER, OBSERVATION_DATE, VALUE, OBSERVATION_DATE AS REALTIME_START, OBSERVATION_DATE AS REALTIME_END, SEQ FROM vin",
    ("snap",),
)(lambda spark, sf: macro.stabilise_daily(vintages(spark, sf)))
query(
    "normalise_revised",
    f"WITH {VINTAGES_SQL} SELECT {_VIN_COLS} FROM vin WHERE SEQ % 13 <> 0",
    ("snap",),
)(
    lambda spark, sf: macro.normalise_revised(
        vintages(spark, sf).select(
            F.concat(F.lower("TICKER"), F.lit(" ")).alias("TICKER"),
            F.when(F.col("SEQ") % 13 != 0, F.col("OBSERVATION_DATE").cast("string")).alias("OBSERVATION_DATE"),
            F.col("VALUE").cast("string").alias("VALUE"),
            F.col("REALTIME_START").cast("string").alias("REALTIME_START"),
            F.col("REALTIME_END").cast("string").alias("REALTIME_END"),
        )
    )
)
query(
    "series_catalogue",
    """SELECT TICKER, arg_min(KIND, KIND) AS CATEGORY FROM snap WHERE TICKER NOT IN ('U1', 'U2') GROUP BY 1""",
    ("snap",),
)(
    lambda spark, sf: macro.catalogue_rows(
        snapshot(spark, sf).groupBy(F.col("KIND").alias("CATEGORY"), (F.col("SEQ") % 100).alias("_part")).agg(
            F.collect_set("TICKER").alias("CODES")
        ).withColumn("RANK", F.lit(0)),
        inactive=["U1", "U2"],
    )
)

# ------------------------------------------------------------------ streams, run to completion on the given rows
query(
    "stream_diff_append",
    """SELECT min("DATE") AS "DATE", TICKER, KIND, VALUE FROM snap GROUP BY TICKER, KIND, VALUE""",
    ("snap",),
)(lambda spark, sf: streams.replay_diff_append(spark, sf))
query(
    "stream_dedup",
    'SELECT DISTINCT TICKER, "DATE" FROM snap',
    ("snap",),
)(lambda spark, sf: streams.replay_dedup(spark, sf))
query(
    "stream_latest",
    """SELECT 'U' || user_id AS TICKER, event_id AS SEQ, ts FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)(lambda spark, sf: streams.replay_latest(spark, sf))
