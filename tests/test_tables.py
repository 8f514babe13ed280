"""Reads, cleaning, filters and differences on literal frames."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import day
from tickloom.functions import text
from tickloom.functions.text import classify_transaction
from tickloom.operators import aggregates, cleaning, diff, filters
from tickloom.plans import ingest
from tickloom.sources import sinks, tables
from tickloom.sources.catalog import MarketTables
from tickloom.streaming import jobs


def test_reads_reject_two_identifier_lists(spark):
    prices = spark.createDataFrame([(day("2024-01-01"), "A", "F", 1.0)], "DATE date, TICKER string, FIGI string, ADJ_CLOSE double")
    source = MarketTables(spark, tables={"prices": prices})
    with pytest.raises(ValueError):
        tables.get_prices(source, tickers=["A"], figis=["F"])
    assert tables.get_prices(source, tickers=[]).count() == 1
    with pytest.raises(ValueError):
        tables.get_prices(MarketTables(spark, tables={"prices": prices.drop("ADJ_CLOSE")}))


def test_holdings_latest_before_strategy_latest_after_the_security_filter(spark):
    rows = [(day("2024-01-02"), "X", "A"), (day("2024-01-03"), "X", "B")]
    held = spark.createDataFrame(rows, "DATE date, INDEX string, TICKER string")
    source = MarketTables(spark, tables={"holdings": held, "llm": held.withColumnRenamed("INDEX", "STRATEGY")})
    assert tables.get_index_holdings(source, tickers=["A"], get_latest=True).count() == 0
    assert tables.get_llm_holdings(source, tickers=["A"], get_latest=True).count() == 1


def test_holdings_filter_and_normalisation(spark):
    columns = "ASSET_CLASS TICKER NAME MARKET_VALUE WEIGHT QUANTITY PRICE LOCATION EXCHANGE CURRENCY FX_RATE INDEX".split()
    base = ["Apple", "100", "60", "1", "100", "United States", "NASDAQ", "USD", "1", "S&P 500"]
    rows = [
        ["Equity", "AAPL", *base],
        ["Equity", "--", *base],
        ["Bond", "MSFT", *base],
        ["Equity", "XYZ", *base[:6], "Nowhere", *base[7:]],
    ]
    raw = spark.createDataFrame(rows, columns)
    master = spark.createDataFrame(
        [(day("2020-01-01"), "AAPL", "Apple", "United States", "BBG1")], "DATE date, TICKER string, NAME string, LOCATION string, FIGI string"
    )
    with pytest.raises(Exception, match="row count out of bounds"):
        ingest.ingest_holdings(raw, master, ["NASDAQ"], "2024-03-01").collect()
    out = ingest.ingest_holdings(raw, master, ["NASDAQ"], "2024-03-01", bounds=None).collect()
    assert [(r["TICKER"], r["WEIGHT"], r["FIGI"]) for r in out] == [("AAPL", 1.0, "BBG1")]


def test_row_count_bounds_fail(spark):
    rows = spark.createDataFrame([("S&P 500",)], "INDEX string")
    with pytest.raises(Exception, match="row count out of bounds"):
        filters.check_counts(rows, "INDEX").collect()


def test_diff_ignores_dates_and_batch_repeats(spark):
    schema = "TICKER string, NAME string, TITLE string, DATE date"
    existing = spark.createDataFrame([("AAPL", "Tim Cook", "CEO", day("2026-01-01"))], schema)
    incoming = spark.createDataFrame(
        [
            ("AAPL", "Tim Cook", "CEO", day("2026-01-02")),
            ("AAPL", "Tim Cook", "CEO", day("2026-01-03")),
            ("MSFT", "Satya Nadella", "CEO", day("2026-01-02")),
        ],
        schema,
    )
    fresh = diff.diff_rows(incoming, existing)
    assert [r["TICKER"] for r in fresh.collect()] == ["MSFT"]
    assert diff.diff_counts(incoming, fresh).first().asDict() == {"WRITTEN": 1, "SKIPPED": 2}
    assert diff.diff_rows(incoming, existing.unionByName(fresh)).count() == 0


def test_diff_compares_meaning_not_type(spark):
    existing = spark.createDataFrame(
        [(1, "100", "2026-02-28", "2026-03-01 15:47:12")], "IN_THE_MONEY int, STRIKE string, LASTTRADEDATE string, EXPIRATION string"
    )
    incoming = spark.createDataFrame(
        [(True, 100.0, "2026-02-28T00:00:00Z", "2026-03-01")],
        "IN_THE_MONEY boolean, STRIKE double, LASTTRADEDATE string, EXPIRATION string",
    )
    assert diff.diff_rows(incoming, existing).count() == 0


def test_vintage_refresh_replaces_only_newer_groups(spark):
    schema = "TICKER string, OBSERVATION_DATE string, VALUE double, REALTIME_START string, REALTIME_END string"

    def typed(df):
        return df.withColumns({c: F.col(c).cast("date") for c in ("OBSERVATION_DATE", "REALTIME_START", "REALTIME_END")})

    incoming = typed(
        spark.createDataFrame(
            [
                ("CPI", "2025-03-01", 319.615, "2025-04-10", "2026-02-12"),
                ("CPI", "2025-03-01", 320.111, "2026-02-13", "9999-12-31"),
                ("CPI", "2025-04-01", 321.0, "2025-05-13", "9999-12-31"),
            ],
            schema,
        )
    )
    existing = typed(
        spark.createDataFrame(
            [
                ("CPI", "2025-03-01", 319.615, "2025-05-13", "9999-12-31"),
                ("CPI", "2025-04-01", 321.0, "2025-05-13", "9999-12-31"),
            ],
            schema,
        )
    )
    due = diff.refresh_groups(incoming, existing)
    assert {(str(r["OBSERVATION_DATE"]), r["ACTION"]) for r in due.collect()} == {("2025-03-01", "replace")}
    after = diff.replace_groups(existing, due, ["TICKER", "OBSERVATION_DATE"])
    assert after.count() == 3
    assert diff.refresh_groups(incoming, after).count() == 0


@pytest.mark.parametrize(
    "text, label",
    [
        ("Sale at price 10", "SELL"),
        ("Stock gift, then sale", "GIFT"),
        ("Stock GRANT of a gift", "GRANT"),
        ("Conversion of grant", "CONVERSION"),
        ("Purchase after conversion", "BUY"),
        (None, "BUY"),
    ],
)
def test_classify(spark, text, label):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(classify_transaction("t").alias("c")).first()["c"] == label


def test_align_and_delete(spark):
    df = spark.createDataFrame([("a", "7"), ("b", "x")], "k string, extra string")
    schema = spark.createDataFrame([], "v int, k string").schema
    assert sinks.align(df, schema).columns == ["v", "k"]
    assert sinks.delete_where(df, F.col("extra") == "7").count() == 1
    with pytest.raises(ValueError):
        sinks.delete_where(df, None)


def test_require_finite_fails(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(Exception, match="non-finite"):
        cleaning.require_finite(df, ["x"]).collect()


def test_numeric_only_when_all_parse(spark):
    df = spark.createDataFrame([("1", "1"), ("2.5", "x")], "a string, b string")
    assert dict(cleaning.to_numeric_columns(df).dtypes) == {"a": "double", "b": "string"}


def test_fund_totals_leave_the_lines_where_they_are_read(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = [(f"I{k % 3}", f"T{k}", "n", float(k + 1)) for k in range(300)] + [(None, "T", "n", 1.0), ("I0", "T", "n", None)]
    spark.createDataFrame(rows, "INDEX string, TICKER string, NAME string, WEIGHT double").write.parquet(path)
    out = aggregates.normalize_weights(spark.read.parquet(path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    sums = {r["INDEX"]: round(r["t"], 9) for r in out.groupBy("INDEX").agg(F.sum("WEIGHT").alias("t")).collect()}
    assert sums == {"I0": 1.0, "I1": 1.0, "I2": 1.0} and out.count() == 301


def test_rollup_ranks_distinct_lines_up_to_the_last_attribute(spark):
    schema = "INDEX string, TICKER string, EXCHANGE string, ASSET_CLASS string, NAME string, PRICE double"
    rows = [("I", "T", None, "b", "z", 1.0), ("I", "T", "y", "b", "q", 2.0), ("I", "T", "y", "a", None, 3.0), ("I", "T", "y", "b", "p", None)]
    df = spark.createDataFrame(rows * 50 + [(None, None, None, None, None, 1.0)], schema)
    out = aggregates.holdings_rollup(df, ["INDEX", "TICKER"])
    got = {r["TICKER"]: (r["EXCHANGE"], r["NAME"], r["PRICE"]) for r in out.collect()}
    assert got == {"T": ("y", "p", 300.0), None: (None, None, 1.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    ranked = next(line for line in plan.splitlines() if "row_number()" in line)
    assert "_order2" in ranked and "_order3" not in ranked  # not the price


def test_signature_casts_whatever_can_be_a_number(spark):
    texts = ["\t5", " 5 ", "+.5", "-5e0", ".5", "5.", "5d", "0x1p3", "Infinity", "-inf", "+INF", "NaN", "nan ", "U5", "inf5", ".", "- 5", "", None, "5,0", "٥"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    number = F.trim("t").try_cast("double")
    tried = F.when(F.trim("t").rlike(text._NUMBER_START), F.trim("t")).try_cast("double")
    assert df.where(~number.eqNullSafe(tried)).count() == 0
    assert df.where(F.trim("t").rlike(text._NUMBER_START)).count() < len(texts) - 4


# ---------------------------------------------------------------- streams of several batches
def _stream(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_diff_append_sees_earlier_batches(spark, tmp_path):
    landed, table, state = (str(tmp_path / n) for n in ("landed", "table", "state"))
    schema = "TICKER string, VALUE double, DATE string"

    def run():
        source = jobs.stream_table(spark, landed, files_per_batch=1)
        jobs.stream_diff_append(source, table, state, keys=["TICKER"]).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["TICKER"], r["VALUE"], r["DATE"]) for r in spark.read.parquet(table).collect())

    _stream(spark, landed, [("A", 1.0, "d1"), ("B", 1.0, "d1"), ("B", 1.0, "d1")], schema)
    _stream(spark, landed, [("A", 2.0, "d2"), ("B", 1.0, "d2")], schema)  # A changed, B did not
    first = [("A", 1.0, "d1"), ("A", 2.0, "d2"), ("B", 1.0, "d1")]
    assert run() == first
    _stream(spark, landed, [("A", 2.0, "d3"), ("B", 1.0, "d3")], schema)  # a repeated batch
    assert run() == first
    assert len({r["_batch"] for r in spark.read.parquet(table).collect()}) == 2


def test_replayed_events_land_in_as_many_files_as_tasks_read_them(spark, tmp_path):
    source = str(tmp_path / "sf")
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 30), i % 5, "view", float(i % 7)) for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    events.repartition(4).write.parquet(f"{source}/events.parquet")
    seen = []

    def start(stream):
        batch = lambda rows, i: seen.append((i, rows.count(), len(set(rows.sparkSession.read.parquet(folder[0]).inputFiles()))))
        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "state"))

    folder, own = [], jobs._folder
    jobs._folder = lambda *args: folder.append(own(*args)) or folder[-1]
    try:
        jobs._replay(spark, source, start)
    finally:
        jobs._folder = own
    assert [s[:2] for s in seen] == [(0, 220), (1, 220), (2, 160)]
    assert seen[0][2] > 1 and seen[-1][2] > 3
    table = jobs.replay_diff_append(spark, source)
    want = events.groupBy("user_id", "value").agg(F.min("ts")).count()
    assert table.count() == want


def test_stream_dedup_and_latest_with_a_late_row(spark, tmp_path):
    landed = str(tmp_path / "landed")
    schema = "k string, at timestamp, n long"
    day = lambda d: datetime.datetime(2024, 1, d)
    _stream(spark, landed, [("A", day(1), 1), ("A", day(1), 2), ("B", day(9), 3)], schema)
    _stream(spark, landed, [("A", day(1), 4), ("C", day(8), 5), ("B", day(9), 6)], schema)  # A comes long after its time
    _stream(spark, landed, [("C", day(20), 7), ("B", day(9), 8)], schema)
    source = jobs.stream_table(spark, landed, files_per_batch=1)
    kept = jobs.stream_dedup(source, ["k"], "at", "2 days")
    out, state = str(tmp_path / "kept"), str(tmp_path / "kept-state")
    run = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    run.trigger(availableNow=True).start().awaitTermination()
    rows = sorted((r["k"], r["n"]) for r in spark.read.parquet(out).collect())
    assert [k for k, _ in rows] == ["A", "B", "C"] and ("A", 4) not in rows
    seen = {}
    newest = jobs.stream_latest(source, ["k"], "at", "n")
    query = newest.writeStream.outputMode("update").foreachBatch(
        lambda batch, i: seen.update({r["k"]: (r["at"], r["n"]) for r in batch.collect()})
    )
    query.option("checkpointLocation", str(tmp_path / "latest")).trigger(availableNow=True).start().awaitTermination()
    assert seen == {"A": (day(1), 4), "B": (day(9), 8), "C": (day(20), 7)}


# ---------------------------------------------------------------- what a second run and a renamed ticker do
def test_unmapped_rows_are_not_appended_twice(spark):
    landed = spark.createDataFrame([("A", "x"), ("B", "y")], "TICKER string, NAME string")
    mapping = spark.createDataFrame([("A", "F1")], "TICKER string, FIGI string")
    empty = spark.createDataFrame([], "DATE date, TICKER string, NAME string, FIGI string")
    first = ingest.ingest("officers", landed, empty, mapping)
    assert first.count() == 2
    assert ingest.ingest("officers", landed, empty.unionByName(first), mapping).count() == 0


def test_prices_follow_the_figi_of_a_renamed_ticker(spark):
    schema = "DATE date, TICKER string, FIGI string, ADJ_CLOSE double, DIVIDENDS double, STOCK_SPLITS double"
    stored = spark.createDataFrame([(day("2024-01-02"), "OLD", "F1", 1.0, 0.0, 0.0), (day("2024-01-02"), "C", "F3", 5.0, 0.0, 0.0)], schema)
    landed = spark.createDataFrame(
        [(day("2024-01-02"), "NEW", 1.0, 0.0, 0.0), (day("2024-01-03"), "NEW", 2.0, 0.5, 0.0), (day("2024-01-03"), "C", 6.0, 0.5, 0.0)],
        "DATE date, TICKER string, ADJ_CLOSE double, DIVIDENDS double, STOCK_SPLITS double",
    )
    mapping = spark.createDataFrame([("NEW", "F1"), ("C", "F3")], "TICKER string, FIGI string")
    fresh = spark.createDataFrame([(day("2024-01-02"), "NEW", 0.5, 0.0, 0.0)], "DATE date, TICKER string, ADJ_CLOSE double, DIVIDENDS double, STOCK_SPLITS double")
    out = sorted((r["FIGI"], str(r["DATE"]), r["ADJ_CLOSE"]) for r in ingest.ingest_prices(landed, stored, mapping).collect())
    assert out == [("F1", "2024-01-02", 1.0), ("F1", "2024-01-03", 2.0), ("F3", "2024-01-02", 5.0), ("F3", "2024-01-03", 6.0)]
    # F1 is reloaded in full; F3 is due too, but the pull does not bring it
    out = sorted((r["FIGI"], str(r["DATE"]), r["ADJ_CLOSE"]) for r in ingest.ingest_prices(landed, stored, mapping, fresh).collect())
    assert out == [("F1", "2024-01-02", 0.5), ("F3", "2024-01-02", 5.0), ("F3", "2024-01-03", 6.0)]


def test_rollup_and_last_cells_skip_nulls(spark):
    rows = [("2024-01-01", "I", "T", None, 1.0, 1), ("2024-01-01", "I", "T", "name", 2.0, 2)]
    df = spark.createDataFrame(rows, "DATE string, INDEX string, TICKER string, NAME string, WEIGHT double, n int")
    got = aggregates.holdings_rollup(df, tie="n").first()
    assert (got["NAME"], got["WEIGHT"]) == ("name", 3.0)
    cells = spark.createDataFrame([("r", "c", 5.0, 1), ("r", "c", None, 2)], "i string, k string, v double, at int")
    assert aggregates.pivot_last(cells, "i", "k", "v", "at", ["c"]).first()["c"] == 5.0


def test_daily_run_goes_from_holdings_to_prices_and_macro(spark):
    header = ["ASSET_CLASS", "TICKER", "NAME", "MARKET_VALUE", "WEIGHT", "QUANTITY", "PRICE", "LOCATION", "EXCHANGE", "CURRENCY", "FX_RATE", "INDEX"]
    held = spark.createDataFrame([("Equity", "AAPL", "Apple", "1", "1", "1", "1", "United States", "NASDAQ", "USD", "1", "Mine")], header)
    master = spark.createDataFrame([(day("2020-01-01"), "AAPL", "Apple", "United States", "F1")], "DATE date, TICKER string, NAME string, LOCATION string, FIGI string")
    schema = "DATE date, TICKER string, FIGI string, ADJ_CLOSE double, DIVIDENDS double, STOCK_SPLITS double"
    pulled = "DATE date, TICKER string, ADJ_CLOSE double, DIVIDENDS double, STOCK_SPLITS double"
    landed = {
        "holdings": held,
        "index_prices": spark.createDataFrame([(day("2024-01-02"), "SPX", 9.0, 0.0, 0.0)], pulled),
        "prices": spark.createDataFrame([(day("2024-01-02"), "AAPL", 1.0, 0.0, 0.0)], pulled),
        "officers": spark.createDataFrame([("AAPL", "Tim")], "TICKER string, NAME string"),
    }
    stored = {
        "security_master": master, "prices": spark.createDataFrame([], schema),
        "officers": spark.createDataFrame([], "DATE date, TICKER string, NAME string, FIGI string"),
    }
    none = spark.createDataFrame([], "TICKER string, FIGI string")
    out = ingest.daily_run(landed, stored, none, ["NASDAQ"], "2024-03-01")
    assert list(out) == ["holdings", "prices", "officers"]
    # the holdings' members map the identifiers of what follows
    assert sorted((r["TICKER"], r["FIGI"]) for r in out["prices"].collect()) == [("AAPL", "F1"), ("SPX", None)]
    assert [r["FIGI"] for r in out["officers"].collect()] == ["F1"]
    own = ingest.subset_run(landed, stored, none, none, spark.createDataFrame([("AAPL",)], "TICKER string"))
    assert list(own) == ["prices", "officers"] and own["prices"].count() == 1


def test_daily_run_writes_the_holdings_that_it_reads_again(spark):
    header = ["ASSET_CLASS", "TICKER", "NAME", "MARKET_VALUE", "WEIGHT", "QUANTITY", "PRICE", "EXCHANGE", "INDEX"]
    held = spark.createDataFrame([("Equity", "AAPL", "Apple", "1", "1", "1", "1", "NASDAQ", "Mine")], header)
    master = spark.createDataFrame([(day("2020-01-01"), "AAPL", "Apple", "United States", "F1")], "DATE date, TICKER string, NAME string, LOCATION string, FIGI string")
    none = spark.createDataFrame([], "TICKER string, FIGI string")
    out = ingest.daily_run({"holdings": held}, {"security_master": master}, none, ["NASDAQ"], "2024-03-01")["holdings"]
    assert out.inputFiles() and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["TICKER"], r["FIGI"], r["WEIGHT"]) for r in out.collect()] == [("AAPL", "F1", 1.0)]


def test_stream_latest_takes_any_tie_and_whole_rows(spark, tmp_path):
    landed = str(tmp_path / "landed")
    schema = "k string, at date, n decimal(30,0), more array<int>"
    big = 10**25
    first = [("A", day("2024-03-01"), -5, [1]), ("A", day("2024-03-01"), -7, [2]), ("B", None, 3, [3])]
    second = [("A", day("2024-03-01"), big, [4]), ("B", day("2024-02-01"), -1, None), ("C", None, 1, [5])]
    for rows in (first, second):
        _stream(spark, landed, [(k, at, Decimal(n), more) for k, at, n, more in rows], schema)
    newest = jobs.stream_latest(jobs.stream_table(spark, landed, files_per_batch=1), ["k"], "at", "n", ["more"])
    run = newest.writeStream.outputMode("complete").format("memory").queryName("latest_rows").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = {r["k"]: (r["at"], int(r["n"]), r["more"]) for r in spark.table("latest_rows").collect()}
    assert rows == {"A": (day("2024-03-01"), big, [4]), "B": (day("2024-02-01"), -1, None), "C": (None, 1, [5])}
