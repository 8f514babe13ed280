"""Row filters and checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: rows accepted per index, inclusive
ROW_BOUNDS = {
    "S&P 500": (450, 550),
    "Russell 1000": (900, 1100),
}


def normalized(column: str | Column) -> Column:
    """Identifier text as it is compared everywhere: trimmed and upper-case."""
    return F.upper(F.trim(F.col(column) if isinstance(column, str) else column))


def in_filter(df: DataFrame, column: str, values: Iterable[str] | None, joined: bool = False) -> DataFrame:
    """Keep rows whose column is in the list; an empty list keeps everything.

    The list is a literal predicate that reaches the Parquet scan; a caller
    with a list too long for that asks for a semi join (``joined``).
    """
    wanted = list(dict.fromkeys(values or []))
    if not wanted:
        return df
    if not joined:
        return df.where(F.col(column).isin(wanted))
    lookup = df.sparkSession.createDataFrame([(v,) for v in wanted], f"`{column}` {df.schema[column].dataType.simpleString()}")
    return df.join(lookup, column, "left_semi")


def date_filter(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Inclusive date range; comparing the bare column keeps the pushdown."""
    is_date = df.schema[column].dataType.simpleString() == "date"
    value = F.col(column) if is_date else F.col(column).cast("date")
    if start is not None:
        bound = F.lit(str(start)).cast("date")
        df = df.where((F.col(column) >= bound) if is_date else (F.col(column) >= bound.cast("timestamp_ntz")))
    if end is not None:
        bound = F.lit(str(end)).cast("date")
        if is_date:
            df = df.where(value <= bound)
        else:
            df = df.where(F.col(column) < F.date_add(bound, 1).cast("timestamp_ntz"))
    return df


def security_filter(df: DataFrame, tickers=None, figis=None, ticker_column="TICKER", figi_column="FIGI") -> DataFrame:
    """Filter by ticker or by FIGI, never by both."""
    tickers = [tickers] if isinstance(tickers, str) else list(tickers or [])
    figis = [figis] if isinstance(figis, str) else list(figis or [])
    if tickers and figis:
        raise ValueError("give tickers or figis, not both")
    if tickers:
        return in_filter(df, ticker_column, [t.strip().upper() for t in tickers])
    return in_filter(df, figi_column, [f.strip().upper() for f in figis])


def clean_holdings(df: DataFrame, exchanges: Sequence[str], asset_class: str = "Equity") -> DataFrame:
    """Equity rows with a real ticker, on an allowed exchange, with positive weight."""
    weight = F.col("WEIGHT").try_cast("double")
    return df.where(
        (F.col("ASSET_CLASS") == asset_class)
        & (F.col("TICKER") != "--")
        & F.col("EXCHANGE").isin(list(exchanges))
        & (weight > 0)
    )


def rows_from_start(df: DataFrame, starts: DataFrame, key: str = "TICKER", date: str = "DATE") -> DataFrame:
    """Rows on or after the key's own start date; keys without one are kept.

    ``starts`` has one row per key in ``key`` and ``START_DATE``.
    """
    mapped = starts.select(F.col(key), F.col("START_DATE").alias("_start"))
    return (
        df.join(mapped, key, "left")
        .where(F.col("_start").isNull() | (F.col(date).cast("date") >= F.col("_start")))
        .drop("_start")
    )


def eligible_starts(starts: DataFrame, today) -> DataFrame:
    """Flag start dates that are not in the future."""
    return starts.withColumn("ELIGIBLE", F.col("START_DATE") <= F.lit(str(today)).cast("date"))


def adjusted_keys(df: DataFrame, key: str = "TICKER") -> DataFrame:
    """Keys with a dividend or a split among these rows."""
    return df.where((F.col("DIVIDENDS") > 0) | (F.col("STOCK_SPLITS") > 0)).select(key).distinct()


def tradable(panel: DataFrame, include_no_data: bool = False, include_negative: bool = False) -> DataFrame:
    """Panel rows a strategy may trade on their date."""
    if include_no_data:
        return panel
    out = panel.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return out if include_negative else out.where(F.col("value") > 0)


def items_in_pool(df: DataFrame, pool: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys appear in the pool."""
    return df.join(pool.select(*keys).distinct(), list(keys), "left_semi")


def items_not_in_pool(df: DataFrame, pool: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys do not appear in the pool."""
    return df.join(pool.select(*keys).distinct(), list(keys), "left_anti")


def row_counts(df: DataFrame, key: str, bounds: Mapping[str, tuple[int, int]] = ROW_BOUNDS) -> DataFrame:
    """Row count per key with its bounds; keys without bounds pass."""
    known = df.sparkSession.createDataFrame(
        [(k, int(lo), int(hi)) for k, (lo, hi) in bounds.items()], f"`{key}` string, LOW long, HIGH long"
    )
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("ROWS"))
        .join(known, key, "left")
        .withColumn("OK", F.coalesce(F.col("ROWS").between(F.col("LOW"), F.col("HIGH")), F.lit(True)))
    )


def check_counts(df: DataFrame, key: str, bounds: Mapping[str, tuple[int, int]] = ROW_BOUNDS) -> DataFrame:
    """The counts, failing the job when a key is out of its bounds."""
    counts = row_counts(df, key, bounds)
    message = F.concat(F.lit("row count out of bounds for "), F.col(key))
    return counts.where(F.when(~F.col("OK"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
