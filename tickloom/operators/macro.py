"""Macro series: routing, windows, vintages and the series catalogue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: pull window defaults
FALLBACK_START = "1900-01-01"
LOOKBACK_DAYS = 365
BATCH_YEARS = 1
DAILY_LABELS = ["d", "daily"]


def date_batches(df: DataFrame, start: str = "START", end: str = "END", years: int = BATCH_YEARS) -> DataFrame:
    """Split each row's [start, end] into consecutive inclusive windows of whole years."""
    spans = F.year(end) - F.year(start)
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.floor(spans / years).cast("int"))).alias("BATCH"))

    def opening(index):
        plain = F.add_months(F.col(start), index * (12 * int(years)))
        if years % 4 == 0:
            return plain
        # a leap-day start moves to the 28th with the second window and stays there
        leap = (F.month(start) == 2) & (F.dayofmonth(start) == 29) & (index > 0)
        return F.when(leap, F.make_date(F.year(plain), F.lit(2), F.lit(28))).otherwise(plain)

    return (
        rows.withColumn("BATCH_START", opening(F.col("BATCH")))
        .withColumn("BATCH_END", F.least(F.date_add(opening(F.col("BATCH") + 1), -1), F.col(end)))
        .where(F.col("BATCH_START") <= F.col(end))
    )


def lookback_start(today, lookback_days: int = LOOKBACK_DAYS, start=None) -> Column:
    """Lower bound of an incremental pull."""
    if start is not None:
        return F.lit(str(start)).cast("date")
    return F.date_sub(F.lit(str(today)).cast("date"), lookback_days)


def full_history_start(metadata: DataFrame, start=None) -> DataFrame:
    """Lower bound of a full pull: given, earliest known, or the fallback; one row."""
    earliest = F.min(F.col("OBSERVATION_START").cast("date"))
    given = F.lit(None if start is None else str(start)).cast("date")
    return metadata.agg(F.coalesce(given, earliest, F.lit(FALLBACK_START).cast("date")).alias("START"))


def per_series_start(metadata: DataFrame, run_start: Column) -> DataFrame:
    """Each series starts at the run start or at its own first observation."""
    own = F.col("OBSERVATION_START").cast("date")
    return metadata.withColumn("START", F.greatest(run_start, own))


def frequency_label() -> Column:
    """Short label where it says something, else the long one, lower-case."""
    short = F.nullif(F.trim("FREQUENCY_SHORT"), F.lit(""))
    return F.lower(F.coalesce(short, F.nullif(F.trim("FREQUENCY"), F.lit(""))))


def split_by_frequency(metadata: DataFrame) -> DataFrame:
    """Route a series: daily ones keep the latest value, the others their revisions."""
    daily = F.coalesce(frequency_label().isin(DAILY_LABELS), F.lit(False))
    return metadata.withColumn("ROUTE", F.when(daily, "daily").otherwise("revised"))


def stabilise_daily(df: DataFrame) -> DataFrame:
    """Daily series carry no vintages: both bounds are the observation date."""
    return df.withColumn("REALTIME_START", F.col("OBSERVATION_DATE")).withColumn("REALTIME_END", F.col("OBSERVATION_DATE"))


def normalise_revised(df: DataFrame) -> DataFrame:
    """Typed vintage rows with complete keys, in table order."""
    return df.select(
        F.upper(F.trim("TICKER")).alias("TICKER"),
        F.col("OBSERVATION_DATE").cast("date").alias("OBSERVATION_DATE"),
        F.col("VALUE").try_cast("double").alias("VALUE"),
        F.col("REALTIME_START").cast("date").alias("REALTIME_START"),
        F.col("REALTIME_END").cast("date").alias("REALTIME_END"),
    ).na.drop(subset=["TICKER", "OBSERVATION_DATE"])


def series_catalogue(
    spark: SparkSession, groups: Mapping[str, Sequence[str]], inactive: Sequence[str] = (), subset: Sequence[str] = ()
) -> DataFrame:
    """Configured series codes with their first category; inactive ones left out."""
    rows = [(g, [c.strip().upper() for c in codes], i) for i, (g, codes) in enumerate(groups.items())]
    return catalogue_rows(
        spark.createDataFrame(rows, "CATEGORY string, CODES array<string>, RANK int"), inactive, subset
    )


def catalogue_rows(groups: DataFrame, inactive: Sequence[str] = (), subset: Sequence[str] = ()) -> DataFrame:
    """Flatten (CATEGORY, CODES, RANK) to one row per code."""
    flat = groups.select("CATEGORY", "RANK", F.explode("CODES").alias("TICKER"))
    out = flat.groupBy("TICKER").agg(F.min_by("CATEGORY", F.struct("RANK", "CATEGORY")).alias("CATEGORY"))
    if inactive:
        out = out.where(~F.col("TICKER").isin(list(inactive)))
    if subset:
        out = out.where(F.col("TICKER").isin(list(subset)))
    return out
