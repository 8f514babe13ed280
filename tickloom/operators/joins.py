"""Identifier maps and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.places import is_us
from tickloom.operators.filters import normalized
from tickloom.operators.snapshots import pick_row


def join_latest_dates(df: DataFrame, keys: Sequence[str], date: str = "DATE") -> DataFrame:
    """Rows on the newest date of their key."""
    from tickloom.operators.snapshots import latest_date_rows

    return latest_date_rows(df, keys, date)


def attach_figi(holdings: DataFrame, master: DataFrame) -> DataFrame:
    """FIGI from the deduplicated master on normalised (TICKER, NAME)."""
    lookup = master.select(
        normalized("TICKER").alias("_ticker"), normalized("NAME").alias("_name"), F.col("FIGI").alias("_figi")
    ).where(F.col("_ticker").isNotNull())
    first = pick_row(lookup, ["_ticker", "_name"], [F.col("_figi")], largest=False)
    keyed = holdings.withColumn("_ticker", normalized("TICKER")).withColumn("_name", normalized("NAME"))
    joined = keyed.join(first, ["_ticker", "_name"], "left")
    return joined.select(*[c for c in holdings.columns if c != "FIGI"], F.col("_figi").alias("FIGI"))


def missing_in_master(holdings: DataFrame, master: DataFrame) -> DataFrame:
    """Tickers of the holdings without a master row."""
    known = master.select(normalized("TICKER").alias("TICKER")).distinct()
    return holdings.select(normalized("TICKER").alias("TICKER")).distinct().join(known, "TICKER", "left_anti")


def map_figi_coalesce(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """The row's own FIGI, else the mapped one of its ticker."""
    lookup = mapping.select("TICKER", F.col("FIGI").alias("_mapped"))
    joined = df.join(lookup, "TICKER", "left")
    own = F.col("FIGI") if "FIGI" in df.columns else F.lit(None).cast("string")
    return joined.select(*[c for c in df.columns if c != "FIGI"], F.coalesce(own, F.col("_mapped")).alias("FIGI"))


def map_back(mapping: DataFrame, figis: DataFrame) -> DataFrame:
    """Distinct tickers of a list of FIGIs."""
    return mapping.join(figis.select("FIGI").distinct(), "FIGI", "left_semi").select("TICKER").distinct()


def ticker_figi_map(master: DataFrame) -> DataFrame:
    """One FIGI per ticker: the smallest, so that the choice does not depend on row order."""
    return (
        master.where(F.col("TICKER").isNotNull() & F.col("FIGI").isNotNull())
        .groupBy(normalized("TICKER").alias("TICKER"))
        .agg(F.min("FIGI").alias("FIGI"))
    )


def figi_to_ticker(info: DataFrame) -> DataFrame:
    """The last non-empty ticker of each FIGI by date."""
    known = info.where(F.trim("TICKER") != "")
    return known.groupBy(normalized("FIGI").alias("FIGI")).agg(
        F.max_by(normalized("TICKER"), F.struct("DATE", "TICKER")).alias("TICKER")
    )


def ticker_to_figi(figi_map: DataFrame) -> DataFrame:
    """The reverse map keeps the first FIGI of a ticker."""
    return figi_map.groupBy("TICKER").agg(F.min("FIGI").alias("FIGI"))


def anti_join_universe(universe: DataFrame, master: DataFrame) -> DataFrame:
    """Rows the master does not know: at home by (TICKER, NAME), abroad by (TICKER, LOCATION)."""
    rows = universe.select(
        normalized("TICKER").alias("TICKER"), F.trim("NAME").alias("NAME"), F.trim("LOCATION").alias("LOCATION")
    ).where(F.col("TICKER") != "")
    known = master.select(
        normalized("TICKER").alias("TICKER"), F.trim("NAME").alias("NAME"), F.trim("LOCATION").alias("LOCATION")
    )
    home, abroad = rows.where(is_us("LOCATION")), rows.where(~is_us("LOCATION"))
    new_home = home.join(known.select("TICKER", "NAME").distinct(), ["TICKER", "NAME"], "left_anti")
    new_abroad = abroad.join(known.select("TICKER", "LOCATION").distinct(), ["TICKER", "LOCATION"], "left_anti")
    return new_home.unionByName(new_abroad).distinct()


def metadata_merge(config: DataFrame, metadata: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Configured series with the vendor's metadata, in a fixed column order."""
    extra = metadata.select("TICKER", *[c for c in metadata.columns if c not in config.columns])
    joined = config.join(extra, "TICKER", "left")
    return joined.select(*[F.col(c) if c in joined.columns else F.lit(None).cast("string").alias(c) for c in columns])


def address_cache_join(df: DataFrame, cache: DataFrame, keys: Sequence[str] = ("ADDRESS1", "CITY", "COUNTRY")) -> DataFrame:
    """First cached coordinates of an address."""
    first = pick_row(cache.select(*keys, "LAT", "LON"), keys, [F.col("LAT"), F.col("LON")], largest=False)
    return df.join(first, list(keys), "left")


def missing_addresses(info: DataFrame, cache: DataFrame) -> DataFrame:
    """Company rows with an address that is not cached yet."""
    present = info.na.drop(subset=["ADDRESS1"])
    return present.join(cache.select("ADDRESS1").distinct(), "ADDRESS1", "left_anti").select(*info.columns)


def weights_sector_join(weights: DataFrame, sectors: DataFrame, keys: Sequence[str] = ("DATE", "FIGI")) -> DataFrame:
    return weights.join(sectors, list(keys))


def backfill_joins(weights: DataFrame, metadata: DataFrame, prices: DataFrame) -> DataFrame:
    """Weights with their holding metadata and the price of the day."""
    return weights.join(metadata, "FIGI", "left").join(prices, ["DATE", "FIGI"], "left")
