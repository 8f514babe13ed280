"""Grouped reductions on market-data tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.filters import normalized
from tickloom.operators.support import with_scalars
from tickloom.session import cut_lineage

# fixed values: what a price history starts with, and the attributes a roll-up keeps
DEFAULT_START = "2000-01-01"
ROLLUP_SUMS = ["MARKET_VALUE", "WEIGHT", "QUANTITY", "PRICE"]
ROLLUP_FIRSTS = ["NAME", "LOCATION", "EXCHANGE", "CURRENCY", "FX_RATE"]


def next_business_day(date):
    """The weekday after a date."""
    step = F.when(F.dayofweek(date) == 6, 3).when(F.dayofweek(date) == 7, 2).otherwise(1)
    return F.date_add(date, step)


def start_dates(requested: DataFrame, stored: DataFrame, key: str = "TICKER", default: str = DEFAULT_START) -> DataFrame:
    """Next date to pull for each requested key."""
    newest = stored.groupBy(key).agg(F.max("DATE").alias("_max"))
    return requested.select(key).distinct().join(newest, key, "left").select(
        key, F.coalesce(next_business_day(F.col("_max")), F.lit(default).cast("date")).alias("START_DATE")
    )


def normalize_weights(df: DataFrame, keys: Sequence[str] = ("INDEX",), weight: str = "WEIGHT") -> DataFrame:
    """Weights divided by their total over the feed.

    The totals are written first, so that the planner knows their size: a few
    funds are broadcast, and their lines stay in the tasks that read them.
    """
    totals = cut_lineage(df.groupBy(*keys).agg(F.sum(weight).alias("_total")))
    out = df.join(totals, list(keys))
    return out.withColumn(weight, F.col(weight) / F.col("_total")).select(*df.columns)


def holdings_rollup(df: DataFrame, keys: Sequence[str] = ("DATE", "INDEX", "TICKER"), tie: str | None = None) -> DataFrame:
    """One row per member: amounts summed, each attribute from the first line by ``tie`` that has it.

    Sums are hash aggregates.  Columns that follow the last attribute in the
    order decide nothing, so the lines are made distinct without them; of those
    every task sends the first of each member and attribute, so a member with
    many lines is neither shuffled nor sorted whole.  Null keys are members too.
    """
    sums = [c for c in ROLLUP_SUMS if c in df.columns]
    kept = [c for c in ROLLUP_FIRSTS if c in df.columns]
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("_lines"))
    if not kept:
        return totals.drop("_lines")
    order = [tie] if tie else [c for c in df.columns if c not in keys]
    places = [order.index(c) for c in kept if c in order]
    if places and not tie:
        # the first line by a prefix of the order that ends at an attribute has that attribute's value
        order = order[: max(places) + 1]
        df = df.select(*keys, *order).distinct()
    have = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in kept])
    lines = df.select(
        *keys,
        *[F.col(c).alias(f"_order{k}") for k, c in enumerate(order)],
        F.inline(F.filter(have, lambda x: x["value"].isNotNull())).alias("_name", "_value"),
    )
    line = Window.partitionBy(*keys, "_name").orderBy(*[F.col(f"_order{k}").asc_nulls_last() for k in range(len(order))])
    first = lines.withColumn("_rank", F.row_number().over(line)).where("_rank = 1")
    # at most one entry an attribute
    found = first.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(
        F.map_from_entries(F.collect_list(F.struct("_name", "_value"))).alias("_found")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    types = dict(df.dtypes)
    attributes = [F.col("_found").getItem(c).cast(types[c]).alias(c) for c in kept]
    return totals.join(found, same, "left").select(*keys, *sums, *attributes)


def vintage_max(df: DataFrame) -> DataFrame:
    return df.groupBy("TICKER", "OBSERVATION_DATE").agg(F.max("REALTIME_START").alias("MAX_REALTIME_START"))


def distinct_keys(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """Distinct normalised identifiers without missing marks, with the order they first appear in."""
    from tickloom.functions.text import NULL_TOKENS

    key = normalized(column)
    present = df.where(F.col(column).isNotNull() & ~F.lower(F.trim(column)).isin(NULL_TOKENS))
    first = F.min(order) if order else F.min(key)
    return present.groupBy(key.alias(column)).agg(first.alias("FIRST_SEEN"))


def missing_requested(df: DataFrame, column: str, requested: Sequence[str]) -> DataFrame:
    """Requested identifiers without any row."""
    wanted = df.sparkSession.createDataFrame([(r.strip().upper(),) for r in dict.fromkeys(requested)], f"`{column}` string")
    return wanted.distinct().join(df.select(normalized(column).alias(column)).distinct(), column, "left_anti")


def last_per_cell(df: DataFrame, index: str, columns: str, values: str, order: str) -> DataFrame:
    """The last value of each (row, column) cell that is not null, long; a cell without any stays null."""
    known = F.when(F.col(values).isNotNull(), F.col(order))
    return df.groupBy(index, columns).agg(F.max_by(values, known).alias(values))


def pivot_last(df: DataFrame, index: str, columns: str, values: str, order: str, names: Sequence[str]) -> DataFrame:
    """Wide panel of the named columns, the last value by ``order`` in each cell."""
    cells = last_per_cell(df, index, columns, values, order)
    return cells.groupBy(index).agg(*[F.max(F.when(F.col(columns) == n, F.col(values))).alias(n) for n in names])


def unpivot(df: DataFrame, ids: Sequence[str], variable: str = "asset", value: str = "value") -> DataFrame:
    """Wide to long; empty cells stay as null rows."""
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], variable, value)


def sector_weights(weights: DataFrame, sectors: DataFrame) -> DataFrame:
    """Summed weight per (date, sector), zero where a sector is absent on a date."""
    by_sector = weights.join(sectors, "asset").where(F.col("sector").isNotNull())
    sums = by_sector.groupBy("date", "sector").agg(F.sum("weight").alias("weight"))
    every = weights.select("date").distinct()
    names = sectors.where(F.col("sector").isNotNull()).select("sector").distinct()
    # one row with the sector names (a classification has a few dozen) rides along with each date
    listed = with_scalars(every, names.agg(F.sort_array(F.collect_set("sector")).alias("_s")))
    grid = listed.select("date", F.explode("_s").alias("sector"))
    return grid.join(sums, ["date", "sector"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def value_counts(flags: DataFrame, key: str = "asset", flag: str = "flag") -> DataFrame:
    return flags.groupBy(key).agg(
        F.count_if(F.col(flag)).alias("true_count"), F.count_if(~F.col(flag)).alias("false_count")
    )


def persistence_topn(flags: DataFrame, n: int = 50) -> DataFrame:
    """The n names selected most often; equal counts in name order."""
    counts = flags.groupBy("asset").agg(F.count_if(F.col("flag")).alias("days"))
    return counts.orderBy(F.col("days").desc(), "asset").limit(n)


def hit_rate(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count and share of positive values."""
    positive = F.col(value) > 0
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count_if(positive).alias("positive"), F.avg(positive.cast("double")).alias("share")
    )
