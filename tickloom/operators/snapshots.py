"""Point-in-time reads: newest row per key, newest date per key, duplicates.

Dates reduce with `max`, which combines before the shuffle; whole rows are picked
by a ranked window whose limit runs before the shuffle as well, so a key holding
a third of the table sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], largest: bool = True) -> DataFrame:
    """One whole row per key: the one with the largest (or smallest) order tuple.

    Written as a ranked window cut at 1: the limit runs before the shuffle too,
    so every task sends one row per key, whatever its columns are.
    """
    ranks = [c.desc_nulls_last() if largest else c.asc_nulls_first() for c in order]
    rank = F.row_number().over(Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*ranks))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_row(df: DataFrame, keys: Sequence[str], date: str = "DATE", ties: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key; ``ties`` decide among equal dates, larger first."""
    return pick_row(df, keys, [F.col(date), *[F.col(t) for t in ties]])


def latest_date_rows(df: DataFrame, keys: Sequence[str], date: str = "DATE") -> DataFrame:
    """Every row on the newest date of its key (null keys drop out)."""
    keys = list(keys)
    newest = df.groupBy(*keys).agg(F.max(date).alias(date))
    return df.join(newest, [*keys, date], "left_semi").select(*df.columns)


def last_snapshot(df: DataFrame, date: str = "DATE", weight: str = "WEIGHT", ties: Sequence[str] = ()) -> DataFrame:
    """Rows on the newest date of the whole table, heaviest first."""
    newest = df.agg(F.max(date).alias(date))
    return df.join(newest, date, "left_semi").orderBy(F.col(weight).desc(), *ties)


def dedup_rownum(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key set, the smallest by ``order`` (all columns by default)."""
    ordering = order or [c for c in df.columns if c not in set(keys)]
    return pick_row(df, keys, [F.col(c) for c in ordering], largest=False)


def dedupe_master(df: DataFrame, us: Column, ties: Sequence[str] = ("FIGI",)) -> DataFrame:
    """One master row per (TICKER, NAME): US first, then the oldest date, no date last."""
    order = [(~F.coalesce(us, F.lit(False))).cast("int"), F.col("DATE").isNull().cast("int"), F.col("DATE")]
    return pick_row(df, ["TICKER", "NAME"], [*order, *[F.col(t) for t in ties]], largest=False)


def keep_last_per_key(df: DataFrame, keys: Sequence[str], ingest_order: str) -> DataFrame:
    """The last pulled row of each key."""
    return pick_row(df, keys, [F.col(ingest_order)])


def max_date_per_key(df: DataFrame, key: str = "FIGI", date: str = "DATE") -> DataFrame:
    return df.groupBy(key).agg(F.max(date).alias("MAX_DATE"))
