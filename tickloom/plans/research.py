"""A research run as a chain of transforms: gate, select, rank, weight, value, measure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import accounting, factors, panels, selection, stats, weights
from tickloom.operators.calendar import Offset, calendar_of
from tickloom.operators.estimators import QUARTER
from tickloom.session import cut_lineage


def signal_dates(trade_dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """(trade_date, date): the last date whose prices are visible on a trade date."""
    trades = trade_dates.join(calendar, "date").select(F.col("date").alias("trade_date"), (F.col("pos") - 1).alias("pos"))
    return trades.join(calendar.select("pos", "date"), "pos").select("trade_date", "date")


def on_trade_dates(frame: DataFrame, dates: DataFrame) -> DataFrame:
    """Move weights decided on signal dates to their trade dates."""
    return frame.join(dates, "date").drop("date").withColumnRenamed("trade_date", "date").select("date", "asset", "weight")


def momentum_schedule(
    prices: DataFrame,
    calendar: DataFrame,
    gate: Callable[[DataFrame], DataFrame],
    top: int = 5,
    lookback: Offset = QUARTER,
) -> DataFrame:
    """Equal weights in the names with the best trailing return, on the gate's dates."""
    dates = signal_dates(gate(calendar), calendar)
    pool = selection.select_all(prices, dates)
    metric = factors.total_return(prices, calendar, dates, lookback).withColumn("factor", F.round("factor", 9))
    return on_trade_dates(weights.w_equal(selection.select_n(metric, pool, top)), dates)


def run(
    prices: DataFrame,
    schedule: Callable[[DataFrame, DataFrame], DataFrame],
    initial_capital: float = 1e6,
    name: str = "strategy",
) -> tuple[DataFrame, DataFrame]:
    """Value line and statistics of a schedule builder on a price panel."""
    # panel, schedule and value line are each read several times: written once, not recomputed
    prices = cut_lineage(prices)
    calendar = calendar_of(prices)
    filled = cut_lineage(panels.ffill_bfill(prices, calendar).drop("pos"))
    plan = cut_lineage(schedule(filled, calendar))
    # the name is written with the line: as a literal it would leave the statistics' joins without a key
    named = cut_lineage(accounting.nav(filled, calendar, plan, initial_capital).withColumn("series", F.lit(name)))
    series = named.select("series", F.col("date").alias("ts"), F.col("index").alias("price"))
    return named.drop("series"), stats.perf_stats(series)
