"""Boolean signals: (date, asset, flag)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import factors
from tickloom.operators.calendar import Offset, as_of, bounds
from tickloom.operators.estimators import QUARTER
from tickloom.operators.panels import densify


def asof_last_price(panel: DataFrame, calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """The prices of the last trading date up to each date; no fill per asset."""
    days = dates.select(F.col("date").alias("now"), F.col("date").alias("day")).distinct()
    last = as_of(calendar, days).select("now", "date")
    return panel.where(F.col("value").isNotNull()).join(last, "date").select("now", "asset", "value")


def moving_average(
    panel, calendar, dates, ma_type="simple", lookback=QUARTER, measure="mean", lag=Offset(), half_life=None
) -> DataFrame:
    if ma_type == "simple":
        return factors.simple_moving_average(panel, calendar, dates, lookback, measure, lag)
    if ma_type == "exponential":
        return factors.ewma(panel, calendar, dates, half_life, lag)
    raise ValueError("ma_type must be simple or exponential")


def price_crossover(panel: DataFrame, calendar: DataFrame, dates: DataFrame, **average) -> DataFrame:
    """Last price above its moving average."""
    price = asof_last_price(panel, calendar, dates).select(F.col("now").alias("date"), "asset", F.col("value").alias("_p"))
    mean = moving_average(panel, calendar, dates, **average)
    return price.join(mean, ["date", "asset"], "left").select(
        "date", "asset", F.coalesce(F.col("_p") > F.col("factor"), F.lit(False)).alias("flag")
    )


def dual_ma_crossover(panel: DataFrame, calendar: DataFrame, dates: DataFrame, short: dict, long: dict) -> DataFrame:
    """Short moving average above the long one."""
    fast = moving_average(panel, calendar, dates, **short).withColumnRenamed("factor", "_s")
    slow = moving_average(panel, calendar, dates, **long).withColumnRenamed("factor", "_l")
    return fast.join(slow, ["date", "asset"], "full").select(
        "date", "asset", F.coalesce(F.col("_s") > F.col("_l"), F.lit(False)).alias("flag")
    )


def momentum(
    panel: DataFrame,
    calendar: DataFrame,
    dates: DataFrame,
    ranker: Callable[[DataFrame], DataFrame],
    lookback: Offset = QUARTER,
    lag: Offset = Offset(),
) -> DataFrame:
    """Names a ranking picks by their total return."""
    return ranker(factors.total_return(panel, calendar, dates, lookback, lag))


def signal_history(selected: DataFrame, calendar: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Selected or not, on every date for every name ever selected or in the universe."""
    marks = selected.select("date", "asset").distinct().withColumn("value", F.lit(1.0))
    if universe is not None:
        # one empty cell per name puts it on the grid
        seeds = universe.select(bounds(calendar)[0].alias("date"), "asset").distinct()
        marks = marks.unionByName(seeds.withColumn("value", F.lit(None).cast("double"))).groupBy("date", "asset").agg(F.max("value").alias("value"))
    return densify(marks, calendar).select("date", "asset", F.col("value").isNotNull().alias("flag"))
