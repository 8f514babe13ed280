"""Cross-sectional factors: (date, asset, factor) for every requested date at once."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.calendar import (
    Offset, as_of, on_calendar, window_bridge, window_edges, window_ends, window_range_join, window_sums,
)
from tickloom.operators.estimators import QUARTER
from tickloom.operators.support import exact_quantiles, finite, with_group_totals


def _window(panel, calendar, dates, lookback, lag) -> DataFrame:
    known = panel.withColumn("value", finite(F.col("value"))).where(F.col("value").isNotNull())
    rows = window_range_join(known, window_bridge(calendar, dates, lookback, lag))
    return rows.select(F.col("now"), "asset", "wpos", "wlen", "value")


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("now").alias("date"), "asset", "factor")


def total_return(
    panel: DataFrame,
    calendar: DataFrame,
    dates: DataFrame,
    lookback: Offset = QUARTER,
    lag: Offset = Offset(),
    standardized: bool = False,
) -> DataFrame:
    """Last over first price of the window, less one; a first price of zero gives null."""
    ends = window_ends(on_calendar(panel, calendar), window_edges(calendar, dates, lookback, lag))
    out = _named(ends.withColumn("factor", F.try_divide("last", "first") - 1))
    return standardize(out) if standardized else out


def _with_runs(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of equal values of the asset that end with each."""
    line = Window.partitionBy("asset").orderBy("pos")
    changed = F.coalesce(F.col("value") != F.lag("value").over(line), F.lit(True)).cast("int")
    runs = rows.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(line))
    length = F.row_number().over(Window.partitionBy("asset", "_run").orderBy("pos"))
    return runs.withColumn("_equal", length).drop("_changed", "_run")


def _mean_or_equal(mean: Column) -> Column:
    """The mean of a window; of equal prices their value, which no rounding can tell from them."""
    return F.when(F.col("_equal") >= F.col("n"), F.col("value")).otherwise(mean)


def simple_moving_average(
    panel: DataFrame,
    calendar: DataFrame,
    dates: DataFrame,
    lookback: Offset = QUARTER,
    measure: str = "mean",
    lag: Offset = Offset(),
) -> DataFrame:
    """Mean or median price of the window; means by running sums."""
    if measure not in ("mean", "median"):
        raise ValueError("measure must be mean or median")
    if measure == "median":
        rows = _window(panel, calendar, dates, lookback, lag)
        return _named(rows.groupBy("now", "asset").agg(F.percentile("value", 0.5).alias("factor")))
    rows = _with_runs(on_calendar(panel, calendar))
    sums = window_sums(rows, window_edges(calendar, dates, lookback, lag), None, ["value", "_equal"], n=F.lit(1), total=F.col("value"))
    return _named(sums.where("n > 0").withColumn("factor", _mean_or_equal(F.col("total") / F.col("n"))))


def kernel_moving_average(
    panel: DataFrame,
    calendar: DataFrame,
    dates: DataFrame,
    lookback: Offset = QUARTER,
    k: float = 1.0,
    lag: Offset = Offset(),
) -> DataFrame:
    """Mean price weighted by recency ** k, recency counting the window's dates from 1.

    For k of 0, 1 or 2 the weights are polynomials of the position, and running
    sums of its powers give every window; other powers read the windows' rows.
    """
    if k not in (0, 1, 2):
        weight = F.pow(F.col("wpos") + 1, F.lit(float(k)))
        rows = _window(panel, calendar, dates, lookback, lag).withColumn("_w", weight)
        return _named(rows.groupBy("now", "asset").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("factor")))
    powers = range(int(k) + 1)
    moments = {f"w{j}": F.pow(F.col("u"), F.lit(float(j))) for j in powers}
    moments |= {f"x{j}": F.pow(F.col("u"), F.lit(float(j))) * F.col("value") for j in powers}

    def weighted(kind: str) -> Column:
        # (u + s) ** k by its powers of u
        return reduce(Column.__add__, [math.comb(int(k), j) * F.pow(F.col("s"), F.lit(float(k - j))) * F.col(f"{kind}{j}") for j in powers])

    rows, edges = _with_runs(on_calendar(panel, calendar)), window_edges(calendar, dates, lookback, lag)
    results = {"n": F.col("n"), "_w": weighted("w"), "_x": weighted("x")}
    sums = window_sums(rows, edges, None, ["value", "_equal"], results, n=F.lit(1), **moments)
    return _named(sums.where("n > 0").withColumn("factor", _mean_or_equal(F.col("_x") / F.col("_w"))))


_BLOCK = 300.0  # decay of a block, in natural logarithms: what lies two blocks back weighs e^-300


def ewma(
    panel: DataFrame, calendar: DataFrame, dates: DataFrame, half_life: float, lag: Offset = Offset()
) -> DataFrame:
    """Exponential average over the full history, recursive form.

    With d = 1 - alpha and a gap of g dates the recursion is
    y = a y' + (1 - a) x, a = d^g / (d^g + alpha).  Unrolled, y is a sum of the
    values weighted by the products of the later a's; the logarithms of a are
    summed by a window, and the sums restart in blocks of bounded decay so that
    no product leaves the range of a double.
    """
    alpha = 1 - 2 ** (-1 / half_life)
    rows = panel.where(F.col("value").isNotNull()).join(calendar.select("date", "pos", "last"), "date")
    line = Window.partitionBy("asset").orderBy("pos")
    kept = F.pow(F.lit(1 - alpha), F.col("pos") - F.lag("pos").over(line))
    rows = rows.select("asset", "pos", "value", "last", (kept / (kept + alpha)).alias("_a"))
    # the first value stands for itself
    rows = rows.withColumn("_x", F.coalesce((1 - F.col("_a")) * F.col("value"), F.col("value")))
    rows = rows.withColumn("_log", F.sum(F.coalesce(F.log("_a"), F.lit(0.0))).over(line))
    rows = rows.withColumn("_block", F.floor(-F.col("_log") / _BLOCK).cast("long"))
    block = Window.partitionBy("asset", "_block").orderBy("pos")
    start = F.first("_log").over(block)
    inside = rows.withColumn("_in", F.exp(F.col("_log") - start) * F.sum(F.col("_x") * F.exp(start - F.col("_log"))).over(block))
    # the block before enters by its last value; a block may be empty where a gap spans it
    before = F.last(F.when(F.col("_ends"), F.col("_in")), True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    at = F.last(F.when(F.col("_ends"), F.col("_log")), True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    ended = inside.withColumn("_ends", F.coalesce(F.lead("_block").over(line) != F.col("_block"), F.lit(False)))
    carried = ended.withColumn("_value", F.col("_in") + F.coalesce(before * F.exp(F.col("_log") - at), F.lit(0.0)))
    # between observations the average stands still: stretch it to the next one
    until = F.coalesce(F.lead("pos").over(line) - 1, F.col("last"))
    reach = carried.withColumn("_until", until)
    standing = reach.select("asset", F.col("_value").alias("value"), F.explode(F.sequence("pos", "_until")).alias("pos"))
    ends = dates.select(F.col("date").alias("now"), lag.before(F.col("date")).alias("day")).distinct()
    reached = as_of(calendar, ends).select("now", "pos")
    return standing.join(reached, "pos").select(F.col("now").alias("date"), "asset", F.col("value").alias("factor"))


def set_factor(panel: DataFrame, dates: DataFrame, standardized: bool = False) -> DataFrame:
    """A supplied panel read at the dates."""
    out = panel.join(dates.select("date").distinct(), "date", "left_semi")
    out = out.select("date", "asset", F.col("value").alias("factor"))
    return standardize(out) if standardized else out


def generic_factor(panel: DataFrame, dates: DataFrame, compute: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A user's own factor: a function of panel and dates returning (date, asset, factor)."""
    return compute(panel, dates).select("date", "asset", "factor")


def standardize(factor: DataFrame) -> DataFrame:
    """Z-score per date with the population deviation; a constant cross-section gives zeros."""
    known = factor.withColumn("factor", finite(F.col("factor")))
    sized = with_group_totals(known, ["date"], _m=F.avg("factor"), _s=F.stddev_pop("factor"))
    score = F.when(F.col("_s") > 0, (F.col("factor") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")))
    return sized.select("date", "asset", F.when(F.col("factor").isNotNull(), F.coalesce(score, F.lit(0.0))).alias("factor"))


def factor_stats(factor: DataFrame) -> DataFrame:
    """MEAN, MEDIAN, 25TH and 75TH of the finite values of each date."""
    known = factor.withColumn("factor", finite(F.col("factor"))).where(F.col("factor").isNotNull())
    quantiles = exact_quantiles(known, ["date"], "factor", "asset", {"MEDIAN": 0.5, "25TH": 0.25, "75TH": 0.75})
    return known.groupBy("date").agg(F.avg("factor").alias("MEAN")).join(quantiles, "date")


def factor_coverage(factor: DataFrame, pool: DataFrame, market_weights: DataFrame | None = None) -> DataFrame:
    """Names with a finite factor: count, share of the pool, share of its market weight."""
    rows = pool.select("date", "asset").distinct().join(factor, ["date", "asset"], "left")
    if market_weights is None:
        rows = rows.withColumn("_w", F.lit(0.0))
    else:
        rows = rows.join(market_weights.select("date", "asset", F.col("weight").alias("_w")), ["date", "asset"], "left")
    known = finite(F.col("factor")).isNotNull()
    weight = F.coalesce("_w", F.lit(0.0))
    sums = rows.groupBy("date").agg(
        F.count_if(known).alias("covered"),
        F.avg(known.cast("double")).alias("share"),
        F.sum(F.when(known, weight).otherwise(0.0)).alias("_covered_weight"),
        F.sum(weight).alias("_weight"),
    )
    by_weight = F.when(F.abs("_weight") > 1e-8, F.try_divide("_covered_weight", "_weight")).otherwise(0.0)
    return sums.select("date", "covered", "share", by_weight.alias("market_share"))
