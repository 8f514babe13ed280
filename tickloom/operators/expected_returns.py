"""Expected returns: (date, asset, expected_return), all dates in one job.

Each estimator is one grouped aggregate over window returns.  A group is one
asset's window, so exact percentiles and short arrays are bounded by its length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.calendar import Offset, decayed_sums, on_calendar, window_edges, window_sums
from tickloom.operators.estimators import QUARTER, TEN_YEARS, change_panel, history, of_pool, renumber

# fixed values: half-lives averaged by the blended estimate
BLEND_HALFLIVES = [10, 21, 63, 125, 250]


def decay_of(alpha: float | None = None, halflife: float | None = None) -> float:
    """Per-row weight decay of an exponential mean."""
    if (alpha is None) == (halflife is None):
        raise ValueError("give alpha or halflife")
    return 1 - alpha if alpha is not None else 0.5 ** (1 / halflife)


def _estimate(rows: DataFrame, pool: DataFrame, value: Column) -> DataFrame:
    # the pool first: windows of other names are not aggregated
    out = of_pool(rows, pool).groupBy("now", "asset").agg(value.alias("expected_return"))
    return out.select(F.col("now").alias("date"), "asset", "expected_return")


def _mean_return(panel, calendar, pool, lookback, lag, lookforward=None, log=False, benchmark=None) -> DataFrame:
    """Mean of the returns inside every window, by running sums; the window's first date has none."""
    edges = window_edges(calendar, pool, lookback, lag, lookforward).withColumn("a", F.col("a") + 1)
    rows = on_calendar(change_panel(panel, calendar, log, benchmark), calendar)
    sums = window_sums(rows, edges, pool, n=F.lit(1), total=F.col("value")).where("n > 0")
    return sums.select(F.col("now").alias("date"), "asset", (F.col("total") / F.col("n")).alias("expected_return"))


def er_mean(panel, calendar, pool, lookback: Offset = QUARTER, lag: Offset = Offset(), **window) -> DataFrame:
    return _mean_return(panel, calendar, pool, lookback, lag, **window)


def er_log_mean(panel, calendar, pool, lookback: Offset = QUARTER, lag: Offset = Offset(), **window) -> DataFrame:
    return _mean_return(panel, calendar, pool, lookback, lag, log=True, **window)


def er_median(panel, calendar, pool, lookback: Offset = QUARTER, lag: Offset = Offset(), **window) -> DataFrame:
    return _estimate(history(panel, calendar, pool, lookback, lag, **window), pool, F.percentile("value", 0.5))


def _decayed_mean(panel, calendar, pool, lookback, lag, decay, lookforward=None, log=False, benchmark=None) -> DataFrame:
    """Mean of the returns inside every window, weighted by decay ** (dates up to its end)."""
    if not 0 < decay < 1:
        rows = history(panel, calendar, pool, lookback, lag, lookforward, log, benchmark)
        return _estimate(rows, pool, _ew_mean(decay))
    edges = window_edges(calendar, pool, lookback, lag, lookforward).withColumn("a", F.col("a") + 1)
    rows = on_calendar(change_panel(panel, calendar, log, benchmark), calendar)
    sums = decayed_sums(rows, edges, decay, pool, weight=F.lit(1.0), total=F.col("value")).where("n > 0")
    return sums.select(F.col("now").alias("date"), "asset", (F.col("total") / F.col("weight")).alias("expected_return"))


def _ew_mean(decay: float) -> Column:
    weight = F.pow(F.lit(decay), F.col("rlen") - 1 - F.col("rpos"))
    return F.sum(weight * F.col("value")) / F.sum(weight)


def er_ewma(
    panel, calendar, pool, lookback: Offset = TEN_YEARS, lag: Offset = Offset(), alpha=None, halflife=None, **window
) -> DataFrame:
    """Exponentially weighted mean by running sums; positions count every row of the window."""
    return _decayed_mean(panel, calendar, pool, lookback, lag, decay_of(alpha, halflife), **window)


def er_blended(
    panel,
    calendar,
    pool,
    lookback: Offset = TEN_YEARS,
    lag: Offset = Offset(),
    halflives: Sequence[float] = BLEND_HALFLIVES,
    use_log_returns: bool = True,
    **window,
) -> DataFrame:
    """Mean of exponential means; with log returns, rows where the whole pool is empty do not count."""
    rows = history(panel, calendar, pool, lookback, lag, log=use_log_returns, **window)
    if use_log_returns:
        rows = of_pool(rows, pool)
        rows = renumber(rows, rows.select("now", "rpos").distinct())
    means = [_ew_mean(decay_of(halflife=h)) for h in halflives]
    total = means[0]
    for mean in means[1:]:
        total = total + mean
    return _estimate(rows, pool, total / len(means))


def _quantile_edges(trim: float) -> Column:
    if not 0 <= trim < 0.5:
        raise ValueError("trim_fraction must be in [0, 0.5)")
    return F.percentile("value", [trim, 1 - trim])


def _within_edges(rows: DataFrame, pool: DataFrame, trim: float, mean: Callable[[Column, Column, Column], Column]) -> DataFrame:
    # the pool first: windows of other names are not gathered
    grouped = of_pool(rows, pool).groupBy("now", "asset").agg(_quantile_edges(trim).alias("_q"), F.collect_list("value").alias("_v"))
    low, high = F.col("_q")[0], F.col("_q")[1]
    out = grouped.select(
        F.col("now").alias("date"), "asset", mean(F.col("_v"), low, high).alias("expected_return")
    )
    return out


def _mean_of(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))


def er_trimmed(
    panel, calendar, pool, lookback: Offset = QUARTER, lag: Offset = Offset(), trim_fraction: float = 0.1, **window
) -> DataFrame:
    """Mean of the returns between the two quantiles, edges included."""
    rows = history(panel, calendar, pool, lookback, lag, **window)
    return _within_edges(
        rows, pool, trim_fraction, lambda v, lo, hi: _mean_of(F.filter(v, lambda x: (x >= lo) & (x <= hi)))
    )


def er_winsorized(
    panel, calendar, pool, lookback: Offset = QUARTER, lag: Offset = Offset(), trim_fraction: float = 0.1, **window
) -> DataFrame:
    """Mean of the returns clipped to the two quantiles."""
    rows = history(panel, calendar, pool, lookback, lag, **window)
    return _within_edges(
        rows, pool, trim_fraction, lambda v, lo, hi: _mean_of(F.transform(v, lambda x: F.least(F.greatest(x, lo), hi)))
    )


def er_excess(panel, calendar, pool, benchmark: DataFrame, estimator=er_mean, **parameters) -> DataFrame:
    """An estimator over returns less the benchmark's; ``benchmark`` is (date, benchmark)."""
    return estimator(panel, calendar, pool, benchmark=benchmark, **parameters)


def er_realized(panel, calendar, pool, lookforward: Offset, estimator=er_mean, **parameters) -> DataFrame:
    """An estimator over a window that reaches past the date; for evaluation only."""
    return estimator(panel, calendar, pool, lookforward=lookforward, **parameters)
