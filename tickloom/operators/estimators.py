"""Return windows shared by the expected-return and covariance estimators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.calendar import Offset, window_bridge, window_range_join
from tickloom.operators.panels import returns
from tickloom.operators.support import finite

QUARTER = Offset(months=3)
TEN_YEARS = Offset(months=120)


def benchmark_relative(changes: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Returns less the benchmark's return of the date (``benchmark`` column)."""
    joined = changes.join(benchmark.select("date", "benchmark"), "date")
    return joined.withColumn("value", F.col("value") - F.col("benchmark")).drop("benchmark")


def change_panel(panel: DataFrame, calendar: DataFrame, log: bool = False, benchmark: DataFrame | None = None) -> DataFrame:
    """(date, asset, value): returns over the whole panel, less the benchmark's, as logarithms on request."""
    changes = returns(panel, calendar).select("date", "asset", "value")
    if benchmark is not None:
        changes = benchmark_relative(changes, benchmark)
    if log:
        above = F.when(F.col("value") > -1, F.col("value"))
        changes = changes.withColumn("value", finite(F.log1p(above)))
    return changes


def window_returns(
    panel: DataFrame,
    calendar: DataFrame,
    bridge: DataFrame,
    log: bool = False,
    benchmark: DataFrame | None = None,
) -> DataFrame:
    """(now, asset, rpos, rlen, value): the returns inside every window.

    Returns are taken once over the whole panel.  The first date of a window has
    no return inside it and is dropped; ``rpos`` counts the remaining calendar
    rows from 0 to ``rlen`` - 1, rows without a return included.
    """
    changes = change_panel(panel, calendar, log, benchmark)
    rows = window_range_join(changes.where(F.col("value").isNotNull()), bridge).where(F.col("wpos") > 0)
    return rows.select(
        "now", "asset", (F.col("wpos") - 1).alias("rpos"), (F.col("wlen") - 1).alias("rlen"), "value"
    )


def history(
    panel: DataFrame,
    calendar: DataFrame,
    pool: DataFrame,
    lookback: Offset,
    lag: Offset = Offset(),
    lookforward: Offset | None = None,
    log: bool = False,
    benchmark: DataFrame | None = None,
) -> DataFrame:
    """Window returns for the dates of a pool (all assets; restrict with ``of_pool``)."""
    bridge = window_bridge(calendar, pool, lookback, lag, lookforward)
    return window_returns(panel, calendar, bridge, log, benchmark)


def of_pool(df: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows of the pool's (date, asset) pairs, ``now`` being the date."""
    keys = pool.select(F.col("date").alias("now"), "asset").distinct()
    return df.join(keys, ["now", "asset"], "left_semi")


def renumber(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Restrict windows to the (now, rpos) rows of ``kept`` and count them anew."""
    per = Window.partitionBy("now")
    line = kept.select(
        "now",
        "rpos",
        (F.row_number().over(per.orderBy("rpos")) - 1).alias("_new"),
        F.count(F.lit(1)).over(per).cast("int").alias("_len"),
    )
    return rows.join(line, ["now", "rpos"]).select("now", "asset", F.col("_new").alias("rpos"), F.col("_len").alias("rlen"), "value")


def coverage_filter(rows: DataFrame, min_coverage: float = 0.8) -> DataFrame:
    """Assets with enough returns in the window, on the dates where all of them have one."""
    covered = (
        rows.groupBy("now", "asset")
        .agg((F.count("value") / F.max("rlen")).alias("_share"))
        .where(F.col("_share") >= min_coverage)
    )
    eligible = rows.join(covered, ["now", "asset"], "left_semi")
    width = covered.groupBy("now").agg(F.count(F.lit(1)).alias("_p"))
    complete = eligible.groupBy("now", "rpos").agg(F.count(F.lit(1)).alias("_p")).join(width, ["now", "_p"], "left_semi")
    return renumber(eligible, complete)
