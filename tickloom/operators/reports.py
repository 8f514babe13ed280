"""The tables behind the report figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import aggregates
from tickloom.operators.support import with_group_totals, with_scalars


def display_names(mapping: DataFrame, reverse: DataFrame) -> DataFrame:
    """Label of each FIGI: its ticker where that leads back to it, else "ticker (figi)"."""
    back = reverse.select("TICKER", F.col("FIGI").alias("_own"))
    label = F.when(F.col("TICKER").isNull(), F.col("FIGI")).when(F.col("_own") == F.col("FIGI"), F.col("TICKER"))
    spelled = F.concat(F.col("TICKER"), F.lit(" ("), F.col("FIGI"), F.lit(")"))
    return mapping.join(back, "TICKER", "left").select("FIGI", F.coalesce(label, spelled).alias("NAME"))


def _labelled(frame: DataFrame, names: DataFrame | None) -> DataFrame:
    if names is None:
        return frame.withColumn("name", F.col("asset"))
    labels = names.select(F.col("FIGI").alias("asset"), F.col("NAME").alias("name"))
    return frame.join(labels, "asset", "left").withColumn("name", F.coalesce("name", "asset"))


def rpt_current_weights(weights: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Non-zero weights of the last date, heaviest first."""
    last = weights.agg(F.max("date").alias("_last"))
    rows = with_scalars(weights, last).where((F.col("date") == F.col("_last")) & (F.abs("weight") >= 1e-12))
    return _labelled(rows, names).select("name", "weight").orderBy(F.col("weight").desc(), "name")


def rpt_security_weights(weights: DataFrame, names: DataFrame | None = None) -> DataFrame:
    return _labelled(weights, names).select("date", "name", "weight")


def rpt_sector_weights(weights: DataFrame, sectors: DataFrame) -> DataFrame:
    return aggregates.sector_weights(weights, sectors)


def rpt_signal_state_counts(flags: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Days on and off per asset."""
    return _labelled(aggregates.value_counts(flags), names).select("name", "true_count", "false_count")


def rpt_signal_selection_counts(flags: DataFrame, names: DataFrame | None = None, top_n: int = 50) -> DataFrame:
    """The names selected on most days."""
    return _labelled(aggregates.persistence_topn(flags, top_n), names).select("name", "days")


def rpt_prices(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Strategy and benchmark values side by side, on every date of either."""
    left = strategy.select("date", F.col("value").alias("strategy"))
    return left.join(benchmark.select("date", F.col("value").alias("benchmark")), "date", "full")


def histogram(
    df: DataFrame, columns: Sequence[str], bins: int, histnorm: str | None = None, cumulative: bool = False
) -> DataFrame:
    """Counts of each column over equal bins between its ends: (column, bin, low, high, value).

    ``histnorm`` "probability" divides by the number of values; ``cumulative`` sums up the bins.
    """
    if histnorm not in (None, "probability"):
        raise ValueError("histnorm must be None or probability")
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "column", "_x")
    sized = with_group_totals(
        long.where(F.col("_x").isNotNull()), ["column"], _lo=F.min("_x"), _hi=F.max("_x"), _n=F.count(F.lit(1))
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.floor((F.col("_x") - F.col("_lo")) / F.when(width > 0, width))).otherwise(0)
    placed = sized.withColumn("bin", F.least(at, F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy("column", "bin").agg(
        F.count(F.lit(1)).cast("double").alias("value"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_n").alias("_n")
    )
    step = (F.col("_hi") - F.col("_lo")) / bins
    out = counts.withColumn("low", F.col("_lo") + F.col("bin") * step).withColumn("high", F.col("_lo") + (F.col("bin") + 1) * step)
    if histnorm == "probability":
        out = out.withColumn("value", F.col("value") / F.col("_n"))
    if cumulative:
        # one row per bin of a column
        upto = Window.partitionBy("column").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("value", F.sum("value").over(upto))
    return out.select("column", "bin", "low", "high", "value")
