"""Long price panels: (date, asset, value), one row per cell.

Every window runs over one asset's dates and is therefore bounded by the length
of the calendar; assets spread over the cluster.  Missing cells are simply
absent: gaps are filled by stretching a row over the positions up to the next
one, never by multiplying dates with assets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.calendar import bounds
from tickloom.operators.support import finite


def _by_pos():
    return Window.partitionBy("asset").orderBy("pos")


def placed(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Panel rows with their calendar position; rows off the calendar drop out."""
    return panel.join(calendar.select("date", "pos", "last"), "date")


def _stretch(rows: DataFrame, first: Column, final: Column, calendar: DataFrame, value: Column) -> DataFrame:
    spread = rows.withColumn("_first", first).withColumn("_final", final)
    spread = spread.select("asset", "pos", "value", F.explode(F.sequence("_first", "_final")).alias("_at"))
    at = calendar.select(F.col("pos").alias("_at"), "date")
    return spread.withColumn("value", value).join(at, "_at").select("date", "asset", "value", F.col("_at").alias("pos"))


def densify(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every (calendar date, asset) cell; missing ones are null.  Carries ``pos``."""
    rows = placed(panel, calendar)
    first = F.when(F.lag("pos").over(_by_pos()).isNull(), F.lit(0)).otherwise(F.col("pos"))
    final = F.coalesce(F.lead("pos").over(_by_pos()) - 1, F.col("last"))
    own = F.when(F.col("_at") == F.col("pos"), F.col("value"))
    return _stretch(rows, first, final, calendar, own)


def fill_gaps(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Carry values over inner gaps, and over a trailing gap of exactly one date.

    Cells that stay empty are absent from the result.
    """
    rows = placed(panel.where(F.col("value").isNotNull()), calendar)
    trailing = F.when(F.col("last") - F.col("pos") == 1, F.col("last")).otherwise(F.col("pos"))
    final = F.coalesce(F.lead("pos").over(_by_pos()) - 1, trailing)
    return _stretch(rows, F.col("pos"), final, calendar, F.col("value"))


def ffill_bfill(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Carry values forward, then the first one backward, over the whole calendar."""
    rows = placed(panel.where(F.col("value").isNotNull()), calendar)
    first = F.when(F.lag("pos").over(_by_pos()).isNull(), F.lit(0)).otherwise(F.col("pos"))
    final = F.coalesce(F.lead("pos").over(_by_pos()) - 1, F.col("last"))
    return _stretch(rows, first, final, calendar, F.col("value"))


def fill_isolated(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Copy the previous date's rows onto a date without any value between two that have some."""
    present = panel.where(F.col("value").isNotNull())
    counted = calendar.join(present.select("date").distinct().withColumn("_has", F.lit(True)), "date", "left")
    line = Window.orderBy("pos")
    state = counted.select(
        "date",
        F.col("_has").isNull().alias("_empty"),
        F.lag("_has").over(line).alias("_before"),
        F.lead("_has").over(line).alias("_after"),
        F.lag("date").over(line).alias("_prev"),
    )
    isolated = state.where(F.col("_empty") & F.col("_before") & F.col("_after"))
    targets = isolated.select(F.col("date").alias("_to"), F.col("_prev").alias("date"))
    copies = present.join(targets, "date").withColumn("date", F.col("_to")).select(*panel.columns)
    return present.unionByName(copies)


def info_panel(info: DataFrame, column: str, calendar: DataFrame, order: str) -> DataFrame:
    """A company attribute on every trading date.

    The last value per (date, asset), load dates off the calendar dropped, then
    filled forward and backward.
    """
    cells = info.groupBy("date", "asset").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("value"))
    return ffill_bfill(cells, calendar).drop("pos")


def returns(panel: DataFrame, calendar: DataFrame, k: int = 1) -> DataFrame:
    """Change over k calendar rows: null where either end is missing, no implicit fill."""
    rows = placed(panel, calendar)
    back = Window.partitionBy("asset").orderBy("pos").rangeBetween(-k, -k)
    before = F.first("value").over(back) if k != 1 else F.when(
        F.lag("pos").over(_by_pos()) == F.col("pos") - 1, F.lag("value").over(_by_pos())
    )
    change = F.when(before != 0, F.col("value") / F.when(before != 0, before) - 1)
    return rows.withColumn("value", finite(change)).select("date", "asset", "value", "pos")


def log_returns(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    return returns(panel, calendar).withColumn("value", F.log1p("value"))


def rebase(panel: DataFrame, calendar: DataFrame, start=None) -> DataFrame:
    """Growth of 100 per asset: the product of (1 + return), missing returns counting as none."""
    rows = placed(panel.where(F.col("value").isNotNull()), calendar)
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(str(start)).cast("date"))
    before = F.when(F.lag("pos").over(_by_pos()) == F.col("pos") - 1, F.lag("value").over(_by_pos()))
    growth = F.when(before != 0, F.col("value") / F.when(before != 0, before))
    stepped = rows.withColumn("_g", F.coalesce(finite(growth), F.lit(1.0)))
    running = _by_pos().rowsBetween(Window.unboundedPreceding, 0)
    return stepped.withColumn("value", 100.0 * F.product("_g").over(running)).select("date", "asset", "value")


def load_range(panel: DataFrame, start, end=None) -> DataFrame:
    """Rows of the run plus one year before it."""
    low = F.add_months(F.lit(str(start)).cast("date"), -12)
    out = panel.where(F.col("date") >= low)
    return out if end is None else out.where(F.col("date") <= F.lit(str(end)).cast("date"))


def delisted(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Last date with a value, for the assets without one on the final date."""
    seen = panel.where(F.col("value").isNotNull()).groupBy("asset").agg(F.max("date").alias("last_valid_date"))
    return seen.where(~F.col("last_valid_date").eqNullSafe(bounds(calendar)[1])).select("asset", "last_valid_date")


def membership(weights: DataFrame, calendar: DataFrame) -> DataFrame:
    """Whether an asset is held on each calendar date."""
    cells = densify(weights.select("date", "asset", F.col("weight").alias("value")), calendar)
    return cells.select("date", "asset", F.coalesce(F.col("value") > 0, F.lit(False)).alias("held"))


def shift(panel: DataFrame, calendar: DataFrame, n: int = 1) -> DataFrame:
    """Values moved n calendar rows ahead."""
    moved = placed(panel, calendar).select("asset", "value", (F.col("pos") + n).alias("pos"))
    return moved.join(calendar.select("date", "pos"), "pos").select("date", "asset", "value")


# ------------------------------------------------------------------ single series
def _by_time():
    return Window.partitionBy("series").orderBy("ts")


PERIOD_UNITS = {"day": "day", "month": "month", "quarter": "quarter", "year": "year"}


def resample_last(series: DataFrame, unit: str) -> DataFrame:
    """Last price of every non-empty period, stamped with the period's start."""
    period = F.date_trunc(PERIOD_UNITS[unit], F.col("ts")).cast("date")
    return (
        series.where(F.col("price").isNotNull())
        .groupBy("series", period.alias("period"))
        .agg(F.max("ts").alias("ts"), F.max_by("price", "ts").alias("price"))
    )


def drawdown(series: DataFrame) -> DataFrame:
    """Distance of the price from its running peak.

    The peak is that of the earlier days or of the day so far, so a window holds
    one day of a series (or its list of days), however long the series is.
    """
    day = F.col("ts").cast("date")
    rows = series.withColumn("_day", day)
    days = rows.groupBy("series", "_day").agg(F.max("price").alias("_top"))
    earlier = Window.partitionBy("series").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("series", "_day", F.max("_top").over(earlier).alias("_earlier"))
    so_far = Window.partitionBy("series", "_day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    peaked = rows.withColumn("_now", F.max("price").over(so_far)).join(days, ["series", "_day"])
    peak = F.greatest("_earlier", "_now")
    return peaked.withColumn("drawdown", F.col("price") / peak - 1).select(*series.columns, "drawdown")


def dd_duration(series: DataFrame) -> DataFrame:
    """Longest run of consecutive days below the running peak, per daily series."""
    peak = F.max("price").over(_by_time().rowsBetween(Window.unboundedPreceding, 0))
    under = series.withColumn("_under", F.col("price") < peak)
    island = F.sum((~F.col("_under")).cast("int")).over(_by_time().rowsBetween(Window.unboundedPreceding, 0))
    runs = under.withColumn("_run", island).groupBy("series", "_run").agg(F.count_if(F.col("_under")).alias("_n"))
    return runs.groupBy("series").agg(F.max("_n").alias("max_drawdown_duration"))


def period_rf(rate: float, periods: float) -> float:
    """An annual rate per period."""
    return (1 + rate) ** (1 / periods) - 1


def rf_returns(series: DataFrame, rf: DataFrame) -> DataFrame:
    """Risk-free return on the dates of each series: the change of the rate index, zero where unknown."""
    before = F.lag("price").over(Window.orderBy("ts"))
    changes = rf.select("ts", F.when(before != 0, F.col("price") / F.when(before != 0, before) - 1).alias("rf"))
    return series.join(changes, "ts", "left").withColumn("rf", F.coalesce("rf", F.lit(0.0)))
