"""Performance statistics of price series (series, ts, price): one row per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.panels import rf_returns
from tickloom.operators.support import finite

# fixed values: seconds in a year, tolerance of "zero"
YEAR_SECONDS = 31_557_600
ZERO = 1e-8

STATISTICS = [
    "start", "end", "total_return", "incep", "cagr", "mtd", "qtd", "3m", "6m", "ytd", "1y", "3y", "5y", "10y",
    "max_drawdown", "max_drawdown_duration", "calmar", "daily_mean_ann", "daily_vol_ann", "daily_skew", "daily_kurt",
    "var_95", "cvar_95", "hit_rate_daily", "sharpe", "sortino", "best_day", "worst_day", "best_month", "worst_month",
    "best_year", "worst_year", "avg_up_month", "avg_down_month", "pos_month_perc", "win_year_perc",
    "twelve_month_win_perc",
]
_TRAILING = {"3m": 3, "6m": 6, "1y": 12, "3y": 36, "5y": 60, "10y": 120}


def _nonzero(c: Column) -> Column:
    return F.when(F.abs(c) > ZERO, c)


def clean_series(series: DataFrame) -> DataFrame:
    """Numeric, present prices; an unnamed series is called series_1."""
    price = finite(F.col("price"))
    out = series.select(F.coalesce("series", F.lit("series_1")).alias("series"), "ts", price.alias("price"))
    return out.where(F.col("price").isNotNull() & F.col("ts").isNotNull())


def asof_offset(series: DataFrame, months: int) -> DataFrame:
    """Last price on or before the end of each series less some months."""
    end = series.groupBy("series").agg(F.max("ts").alias("_end"))
    rows = series.join(end, "series").where(F.col("ts") <= F.add_months("_end", -months))
    return rows.groupBy("series").agg(F.max_by("price", "ts").alias("price"), F.max("ts").alias("ts"))


def _days(series: DataFrame) -> DataFrame:
    """One row per series and day: the last price, the highest one, and what the day's drawdown needs.

    A price that is not negative is below the peak by the lesser of its ratios
    to the peak of the earlier days and to that of the day so far, so two minima
    of the day tell both.  Negative prices turn that round and are kept as they are.
    """
    day = F.col("ts").cast("date")
    so_far = Window.partitionBy("series", "_day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = series.withColumn("_day", day).withColumn("_now", F.max("price").over(so_far))
    return rows.groupBy("series", "_day").agg(
        F.max_by("price", "ts").alias("price"),
        F.max("price").alias("_top"),
        F.min(F.when(F.col("price") >= 0, F.col("price"))).alias("_low"),
        F.min(F.when(F.col("price") >= 0, F.try_divide("price", "_now"))).alias("_inside"),
        F.collect_list(F.when(F.col("price") < 0, F.struct("price", "_now"))).alias("_below"),
    ).withColumnRenamed("_day", "ts")


def _daily(days: DataFrame) -> DataFrame:
    """The days with the previous price of every period length, the drawdown and the lower tail on the row.

    All columns come from one partitioning by series: its days, at most a calendar.
    """
    line = Window.partitionBy("series").orderBy("ts")
    whole = Window.partitionBy("series")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    out = days.withColumns({
        "_prev": F.lag("price").over(line),
        "_next": F.lead("ts").over(line),
        "_at": F.row_number().over(line),
        "_peak": F.max("price").over(upto),
        "_earlier": F.max("_top").over(before),
        "_end": F.max("ts").over(whole),
    })
    for name, unit in (("m", "month"), ("q", "quarter"), ("y", "year")):
        closes = F.col("_next").isNull() | (F.trunc("_next", unit) != F.trunc("ts", unit))
        out = out.withColumn(f"_{name}", closes)
        out = out.withColumn(f"_{name}prev", F.last(F.when(F.col(f"_{name}"), F.col("price")), True).over(before))
    # days since the last one at the peak
    out = out.withColumn("_under", F.col("_at") - F.max(F.when(F.col("price") >= F.col("_peak"), F.col("_at"))).over(upto))
    below = F.transform("_below", lambda x: F.try_divide(x["price"], F.greatest("_earlier", x["_now"])))
    past = F.try_divide("_low", F.when(F.col("_earlier") > 0, F.col("_earlier")))
    out = out.withColumn("_depth", F.least(past, "_inside", F.array_min(below)) - 1)
    out = out.withColumn("_r", F.try_divide("price", "_prev") - 1)
    # month ends among themselves: twelve of them back is a year
    ends = Window.partitionBy("series", "_m").orderBy("ts")
    out = out.withColumn("_year_ago", F.when(F.col("_m"), F.lag("price", 12).over(ends)))
    return out.withColumn("_var", F.percentile("_r", 0.05).over(whole))


def perf_stats(series: DataFrame, rf: float | DataFrame = 0.0, ann: int = 252) -> DataFrame:
    """The statistics of every series; series with fewer than two days are left out.

    ``rf`` is an annual rate or a (ts, price) rate index.
    """
    days = _days(clean_series(series))
    if isinstance(rf, DataFrame):
        days = rf_returns(days, rf).withColumnRenamed("rf", "_rf")
    else:
        days = days.withColumn("_rf", F.lit((1 + float(rf)) ** (1 / ann) - 1))
    daily = _daily(days)
    excess = F.col("_r") - F.col("_rf")
    daily = daily.withColumn("_x", excess).withColumn("_down", F.when(excess.isNotNull(), F.least(excess, F.lit(0.0))))

    def change(flag: str) -> Column:
        known = F.col(f"_{flag}") & (F.col(f"_{flag}prev") != 0)
        return F.when(known, F.col("price") / F.when(F.col(f"_{flag}prev") != 0, F.col(f"_{flag}prev")) - 1)

    r, monthly, yearly = F.col("_r"), change("m"), change("y")
    last_row = F.col("ts") == F.col("_end")

    def to_date(flag: str) -> Column:
        return F.max(F.when(last_row, F.col(f"_{flag}prev")))

    grouped = daily.groupBy("series").agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.min_by("price", "ts").alias("_first"),
        F.max_by("price", "ts").alias("_last"),
        F.count(F.lit(1)).alias("_days"),
        F.bool_or(F.col("price") < 0).alias("_negative"),
        *[
            F.max_by("price", F.when(F.col("ts") <= F.add_months("_end", -months), F.col("ts"))).alias(f"_a{name}")
            for name, months in _TRAILING.items()
        ],
        to_date("m").alias("_am"),
        to_date("q").alias("_aq"),
        to_date("y").alias("_ay"),
        F.count(r).alias("_n"),
        F.avg(r).alias("_mean"),
        F.stddev_samp(r).alias("_sd"),
        F.skewness(r).alias("_g1"),
        F.kurtosis(r).alias("_g2"),
        F.first("_var").alias("var_95"),
        F.avg(F.when(r <= F.col("_var"), r)).alias("cvar_95"),
        F.avg((r > 0).cast("double")).alias("hit_rate_daily"),
        F.avg("_x").alias("_xm"),
        F.stddev_samp("_x").alias("_xs"),
        F.stddev_samp("_down").alias("_ds"),
        F.max(r).alias("best_day"),
        F.min(r).alias("worst_day"),
        F.max(monthly).alias("best_month"),
        F.min(monthly).alias("worst_month"),
        F.max(yearly).alias("best_year"),
        F.min(yearly).alias("worst_year"),
        F.avg(F.when(monthly > 0, monthly)).alias("avg_up_month"),
        F.avg(F.when(monthly <= 0, monthly)).alias("avg_down_month"),
        F.avg((monthly > 0).cast("double")).alias("pos_month_perc"),
        F.avg((yearly > 0).cast("double")).alias("win_year_perc"),
        F.min("_depth").alias("max_drawdown"),
        F.max("_under").cast("long").alias("max_drawdown_duration"),
        F.avg((F.try_divide("price", "_year_ago") - 1 > 0).cast("double")).alias("twelve_month_win_perc"),
    ).where(F.col("_days") >= 2)

    years = F.datediff("end", "start") * (86_400 / YEAR_SECONDS)
    growth = F.try_divide("_last", "_first")
    cagr = F.when(F.col("_negative"), 0.0).when(
        (F.col("_first") > 0) & (years > 0), F.pow(growth, F.lit(1.0) / F.when(years > 0, years)) - 1
    )
    n = F.col("_n").cast("double")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2) * F.col("_g1"))
    kurt = F.when(
        n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)
    )
    scale = float(ann) ** 0.5

    out = grouped.withColumns({
        "total_return": growth - 1,
        "cagr": cagr,
        "daily_mean_ann": F.col("_mean") * ann,
        "daily_vol_ann": F.col("_sd") * scale,
        "daily_skew": skew,
        "daily_kurt": kurt,
        "sharpe": F.col("_xm") / _nonzero(F.col("_xs")) * scale,
        "sortino": F.col("_xm") / _nonzero(F.col("_ds")) * scale,
        **{name: F.col("_last") / _nonzero(F.col(f"_a{name}")) - 1 for name in _TRAILING},
        **{
            name: F.col("_last") / _nonzero(F.coalesce(F.col(anchor), F.col("_first"))) - 1
            for name, anchor in (("mtd", "_am"), ("qtd", "_aq"), ("ytd", "_ay"))
        },
    })
    out = out.withColumns({
        "incep": F.when(years < 1, F.col("total_return")).otherwise(F.col("cagr")),
        "calmar": F.when(F.col("_negative"), 0.0).otherwise(F.col("cagr") / F.abs(_nonzero(F.col("max_drawdown")))),
    })
    return out.select("series", *[F.col(f"`{s}`") for s in STATISTICS])


def stats_table(series: DataFrame, rf: float | DataFrame = 0.0, ann: int = 252) -> DataFrame:
    """Statistics as rows (statistic, series, value), for any number of series; dates as days since 1970."""
    wide = perf_stats(series, rf, ann)
    wide = wide.withColumns({"start": F.unix_date("start"), "end": F.unix_date("end")})
    numbers = wide.select("series", *[F.col(f"`{s}`").cast("double").alias(s) for s in STATISTICS])
    return numbers.unpivot(["series"], [F.col(f"`{s}`") for s in STATISTICS], "statistic", "value")
