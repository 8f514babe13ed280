"""Selections: (date, asset) pairs, for every date at once.

Equal metrics are ordered by asset name.  Cross-sections are numbered with
``ordered_prefix``, so a date that holds most of the rows is spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.calendar import Offset, on_calendar, window_edges, window_sums
from tickloom.operators.estimators import QUARTER
from tickloom.operators.filters import tradable
from tickloom.operators.support import (
    Ordering,
    apply_direction,
    exact_quantiles,
    finite,
    ordered_prefix,
    with_group_totals,
)

def select_all(panel: DataFrame, dates: DataFrame | None = None, include_no_data=False, include_negative=False) -> DataFrame:
    """Names with a usable price on the date."""
    rows = tradable(panel, include_no_data, include_negative)
    if dates is not None:
        rows = rows.join(dates.select("date").distinct(), "date", "left_semi")
    return rows.select("date", "asset")


def _tradable_pool(pool: DataFrame, panel: DataFrame, include_negative: bool = False) -> DataFrame:
    prices = tradable(panel, False, include_negative).select("date", "asset")
    return pool.select("date", "asset").join(prices, ["date", "asset"], "left_semi")


def select_has_data(panel: DataFrame, calendar: DataFrame, pool: DataFrame, lookback: Offset = QUARTER) -> DataFrame:
    """Names with a price on every date of the window and a positive one now."""
    counts = window_sums(on_calendar(panel, calendar), window_edges(calendar, pool, lookback), pool, n=F.lit(1))
    complete = counts.where(F.col("n") == F.col("b") - F.col("a") + 1).select(F.col("now").alias("date"), "asset")
    return _tradable_pool(pool.join(complete, ["date", "asset"], "left_semi"), panel)


def select_active(pool: DataFrame, inactive: DataFrame) -> DataFrame:
    """Names that were neither rolled nor closed by the date (``asset``, ``since``)."""
    gone = inactive.groupBy("asset").agg(F.min("since").alias("_since"))
    joined = pool.join(gone, "asset", "left")
    return joined.where(F.col("_since").isNull() | (F.col("date") < F.col("_since"))).select("date", "asset")


def select_is_open(pool: DataFrame, weights: DataFrame) -> DataFrame:
    """Names held on the date."""
    held = weights.where(F.abs("weight") >= 1e-12).select("date", "asset")
    return pool.join(held, ["date", "asset"], "left_semi")


def select_these(panel: DataFrame, pool: DataFrame, names: Sequence[str]) -> DataFrame:
    return _tradable_pool(pool.where(F.col("asset").isin(list(names))), panel)


def select_where(panel: DataFrame, pool: DataFrame, flags: DataFrame) -> DataFrame:
    """Names whose flag is set on the date."""
    on = flags.where(F.coalesce("flag", F.lit(False))).select("date", "asset")
    return _tradable_pool(pool.join(on, ["date", "asset"], "left_semi"), panel)


def select_sector(pool: DataFrame, sectors: DataFrame, names: Sequence[str]) -> DataFrame:
    """Names of the sectors; the sector frame may vary by date or not."""
    keys = ["date", "asset"] if "date" in sectors.columns else ["asset"]
    members = sectors.where(F.col("sector").isin(list(names))).select(*keys).distinct()
    return pool.join(members, keys, "left_semi")


def remove_securities(pool: DataFrame, names: Sequence[str]) -> DataFrame:
    return pool.where(~F.col("asset").isin(list(names)))


def add_security(
    panel: DataFrame, pool: DataFrame, names: Sequence[str], include_negative: bool = False, closed: DataFrame | None = None
) -> DataFrame:
    """The pool plus the listed names, as far as they trade on the pool's dates and are not closed."""
    dates = pool.select("date").distinct()
    extra = panel.where(F.col("asset").isin(list(names))).join(dates, "date", "left_semi").select("date", "asset")
    if closed is not None:
        extra = extra.join(closed.select("asset").distinct(), "asset", "left_anti")
    both = pool.select("date", "asset").unionByName(extra.select("date", "asset")).distinct()
    return _tradable_pool(both, panel, include_negative)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Ordering], n: int, salt: Column) -> DataFrame:
    """First n rows per key, in two rounds: n per salt of a key, then n of the survivors.

    A key has as many salts as the cluster has shuffle partitions, so the rows
    of one hot key are dealt to all of them.
    """
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = []
    out = df
    for i, item in enumerate(order):
        out = out.withColumn(f"_o{i}", item.column)
        names.append(apply_direction(f"_o{i}", item))
    out = out.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*names)
    final = Window.partitionBy(*keys).orderBy(*names)
    out = out.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    out = out.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= n)
    return out.select(*df.columns)


def _shuffle_key(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col("date").cast("string"), F.col("asset"), F.lit(str(seed))))


def select_randomly(pool: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Up to n names per date in the order of a seeded hash."""
    return top_n(pool.select("date", "asset"), ["date"], [Ordering(_shuffle_key(seed))], n, F.col("asset"))


def ranked_metric(metric: DataFrame, pool: DataFrame) -> DataFrame:
    """Finite metrics (``factor``) of the pool."""
    known = metric.withColumn("factor", finite(F.col("factor"))).where(F.col("factor").isNotNull())
    return known.join(pool.select("date", "asset").distinct(), ["date", "asset"], "left_semi").select("date", "asset", "factor")


def select_n(metric: DataFrame, pool: DataFrame, n: float, descending: bool = True) -> DataFrame:
    """The n best names per date; a fraction below one takes that share, at least one name."""
    rows = ranked_metric(metric, pool)
    order = [Ordering("factor", descending), Ordering("asset")]
    if n >= 1:
        return top_n(rows, ["date"], order, int(n), F.col("asset")).select("date", "asset")
    sized = with_group_totals(ordered_prefix(rows, ["date"], order), ["date"], _size=F.count(F.lit(1)))
    take = F.greatest(F.floor(F.col("_size") * F.lit(float(n))), F.lit(1))
    return sized.where(F.col("_pos") <= take).select("date", "asset")


def tiles(rows: DataFrame, keys: Sequence[str], order: Sequence[Ordering], n: int, name: str) -> DataFrame:
    """Number the tiles of each group 1..n; the first (size mod n) tiles hold one more."""
    sized = with_group_totals(ordered_prefix(rows, keys, order), keys, _size=F.count(F.lit(1)))
    small = F.floor(F.col("_size") / n)
    extra = F.col("_size") % n
    edge = extra * (small + 1)
    late = extra + F.ceil((F.col("_pos") - edge) / F.greatest(small, F.lit(1)))
    tile = F.when(F.col("_pos") <= edge, F.ceil(F.col("_pos") / (small + 1))).otherwise(late)
    return sized.withColumn(name, tile.cast("int")).select(*rows.columns, name)


def select_quantile(metric: DataFrame, pool: DataFrame, n_tiles: int, tile: int, descending: bool = True) -> DataFrame:
    rows = tiles(ranked_metric(metric, pool), ["date"], [Ordering("factor", descending), Ordering("asset")], n_tiles, "_t")
    return rows.where(F.col("_t") == tile).select("date", "asset")


def sector_double_sort(
    metric: DataFrame, pool: DataFrame, sectors: DataFrame, n_tiles: int, descending: bool = True
) -> DataFrame:
    """The best tile inside every sector."""
    keys = ["date", "asset"] if "date" in sectors.columns else ["asset"]
    rows = ranked_metric(metric, pool).join(sectors.where(F.col("sector").isNotNull()), keys)
    order = [Ordering("factor", descending), Ordering("asset")]
    return tiles(rows, ["date", "sector"], order, n_tiles, "_t").where(F.col("_t") == 1).select("date", "asset")


def standard_double_sort(
    metric_1: DataFrame,
    metric_2: DataFrame,
    pool: DataFrame,
    n_tiles_1: int,
    n_tiles_2: int,
    descending: bool = True,
) -> DataFrame:
    """Tiles by the first metric, always from the top; the best tile by the second in each."""
    first = ranked_metric(metric_1, pool)
    second = ranked_metric(metric_2, pool).withColumnRenamed("factor", "_second")
    rows = first.join(second, ["date", "asset"])
    outer = tiles(rows, ["date"], [Ordering("factor", True), Ordering("asset")], n_tiles_1, "_t1")
    inner = tiles(outer, ["date", "_t1"], [Ordering("_second", descending), Ordering("asset")], n_tiles_2, "_t2")
    return inner.where(F.col("_t2") == 1).select("date", "asset")


def selection_stats(metric: DataFrame, selected: DataFrame) -> DataFrame:
    """TOTAL_NAMES, MEAN and MEDIAN of the metric over the selected names."""
    rows = ranked_metric(metric, selected)
    middle = exact_quantiles(rows, ["date"], "factor", "asset", {"MEDIAN": 0.5})
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("TOTAL_NAMES"), F.avg("factor").alias("MEAN")).join(middle, "date")
