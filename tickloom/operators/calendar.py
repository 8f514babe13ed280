"""Trading calendar, calendar windows and the dates on which a strategy acts.

A calendar is (date, pos, last): the distinct trading dates, their 0-based
position and the last position.  Its windows run over one partition; that is the
one place where this is sound, as a calendar has one row per trading day.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.support import finite
from tickloom.session import cut_lineage


def _by_date():
    return Window.orderBy("date")


def _around():
    return Window.orderBy("pos")


def calendar_of(dates: DataFrame) -> DataFrame:
    """Calendar of a frame with a ``date`` column, written once."""
    distinct = dates.select("date").where(F.col("date").isNotNull()).distinct()
    placed = distinct.withColumn("pos", F.row_number().over(_by_date()) - 1)
    whole = Window.partitionBy()
    return cut_lineage(placed.withColumn("last", F.max("pos").over(whole)))


@dataclass(frozen=True)
class Offset:
    """A calendar distance; months clamp to the end of a shorter month."""

    months: int = 0
    days: int = 0

    def before(self, date: Column) -> Column:
        return F.date_sub(F.add_months(date, -self.months), self.days)

    def after(self, date: Column) -> Column:
        return F.date_add(F.add_months(date, self.months), self.days)


def day_map(calendar: DataFrame, direction: str) -> DataFrame:
    """Every calendar day with the trading date on or after ("next") or on or before ("previous") it.

    Turns an as-of lookup into an equi-join.  The map spans the calendar, first
    to last trading date.
    """
    if direction == "previous":
        edge = F.coalesce(F.date_sub(F.lead("date").over(_around()), 1), F.col("date"))
        span = F.sequence("date", "_edge")
    else:
        edge = F.coalesce(F.date_add(F.lag("date").over(_around()), 1), F.col("date"))
        span = F.sequence("_edge", "date")
    return calendar.withColumn("_edge", edge).select(F.explode(span).alias("day"), "date", "pos")


def bounds(calendar: DataFrame) -> tuple[Column, Column]:
    """First and last trading date as literals, read once from the written calendar; null for an empty one."""
    first, last = calendar.agg(F.min("date"), F.max("date")).first()
    return F.lit(first).cast("date"), F.lit(last).cast("date")


def as_of(calendar: DataFrame, days: DataFrame) -> DataFrame:
    """``days`` (with a column ``day``) with the trading date (date, pos) on or before each.

    A day after the last trading date reads the last one; a day before the
    first has none and drops out.
    """
    _, last_date = bounds(calendar)
    reached = days.withColumn("_day", F.when(last_date.isNotNull(), F.least(F.col("day"), last_date)))
    known = day_map(calendar, "previous").select(F.col("day").alias("_day"), "date", "pos")
    return reached.join(known, "_day").drop("_day")


def window_edges(
    calendar: DataFrame, dates: DataFrame, lookback: Offset, lag: Offset = Offset(), lookforward: Offset | None = None
) -> DataFrame:
    """(now, a, b): first and last calendar position of the window of every ``now``.

    The window runs from now - lookback to now - lag (+ lookforward), inclusive;
    the lag does not move its start.
    """
    end = lag.before(F.col("now"))
    if lookforward is not None:
        end = lookforward.after(end)
    frame = dates.select(F.col("date").alias("now")).distinct()
    edges = frame.select("now", lookback.before(F.col("now")).alias("_from"), end.alias("_to"))
    first_date, last_date = bounds(calendar)
    edges = edges.withColumn("_from", F.greatest(F.col("_from"), first_date)).withColumn("_to", F.least(F.col("_to"), last_date))
    after = day_map(calendar, "next").select(F.col("day").alias("_from"), F.col("pos").alias("a"))
    before = day_map(calendar, "previous").select(F.col("day").alias("_to"), F.col("pos").alias("b"))
    return edges.join(after, "_from").join(before, "_to").where(F.col("a") <= F.col("b")).select("now", "a", "b")


def window_bridge(
    calendar: DataFrame,
    dates: DataFrame,
    lookback: Offset,
    lag: Offset = Offset(),
    lookforward: Offset | None = None,
) -> DataFrame:
    """(now, date, wpos, wlen): the trading dates of the window of every ``now``.

    The bridge is built from the calendar alone, so the price history later
    needs one equi-join on ``date``.  It is for what needs the rows of a window
    themselves; sums and ends of windows come from ``window_sums`` and
    ``window_ends`` without copying a row.
    """
    placed = window_edges(calendar, dates, lookback, lag, lookforward)
    rows = placed.select(
        "now", F.explode(F.sequence("a", "b")).alias("pos"), F.col("a").alias("_start"), (F.col("b") - F.col("a") + 1).alias("wlen")
    )
    bridge = rows.join(calendar.select("pos", "date"), "pos").select(
        "now", "date", (F.col("pos") - F.col("_start")).cast("int").alias("wpos"), F.col("wlen").cast("int").alias("wlen")
    )
    return cut_lineage(bridge)


def on_calendar(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """(asset, pos, last, value) of the panel's finite values."""
    rows = panel.withColumn("value", finite(F.col("value"))).where(F.col("value").isNotNull())
    return rows.join(calendar.select("date", "pos", "last"), "date").select("asset", "pos", "last", "value")


def _wanted(edges: DataFrame, pool: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """The windows asked for and the columns they are looked up by."""
    if pool is None:
        return edges, []
    return pool.select(F.col("date").alias("now"), "asset").distinct().join(edges, "now"), ["asset"]


def window_sums(
    rows: DataFrame, edges: DataFrame, pool: DataFrame | None = None, last: Sequence[str] = (),
    results: dict[str, Column] | None = None, **terms: Column,
) -> DataFrame:
    """(now, asset, a, b, last, terms): sums of the terms over every window, for all assets or a pool's (date, asset).

    Running sums per asset restart in blocks as long as the longest window and
    stand until the next row of their block.  A window lies in two blocks at
    most, so it is what stands at its end, plus the rest of the block before,
    less what stood ahead of its start: no row is copied into windows.  So that
    a difference loses nothing, a term is summed in two parts: its multiple of
    a power of two that is coarse enough for an asset's sums to be exact, and
    the rest.  Windows without rows may be missing or have sums of zero.

    Terms may use ``u``, the position inside the block.  ``results`` are given
    instead of the terms if named: expressions of them and of ``s``, which
    added to ``u`` counts the window's positions from 1.  ``last`` names columns
    of ``rows`` to take from the window's last row.
    """
    size = edges.agg(F.max(F.col("b") - F.col("a") + 1)).first()[0] or 1  # a calendar has few windows
    line = Window.partitionBy("asset", "_block").orderBy("pos")
    whole = Window.partitionBy("asset")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)

    def block(pos: Column) -> Column:
        return F.floor(pos / F.lit(int(size))).cast("int")

    placed = rows.withColumn("_block", block(F.col("pos"))).withColumn("u", (F.col("pos") - F.col("_block") * size).cast("double"))
    numbers = placed.select("asset", "pos", "last", "_block", *last, *[t.cast("double").alias(n) for n, t in terms.items()])
    # the sum of an asset's terms is below 2 ^ 53 units
    most = {n: F.max(F.abs(n)).over(whole) * F.count(F.lit(1)).over(whole) for n in terms}
    numbers = numbers.select("*", *[F.pow(F.lit(2.0), F.ceil(F.log2(F.when(m > 0, m))) - 52).alias(f"u_{n}") for n, m in most.items()])
    coarse = {n: F.coalesce(F.rint(F.col(n) / F.col(f"u_{n}")) * F.col(f"u_{n}"), F.lit(0.0)) for n in terms}
    parts = {f"c_{n}": c for n, c in coarse.items()} | {f"f_{n}": F.col(n) - c for n, c in coarse.items()}
    until = F.least(F.coalesce(F.lead("pos").over(line) - 1, F.col("last")), (F.col("_block") + 1) * size - 1, F.col("last"))
    running = numbers.select(
        "asset", F.col("pos").alias("_at"), *last, until.alias("_until"), *[F.sum(c).over(upto).alias(n) for n, c in parts.items()]
    )
    standing = running.select("*", F.explode(F.sequence("_at", "_until")).alias("pos")).drop("_until")

    wanted, by = _wanted(edges.where("a <= b"), pool)
    first, final = block(F.col("a")), block(F.col("b"))

    def read(pos: Column, of: Column, sign: int, when: Column) -> Column:
        return F.when(when, F.struct(pos.cast("int").alias("pos"), (of * size - F.col("a") + 1).cast("double").alias("s"), F.lit(sign).alias("_sign")))

    reads = F.array(
        read(F.col("b"), final, 1, F.lit(True)),
        read((first + 1) * size - 1, first, 1, first != final),
        read(F.col("a") - 1, first, -1, F.col("a") > first * size),
    )
    looked = wanted.select("*", F.explode(F.array_compact(reads)).alias("_read")).select(*wanted.columns, "_read.*")
    met = looked.join(standing, [*by, "pos"])
    # the two parts of a term are added up apart
    if results is None:
        sums = [F.sum(F.col("_sign") * F.col(f"{part}_{n}")).alias(f"{part}_{n}") for part in "cf" for n in terms]
        given = [(F.col(f"c_{n}") + F.col(f"f_{n}")).alias(n) for n in terms]
    else:
        met = met.select("*", *[(F.col(f"c_{n}") + F.col(f"f_{n}")).alias(n) for n in terms])
        sums = [F.sum(F.col("_sign") * c).alias(n) for n, c in results.items()]
        given = [F.col(n) for n in results]
    newest = F.max(F.when(F.col("_sign") > 0, F.struct("_at", *last))).alias("_newest")
    grouped = met.groupBy("now", "asset", "a", "b").agg(newest, *sums)
    return grouped.select("now", "asset", "a", "b", *[F.col(f"_newest.{c}").alias(c) for c in last], *given)


_SPAN = 300.0  # decay of a block in natural logarithms: what lies two blocks back weighs e^-300 at most


def decayed_sums(rows: DataFrame, edges: DataFrame, decay: float, pool: DataFrame | None = None, **terms: Column) -> DataFrame:
    """(now, asset, a, b, n, terms): rows in every window, and sums of the terms times decay ** (b - pos).

    A running decayed sum follows from the one before, so a window is what
    stands at its end less what stood ahead of it, decayed on.  The running
    sums restart in blocks of bounded decay, so no power leaves the range of a
    double; no row is copied into windows.  ``decay`` is between 0 and 1.
    """
    rate = -math.log(decay)
    line = Window.partitionBy("asset").orderBy("pos")
    block = Window.partitionBy("asset", "_block").orderBy("pos")
    numbers = rows.select("asset", "pos", "last", *[t.cast("double").alias(n) for n, t in terms.items()])
    placed = numbers.withColumn("_block", F.floor(F.col("pos") * F.lit(rate / _SPAN)).cast("long"))
    since = F.col("pos") - F.first("pos").over(block)
    grown = placed.withColumn("_grown", F.exp(rate * since))
    inside = grown.select(
        "asset", "pos", "last", "_block", F.row_number().over(line).alias("n"),
        *[(F.sum(F.col(n) * F.col("_grown")).over(block) / F.col("_grown")).alias(n) for n in terms],
    )
    ends = F.coalesce(F.lead("_block").over(line) != F.col("_block"), F.lit(False))
    ended = inside.withColumn("_ends", ends)
    before = line.rowsBetween(Window.unboundedPreceding, -1)

    def carried(column: str) -> Column:
        return F.last(F.when(F.col("_ends"), F.col(column)), True).over(before)

    aged = F.exp(-rate * (F.col("pos") - carried("pos")))
    until = F.coalesce(F.lead("pos").over(line) - 1, F.col("last"))
    running = ended.select(
        "asset", F.col("pos").alias("at"), "n", until.alias("_until"),
        *[(F.col(n) + F.coalesce(carried(n) * aged, F.lit(0.0))).alias(n) for n in terms],
    )
    spread = running.select("*", F.explode(F.sequence("at", "_until")).alias("pos"))
    standing = spread.select("asset", "pos", "n", *[(F.col(n) * F.exp(-rate * (F.col("pos") - F.col("at")))).alias(n) for n in terms])
    wanted, by = _wanted(edges, pool)
    sums = ["n", *terms]
    upper = wanted.withColumn("pos", F.col("b")).join(standing, [*by, "pos"]).select("now", "asset", "a", "b", *sums)
    below = wanted.where("a > 0").withColumn("pos", F.col("a") - 1).join(standing, [*by, "pos"])
    lower = below.select("now", "asset", *[F.col(c).alias(f"_{c}") for c in sums])
    both = upper.join(lower, ["now", "asset"], "left").na.fill(0, [f"_{c}" for c in sums])
    gone = F.exp(-rate * (F.col("b") - F.col("a") + 1))
    return both.select(
        "now", "asset", "a", "b", (F.col("n") - F.col("_n")).alias("n"), *[(F.col(n) - gone * F.col(f"_{n}")).alias(n) for n in terms]
    )


def window_ends(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(now, asset, first, last): the first and the last value of every window, of assets that have one in it."""
    line = Window.partitionBy("asset").orderBy("pos")
    ahead = rows.select(
        "asset", "value", F.col("pos").alias("at"), F.coalesce(F.lag("pos").over(line) + 1, F.lit(0)).alias("_from"),
        F.coalesce(F.lead("pos").over(line) - 1, F.col("last")).alias("_until"),
    )
    coming = ahead.select("asset", F.col("value").alias("first"), "at", F.explode(F.sequence("_from", "at")).alias("pos"))
    gone = ahead.select("asset", F.col("value").alias("last"), F.explode(F.sequence("at", "_until")).alias("pos"))
    opening = edges.withColumn("pos", F.col("a")).join(coming, "pos").where(F.col("at") <= F.col("b")).select("now", "asset", "first")
    closing = edges.withColumn("pos", F.col("b")).join(gone, "pos").select("now", "asset", "last")
    return opening.join(closing, ["now", "asset"])


def window_range_join(panel: DataFrame, bridge: DataFrame) -> DataFrame:
    """History of every window: the panel rows joined to the windows their date belongs to."""
    return panel.join(bridge, "date")


# ------------------------------------------------------------------ gates
_PERIODS = {
    "day": lambda d: d,
    "week": F.weekofyear,
    "month": F.month,
    "quarter": F.quarter,
    "year": F.year,
}


def _run_period(calendar: DataFrame, unit: str, on_first: bool, end_of_period: bool, on_last: bool) -> DataFrame:
    """Dates whose period differs from the neighbour's.

    Weeks and months are compared by their number alone, without the year.  The
    first date never acts, the second by ``on_first``, the last by ``on_last``.
    """
    period = _PERIODS[unit](F.col("date"))
    neighbour = (F.lead if end_of_period else F.lag)("_p").over(_around())
    acts = (
        F.when(F.col("pos") == 0, False)
        .when(F.col("pos") == 1, on_first)
        .when(F.col("pos") == F.col("last"), on_last)
        .otherwise(F.col("_p") != F.col("_n"))
    )
    return calendar.withColumn("_p", period).withColumn("_n", neighbour).where(acts).select("date")


def run_daily(calendar, on_first=True, end_of_period=False, on_last=False) -> DataFrame:
    return _run_period(calendar, "day", on_first, end_of_period, on_last)


def run_weekly(calendar, on_first=True, end_of_period=False, on_last=False) -> DataFrame:
    return _run_period(calendar, "week", on_first, end_of_period, on_last)


def run_monthly(calendar, on_first=True, end_of_period=False, on_last=False) -> DataFrame:
    return _run_period(calendar, "month", on_first, end_of_period, on_last)


def run_quarterly(calendar, on_first=True, end_of_period=False, on_last=False) -> DataFrame:
    return _run_period(calendar, "quarter", on_first, end_of_period, on_last)


def run_yearly(calendar, on_first=True, end_of_period=False, on_last=False) -> DataFrame:
    return _run_period(calendar, "year", on_first, end_of_period, on_last)


def run_on_date(calendar: DataFrame, dates: Iterable[datetime.date | str]) -> DataFrame:
    return calendar.where(F.col("date").isin([F.lit(str(d)).cast("date") for d in dates])).select("date")


def run_once(calendar: DataFrame, on_first_call: bool = True) -> DataFrame:
    """The first acting date, or none when the first call is declined."""
    return calendar.where((F.col("pos") == 1) & F.lit(on_first_call)).select("date")


def run_after_date(calendar: DataFrame, date: datetime.date | str) -> DataFrame:
    return calendar.where(F.col("date") > F.lit(str(date)).cast("date")).select("date")


def run_after_days(calls: DataFrame, n: int) -> DataFrame:
    """All call dates but the first n."""
    return calls.select("date", F.row_number().over(_by_date()).alias("_k")).where(F.col("_k") > n).select("date")


def month_index(date: Column | str) -> Column:
    return F.year(date) * 12 + F.month(date)


def run_after_months(calls: DataFrame, n: int) -> DataFrame:
    """Call dates at least n calendar months after the first."""
    first = F.min(month_index("date")).over(Window.partitionBy())
    return calls.select("date", (month_index("date") - first).alias("_m")).where(F.col("_m") >= n).select("date")


def run_every_n_periods(calls: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """Every n-th call date, from the given offset."""
    k = F.row_number().over(_by_date()) - 1
    return calls.select("date", k.alias("_k")).where(F.col("_k") % n == offset % n).select("date")


def run_every_n_months(calendar: DataFrame, n: int) -> DataFrame:
    """The first acting date, then each first date n or more months after the last run.

    The run months are picked greedily by a fold over the distinct months of the
    calendar, one array of a few hundred numbers.
    """
    days = calendar.where(F.col("pos") > 0)
    firsts = days.groupBy(month_index("date").alias("month")).agg(F.min("date").alias("date"))
    months = firsts.agg(F.sort_array(F.collect_list(F.struct("month", "date"))).alias("_months"))
    empty = F.array().cast("array<date>")
    folded = F.aggregate(
        "_months",
        F.struct(F.lit(None).cast("int").alias("ran"), empty.alias("dates")),
        lambda state, item: F.when(
            state["ran"].isNull() | (item["month"] >= state["ran"] + n),
            F.struct(item["month"].alias("ran"), F.concat(state["dates"], F.array(item["date"])).alias("dates")),
        ).otherwise(state),
    )
    return months.select(F.explode(folded["dates"]).alias("date"))


def out_of_bounds(current: DataFrame, target: DataFrame, tol: float, mode: str = "relative") -> DataFrame:
    """Per date, whether any asset drifted from its target by more than ``tol``; cash does not count."""
    joined = (
        current.where(F.lower("asset") != "cash")
        .select("date", "asset", F.col("weight").alias("_c"))
        .join(target.where(F.lower("asset") != "cash").select("date", "asset", F.col("weight").alias("_t")), ["date", "asset"], "full")
        .na.fill(0.0, ["_c", "_t"])
    )
    gap = F.abs(F.col("_c") - F.col("_t"))
    if mode == "relative":
        gap = F.when(F.col("_t") == 0, F.abs("_c")).otherwise(F.try_divide(gap, F.abs("_t")))
    elif mode != "absolute":
        raise ValueError("mode must be relative or absolute")
    return joined.groupBy("date").agg(F.bool_or(gap > tol).alias("flag"))


def cash_out_of_bounds(balances: DataFrame, target: float, tol: float) -> DataFrame:
    """Per date, whether the cash share is more than ``tol`` off its target."""
    share = F.try_divide("cash", "value")
    return balances.select("date", F.coalesce(F.abs(share - target) > tol, F.lit(False)).alias("flag"))


def require(df: DataFrame, predicate, column: str, if_none: bool = False) -> DataFrame:
    """A boolean from a predicate on a value, with a default where the value is missing."""
    value = F.col(column)
    return df.withColumn("flag", F.when(value.isNull(), F.lit(if_none)).otherwise(predicate(value)))


def all_of(*gates: DataFrame) -> DataFrame:
    """Dates every gate lets through."""
    return reduce(lambda a, b: a.join(b.distinct(), "date", "left_semi"), gates)


def any_of(*gates: DataFrame) -> DataFrame:
    """Dates at least one gate lets through."""
    return reduce(lambda a, b: a.union(b), gates).distinct()


def negate(calendar: DataFrame, gate: DataFrame) -> DataFrame:
    """Calendar dates the gate holds back."""
    return calendar.select("date").join(gate.distinct(), "date", "left_anti")


def close_after_dates(calendar: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Closing date of each (asset, cutoff): the first trading date on or after its cutoff."""
    # pull every earlier cutoff up to the first trading date, then look up by day
    first_date, _ = bounds(calendar)
    placed = cutoffs.withColumn("day", F.greatest(F.col("cutoff"), first_date))
    return placed.join(day_map(calendar, "next"), "day").select("asset", "date")
