"""Portfolio accounting as dataflow: values, positions, trades and fees of a weight schedule.

A schedule is (date, asset, weight) with the trade dates on which it is put in
place.  Trades execute at the close before the trade date c, so between two
trade dates the value is

    V(t) = B (1 - sum w + sum w P(t) / P(c)),

and the base B of a segment is the end value of the one before, plus flows.
Growth inside every segment is one join and one grouped sum over all dates.  A
segment so is a step from one value to the next, gain times value plus shift;
the steps of a portfolio are chained by ``affine_scan``.  Values, positions,
weights, trades and turnover all read this one book, so they take the same
inputs: cash held back, closing dates, flows, a live start and margin.

Every frame may carry portfolio columns (``by``), so that any number of
schedules is valued in the same job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.calendar import close_after_dates
from tickloom.operators.panels import placed
from tickloom.operators.support import affine_scan, with_scalars
from tickloom.session import cut_lineage

CASH = "Cash"


def cash_reserve(schedule: DataFrame, fraction: float) -> DataFrame:
    """Schedule on the part of the value that is not held back; an impossible fraction trades nothing."""
    if not 0 <= fraction <= 1:
        return schedule.limit(0)
    return schedule.withColumn("weight", F.col("weight") * (1 - fraction))


def segments(calendar: DataFrame, schedule: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trade dates with the calendar positions they rule: (by, seg, start, base_pos, final)."""
    line = Window.partitionBy(*by).orderBy("pos")
    turns = schedule.select(*by, "date").distinct().join(calendar, "date").where(F.col("pos") > 0)
    return cut_lineage(
        turns.select(
            *by,
            F.col("date").alias("seg"),
            F.col("pos").alias("start"),
            (F.col("pos") - 1).alias("base_pos"),
            F.coalesce(F.lead("pos").over(line) - 1, F.col("last")).alias("final"),
        )
    )


def closings(calendar: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(asset, _closed): the position of each asset's first closing date."""
    closing = close_after_dates(calendar, cutoffs).groupBy("asset").agg(F.min("date").alias("date"))
    return closing.join(calendar.select("date", "pos"), "date").select("asset", F.col("pos").alias("_closed"))


def close_positions(prices: DataFrame, calendar: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Prices frozen from each closing date on, at the close before it.

    A position closed to cash is worth its last executed price from then on, so
    the value needs no extra segment.
    """
    closing = closings(calendar, cutoffs)
    rows = placed(prices.where(F.col("value").isNotNull()), calendar).join(closing, "asset", "left")
    rows = rows.where(F.col("_closed").isNull() | (F.col("pos") < F.col("_closed")))
    line = Window.partitionBy("asset").orderBy("pos")
    final = F.when(F.lead("pos").over(line).isNull() & F.col("_closed").isNotNull(), F.col("last")).otherwise(F.col("pos"))
    spread = rows.withColumn("_final", final).select("asset", "value", F.explode(F.sequence("pos", "_final")).alias("pos"))
    return spread.join(calendar.select("pos", "date"), "pos").select("date", "asset", "value")


def open_schedule(schedule: DataFrame, calendar: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Schedule without the names already closed on the trade date."""
    closing = close_after_dates(calendar, cutoffs).groupBy("asset").agg(F.min("date").alias("_closed"))
    rows = schedule.join(closing, "asset", "left")
    return rows.where(F.col("_closed").isNull() | (F.col("date") < F.col("_closed"))).select(*schedule.columns)


def _priced(column: str, what: str) -> Column:
    """A price that a held name must have; a weight without one fails the job."""
    say = F.concat_ws(" ", F.lit(f"no {what} for"), F.col("asset"), F.lit("held from"), F.col("seg").cast("string"), F.lit("at position"), F.col("pos").cast("string"))
    return F.coalesce(column, F.when(F.abs("weight") >= 1e-12, F.raise_error(say).cast("double")))


def opened(prices: DataFrame, calendar: DataFrame, schedule: DataFrame, by: Sequence[str], segs: DataFrame) -> DataFrame:
    """(by, seg, start, final, asset, weight, base): every held name with the price it was traded at."""
    rows = placed(prices.where(F.col("value").isNotNull()), calendar)
    held = schedule.select(*by, F.col("date").alias("seg"), "asset", "weight").join(segs, [*by, "seg"])
    base = rows.select(F.col("pos").alias("base_pos"), "asset", F.col("value").alias("base"))
    known = held.join(base, ["base_pos", "asset"], "left").withColumn("pos", F.col("base_pos"))
    return known.select(*by, "seg", "start", "final", "asset", "weight", _priced("base", "price to trade at").alias("base"))


def holdings_growth(
    prices: DataFrame, calendar: DataFrame, schedule: DataFrame, by: Sequence[str] = (), segs: DataFrame | None = None
) -> DataFrame:
    """(by, seg, date, pos, asset, weight, base, price) of every held name on every date of its segment.

    A held name without a price on one of those dates, or on the one before its
    trade, fails the job: its value would be lost without a word.
    """
    by = list(by)
    segs = segments(calendar, schedule, by) if segs is None else segs
    rows = placed(prices.where(F.col("value").isNotNull()), calendar).select("pos", "asset", F.col("value").alias("price"))
    cells = opened(prices, calendar, schedule, by, segs).select(
        *by, "seg", "asset", "weight", "base", F.explode(F.sequence("start", "final")).alias("pos")
    )
    daily = cells.join(rows, ["pos", "asset"], "left").withColumn("price", _priced("price", "price"))
    return daily.join(calendar.select("pos", "date"), "pos").select(*by, "seg", "date", "pos", "asset", "weight", "base", "price")


def live_calendar(calendar: DataFrame, live_start) -> DataFrame:
    """The calendar from the live start on, which must be one of its dates; positions begin there."""
    found = calendar.where(F.col("date") == F.lit(str(live_start)).cast("date")).select("pos").first()
    if found is None:
        raise ValueError(f"{live_start} is no date of the calendar")
    moved = calendar.select("date", (F.col("pos") - found["pos"]).alias("pos"), (F.col("last") - found["pos"]).alias("last"))
    return cut_lineage(moved.where(F.col("pos") >= 0))


@dataclass(frozen=True)
class Book:
    """What a schedule's reports read: prices as traded, segments, held names and the value line."""

    by: list[str]
    prices: DataFrame
    calendar: DataFrame
    schedule: DataFrame
    segs: DataFrame
    growth: DataFrame  # as holdings_growth, with whether the name is closed by then
    closed: DataFrame | None  # (asset, _closed)
    line: DataFrame  # (by, date, pos, base_value, value, cash, index)


def book(
    prices: DataFrame,
    calendar: DataFrame,
    schedule: DataFrame,
    initial_capital: float = 1e6,
    cash: float | None = None,
    cutoffs: DataFrame | None = None,
    flows: DataFrame | None = None,
    by: Sequence[str] = (),
    live_start=None,
    margin: bool = False,
) -> Book:
    """The book of a schedule, for any of the reports.

    ``flows`` is (date, amount): money added on a date, invested with the next
    trade (or the one on that date) and neutral to the index.  With
    ``live_start`` the capital is put in at the close of that date, earlier
    dates are history for signals only and the first trade comes after it.
    Weights that add up to more than one fail unless ``margin`` is allowed.  A
    name is sold at the close before its closing date (``cutoffs``) and stays in
    cash until the next trade; negative weights are short positions.
    """
    by = list(by)
    if live_start is not None:
        calendar = live_calendar(calendar, live_start)
    if cash is not None:
        schedule = cash_reserve(schedule, cash)
    traded, closed = prices, None
    if cutoffs is not None:
        prices = close_positions(prices, calendar, cutoffs)
        schedule = open_schedule(schedule, calendar, cutoffs)
        closed = closings(calendar, cutoffs)
    segs = segments(calendar, schedule, by)
    growth = holdings_growth(prices, calendar, schedule, by, segs).withColumn("closed", F.lit(False))
    if closed is not None:
        growth = growth.join(closed, "asset", "left").withColumn("closed", F.coalesce(F.col("pos") >= F.col("_closed"), F.lit(False)))
    line = _values(growth, calendar, schedule, segs, initial_capital, flows, by, margin)
    return Book(by, traded, calendar, schedule, segs, growth, closed, line)


def nav(prices: DataFrame, calendar: DataFrame, schedule: DataFrame, initial_capital: float = 1e6, **inputs) -> DataFrame:
    """(by, date, value, cash, index) on every calendar date; ``inputs`` as for ``book``."""
    kept = book(prices, calendar, schedule, initial_capital, **inputs)
    return kept.line.select(*kept.by, "date", "value", "cash", "index")


def _values(growth, calendar, schedule, segs, initial_capital, flows, by, margin=False) -> DataFrame:
    """Value line with its segment base: (by, date, pos, base_value, value, cash, index)."""
    ratio = F.col("weight") * F.col("price") / F.col("base")
    held = growth.groupBy(*by, "seg", "pos").agg(
        F.sum(ratio).alias("_held"), F.sum(F.when(F.col("closed"), ratio)).alias("_sold")
    )
    invested = schedule.select(*by, F.col("date").alias("seg"), "weight").groupBy(*by, "seg").agg(F.sum("weight").alias("_w"))
    if not margin:
        say = F.concat_ws(" ", F.lit("weights of"), F.col("seg").cast("string"), F.lit("add up to"), F.col("_w").cast("string"))
        spent = F.when(F.col("_w") > 1 + 1e-6, F.raise_error(say).cast("double")).otherwise(F.col("_w"))
        invested = invested.withColumn("_w", spent)
    days = segs.select(*by, "seg", "start", "final", F.explode(F.sequence("start", "final")).alias("pos"))
    line = days.join(invested, [*by, "seg"], "left").join(held, [*by, "seg", "pos"], "left")
    line = line.na.fill(0.0, ["_w", "_held", "_sold"]).withColumn("_f", 1 - F.col("_w") + F.col("_held"))
    # one row per portfolio and date, read for the ends of segments and for their dates
    line = cut_lineage(line.select(*by, "seg", "start", "final", "pos", "_w", "_sold", "_f"))

    whole = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    amounts = calendar.select("date", "pos")
    if flows is None:
        amounts = amounts.withColumn("_flow", F.lit(0.0)).withColumn("_in", F.lit(0.0))
    else:
        moved = flows.groupBy("date").agg(F.sum("amount").cast("double").alias("_flow"))
        amounts = amounts.join(moved, "date", "left").na.fill(0.0, ["_flow"])
        amounts = amounts.withColumn("_in", F.sum("_flow").over(whole))  # one row per date
    ends = line.where(F.col("pos") == F.col("final")).select(*by, "seg", "start", "_f")
    opening = amounts.select(F.col("pos").alias("start"), F.col("_in").alias("_in_at_start"))
    turns = ends.join(opening, "start")
    # money that came since the trade before goes in with this one
    arrived = F.col("_in_at_start") - F.coalesce(F.lag("_in_at_start").over(Window.partitionBy(*by).orderBy("start")), F.lit(0.0))
    turns = turns.withColumn("_arrived", arrived)
    based = affine_scan(turns, by, "start", F.col("_f"), F.col("_f") * F.col("_arrived"), float(initial_capital), "_value")
    based = based.select(*by, "seg", (F.col("_value") + F.col("_arrived")).alias("base_value"), "_in_at_start")

    spine = amounts
    if by:
        # portfolios times the dates of one calendar
        spine = with_scalars(segs.select(*by).distinct(), amounts.agg(F.sort_array(F.collect_list(F.struct("pos", "date", "_flow", "_in"))).alias("_days")))
        spine = spine.select(*by, F.explode("_days").alias("_d")).select(*by, "_d.*")
    full = spine.join(line, [*by, "pos"], "left").join(based, [*by, "seg"], "left")
    capital = F.lit(float(initial_capital))
    waiting = F.col("_in") - F.coalesce("_in_at_start", F.lit(0.0))
    idle = F.col("seg").isNull()  # dates before the first trade keep the capital in cash
    full = full.withColumn("value", F.when(idle, capital + F.col("_in")).otherwise(F.col("base_value") * F.col("_f") + waiting))
    kept = F.col("base_value") * (1 - F.col("_w") + F.col("_sold")) + waiting
    full = full.withColumn("cash", F.when(idle, F.col("value")).otherwise(kept))
    order = Window.partitionBy(*by).orderBy("pos")
    bottom = F.coalesce(F.lag("value").over(order), capital) + F.col("_flow")
    step = F.when(F.abs(bottom) > 1e-16, F.col("value") / F.when(F.abs(bottom) > 1e-16, bottom)).otherwise(1.0)
    index = 100.0 * F.product("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return full.withColumn("_step", step).withColumn("index", index).select(
        *by, "date", "pos", F.coalesce("base_value", capital).alias("base_value"), "value", "cash", "index"
    )


def strategy_index(values: DataFrame, flows: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Unit price from 100 of a value line (date, value); flows enter the denominator."""
    order = Window.partitionBy(*by).orderBy("date")
    rows = values if flows is None else values.join(flows.groupBy("date").agg(F.sum("amount").alias("_flow")), "date", "left")
    flow = F.lit(0.0) if flows is None else F.coalesce("_flow", F.lit(0.0))
    bottom = F.lag("value").over(order) + flow
    step = F.when(F.abs(bottom) > 1e-16, F.col("value") / F.when(F.abs(bottom) > 1e-16, bottom)).otherwise(1.0)
    return rows.withColumn("_step", step).withColumn(
        "index", 100.0 * F.product("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).select(*by, "date", "index")


def _written(kept: Book) -> DataFrame:
    """The value line (one row per portfolio and date), written once for what reads it more often."""
    return cut_lineage(kept.line.select(*kept.by, "date", "pos", "base_value", "value", "cash"))


def _held_names(kept: Book) -> DataFrame:
    return kept.growth.where(~F.col("closed"))


def drifted_weights(prices, calendar, schedule, initial_capital: float = 1e6, **inputs) -> DataFrame:
    """Share of every name and of cash in the value, per date; ``inputs`` as for ``book``."""
    kept = book(prices, calendar, schedule, initial_capital, **inputs)
    by, values = kept.by, _written(kept)
    worth = _held_names(kept).join(values.select(*by, "pos", "base_value", "value"), [*by, "pos"])
    names = worth.select(
        *by, "date", "asset", (F.col("base_value") * F.col("weight") * F.col("price") / F.col("base") / F.col("value")).alias("weight")
    )
    cash = values.select(*by, "date", F.lit(CASH).alias("asset"), (F.col("cash") / F.col("value")).alias("weight"))
    return names.unionByName(cash)


def member_weights(children: DataFrame, parents: DataFrame, parent: str = "parent") -> DataFrame:
    """Weights per full member name: a child's weights scaled by its own weight in the parent.

    ``children`` is (child, date, asset, weight), ``parents`` (date, asset, weight)
    with the children as assets.
    """
    own = parents.select("date", F.col("asset").alias("child"), F.col("weight").alias("_p"))
    inner = children.join(own, ["date", "child"]).select(
        "date", F.concat_ws(">", F.lit(parent), "child", "asset").alias("member"), (F.col("weight") * F.col("_p")).alias("weight")
    )
    outer = own.select("date", F.concat_ws(">", F.lit(parent), "child").alias("member"), F.col("_p").alias("weight"))
    return inner.unionByName(outer)


def _targets(kept: Book, values: DataFrame) -> DataFrame:
    """Units from each trade date on: (by, date, asset, quantity, execution, price), exits as zero."""
    by, calendar = kept.by, kept.calendar
    opening = opened(kept.prices, calendar, kept.schedule, by, kept.segs).withColumn("pos", F.col("start"))
    opening = opening.join(values.select(*by, "pos", "base_value"), [*by, "pos"])
    held = opening.select(
        *by, "pos", "final", "asset", (F.col("weight") * F.col("base_value") / F.col("base")).alias("quantity")
    )
    # a name that is not renewed leaves on the next trade date
    exits = held.select(*by, (F.col("final") + 1).alias("pos"), "asset", F.lit(0.0).alias("quantity"))
    turns = kept.segs.select(*by, F.col("start").alias("pos"))
    both = held.select(*by, "pos", "asset", "quantity").unionByName(exits.join(turns, [*by, "pos"], "left_semi"))
    if kept.closed is not None:
        # a closed one on its closing date
        left = held.join(kept.closed, "asset").where((F.col("_closed") > F.col("pos")) & (F.col("_closed") <= F.col("final")))
        both = both.unionByName(left.select(*by, F.col("_closed").alias("pos"), "asset", F.lit(0.0).alias("quantity")))
    units = both.groupBy(*by, "pos", "asset").agg(F.sum("quantity").alias("quantity"))
    marks = placed(kept.prices.where(F.col("value").isNotNull()), calendar)
    today = marks.select("pos", "asset", F.col("value").alias("price"))
    executed = marks.select((F.col("pos") + 1).alias("pos"), "asset", F.col("value").alias("execution"))
    return (
        units.join(today, ["pos", "asset"], "left")
        .join(executed, ["pos", "asset"], "left")
        .join(calendar.select("pos", "date"), "pos")
    )


def positions(prices, calendar, schedule, initial_capital: float = 1e6, **inputs) -> DataFrame:
    """Units held, on every date a name is held; ``inputs`` as for ``book``."""
    kept = book(prices, calendar, schedule, initial_capital, **inputs)
    worth = _held_names(kept).join(kept.line.select(*kept.by, "pos", "base_value"), [*kept.by, "pos"])
    return worth.select(*kept.by, "date", "asset", (F.col("weight") * F.col("base_value") / F.col("base")).alias("quantity"))


def trades(prices, calendar, schedule, initial_capital: float = 1e6, **inputs) -> DataFrame:
    """Changes of position: (by, date, asset, quantity, price, execution); ``inputs`` as for ``book``."""
    kept = book(prices, calendar, schedule, initial_capital, **inputs)
    return _changes(_targets(kept, kept.line), kept.by)


def _changes(units: DataFrame, by: Sequence[str]) -> DataFrame:
    line = Window.partitionBy(*by, "asset").orderBy("date")
    change = F.col("quantity") - F.coalesce(F.lag("quantity").over(line), F.lit(0.0))
    moved = units.withColumn("quantity", change)
    # rounding of a renewed position is no trade
    return moved.where(F.abs("quantity") > 1e-12).select(*by, "date", "asset", "quantity", "price", "execution")


def transactions(prices, calendar, schedule, initial_capital: float = 1e6, **inputs) -> DataFrame:
    """Trades with the price of their date."""
    return trades(prices, calendar, schedule, initial_capital, **inputs).drop("execution")


def outlays(prices, calendar, schedule, initial_capital: float = 1e6, **inputs) -> DataFrame:
    """Money spent (or received) per name and trade date, at the execution price."""
    rows = trades(prices, calendar, schedule, initial_capital, **inputs)
    return rows.withColumn("outlay", F.col("quantity") * F.col("execution")).drop("quantity", "price", "execution")


def turnover(prices, calendar, schedule, initial_capital: float = 1e6, **inputs) -> DataFrame:
    """Smaller of money bought and money sold over the value, on every date; ``inputs`` as for ``book``."""
    kept = book(prices, calendar, schedule, initial_capital, **inputs)
    by, values = kept.by, _written(kept)
    rows = _changes(_targets(kept, values), by)
    outlay = F.col("quantity") * F.col("execution")
    spent = rows.groupBy(*by, "date").agg(
        F.sum(F.greatest(outlay, F.lit(0.0))).alias("_buy"), F.sum(F.greatest(-outlay, F.lit(0.0))).alias("_sell")
    )
    share = F.coalesce(F.least("_buy", "_sell"), F.lit(0.0)) / F.col("value")
    return values.join(spent, [*by, "date"], "left").select(*by, "date", share.alias("turnover"))


def fees(trade_rows: DataFrame, commission: Callable[[Column, Column], Column], by: Sequence[str] = ()) -> DataFrame:
    """Commission per date of (date, asset, quantity, execution) rows."""
    charge = commission(F.col("quantity"), F.col("execution"))
    return trade_rows.groupBy(*by, "date").agg(F.sum(charge).alias("fee"))


def bankruptcy(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First date with a negative value, per portfolio."""
    broke = values.where(F.col("value") < -1e-12)
    return broke.groupBy(*by).agg(F.min("date").alias("bankrupt_on")) if by else broke.agg(F.min("date").alias("bankrupt_on"))


def cut_at_bankruptcy(values: DataFrame, by: Sequence[str] = (), child: bool = False) -> DataFrame:
    """Value line up to its bankruptcy; a child keeps the later dates, empty."""
    first = bankruptcy(values, by)
    marked = values.join(first, list(by), "left") if by else with_scalars(values, first)
    alive = F.col("bankrupt_on").isNull() | (F.col("date") <= F.col("bankrupt_on"))
    if child:
        return marked.withColumn("value", F.when(alive, F.col("value"))).drop("bankrupt_on")
    return marked.where(alive).drop("bankrupt_on")


def missing_prices(prices: DataFrame, calendar: DataFrame, schedule: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Held (date, asset) cells without a price."""
    segs = segments(calendar, schedule, by)
    held = schedule.select(*by, F.col("date").alias("seg"), "asset").join(segs, [*by, "seg"])
    cells = held.select(*by, "asset", F.explode(F.sequence("base_pos", "final")).alias("pos")).distinct()
    have = placed(prices.where(F.col("value").isNotNull()), calendar).select("pos", "asset")
    gaps = cells.join(have, ["pos", "asset"], "left_anti")
    return gaps.join(calendar.select("pos", "date"), "pos").select(*by, "date", "asset")


def nested_prices(prices: DataFrame, children: DataFrame) -> DataFrame:
    """Price panel with the index of each child strategy as one more asset.

    ``children`` is (child, date, index).
    """
    return prices.select("date", "asset", "value").unionByName(
        children.select("date", F.col("child").alias("asset"), F.col("index").alias("value"))
    )


def margin_interest(balances: DataFrame, rate: float, requirement: float, by: Sequence[str] = ()) -> DataFrame:
    """Interest on borrowed cash since the row before, and whether equity fell below its requirement.

    ``balances`` is (date, cash, value, exposure).
    """
    order = Window.partitionBy(*by).orderBy("date")
    days = F.datediff("date", F.lag("date").over(order))
    growth = F.pow(F.lit(1.0 + rate), days / 365.25) - 1
    interest = F.when(F.col("cash") < 0, -F.col("cash") * growth).otherwise(0.0)
    cover = F.try_divide("value", "exposure")
    return balances.withColumn("interest", F.coalesce(interest, F.lit(0.0))).withColumn(
        "breach", F.coalesce(cover < requirement, F.lit(False))
    )


def backfill_holdings(
    holdings: DataFrame, prices: DataFrame, calendar: DataFrame, index: str, start, end
) -> DataFrame:
    """Buy-and-hold drift of an index's weights after its last known date.

    ``holdings`` (DATE, INDEX, FIGI, WEIGHT, QUANTITY, ...), ``prices`` (date,
    asset = FIGI, value).  One trade on the first date after ``start``; later
    rows carry the drifted weight, the price to two decimals (halves to even) and
    the market value.
    """
    first, final = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    known = holdings.where((F.col("INDEX") == index) & (F.col("DATE") == first))
    after = calendar.where(F.col("date") > first).agg(F.min("date").alias("date"))
    base = known.groupBy("FIGI").agg(F.sum("WEIGHT").alias("WEIGHT"))
    schedule = with_scalars(base.select(F.col("FIGI").alias("asset"), F.col("WEIGHT").alias("weight")), after)
    live = drifted_weights(prices, calendar, schedule.select("date", "asset", "weight"))
    live = live.where((F.col("asset") != CASH) & (F.col("date") > first) & (F.col("date") <= final) & (F.col("weight") > 0))
    rows = live.select(F.col("date").alias("DATE"), F.col("asset").alias("FIGI"), F.col("weight").alias("WEIGHT"))
    marks = prices.select(F.col("date").alias("DATE"), F.col("asset").alias("FIGI"), (F.rint(F.col("value") * 100) / 100).alias("PRICE"))
    meta = known.drop("DATE", "WEIGHT", "MARKET_VALUE", "PRICE")
    joined = rows.join(meta, "FIGI", "left").join(marks, ["DATE", "FIGI"], "left")
    return joined.withColumn("MARKET_VALUE", F.col("QUANTITY") * F.col("PRICE")).orderBy("DATE", F.col("WEIGHT").desc(), "FIGI")
