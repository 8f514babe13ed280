"""Portfolio weights and their modifiers: (date, asset, weight) for every date at once.

A selection is (date, asset).  Rows without a usable weight are dropped from
every result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.panels import shift
from tickloom.operators.support import Ordering, affine_scan, finite, ordered_prefix, with_group_totals
from tickloom.session import cut_lineage

TOLERANCE = 1e-12


def clean(weights: DataFrame) -> DataFrame:
    """Drop missing and zero weights."""
    value = finite(F.col("weight"))
    return weights.withColumn("weight", value).where(F.abs("weight") >= TOLERANCE).select("date", "asset", "weight")


def normalize_to_one(weights: DataFrame) -> DataFrame:
    """Weights over their total; a date whose total is zero has none."""
    sized = with_group_totals(weights, ["date"], _total=F.sum("weight"))
    return clean(sized.where(F.col("_total") != 0).withColumn("weight", F.col("weight") / F.col("_total")))


def _among(weights: DataFrame, selected: DataFrame) -> DataFrame:
    return weights.join(selected.select("date", "asset").distinct(), ["date", "asset"], "left_semi")


def w_equal(selected: DataFrame) -> DataFrame:
    names = selected.select("date", "asset").distinct()
    sized = with_group_totals(names, ["date"], _n=F.count(F.lit(1)))
    return sized.select("date", "asset", (1 / F.col("_n")).alias("weight"))


def w_fixed(dates: DataFrame, weights: Mapping[str, float], selected: DataFrame | None = None) -> DataFrame:
    """Literal weights as given, or those of the selected names scaled to one."""
    literal = F.create_map(*[x for name, value in weights.items() for x in (F.lit(name), F.lit(float(value)))])
    if selected is None:
        rows = dates.select("date").distinct().select("date", F.explode(literal).alias("asset", "weight"))
        return clean(rows)
    names = selected.select("date", "asset").distinct().join(dates.select("date").distinct(), "date", "left_semi")
    return normalize_to_one(names.withColumn("weight", literal[F.col("asset")]).where(F.col("weight").isNotNull()))


def w_schedule(
    panel: DataFrame, calendar: DataFrame, dates: DataFrame, selected: DataFrame | None = None
) -> DataFrame:
    """Row of a weight panel on the trading date before the trade date."""
    visible = shift(panel.select("date", "asset", F.col("weight").alias("value")), calendar)
    rows = visible.join(dates.select("date").distinct(), "date", "left_semi").withColumnRenamed("value", "weight")
    return clean(rows) if selected is None else normalize_to_one(_among(clean(rows), selected))


def w_current(selected: DataFrame, drifted: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """Live weights of the selected names scaled to one; before any are held, another rule's weights."""
    live = normalize_to_one(_among(clean(drifted.where(F.lower("asset") != "cash")), selected))
    if first is None:
        return live
    started = live.select("date").distinct()
    return live.unionByName(first.join(started, "date", "left_anti").select("date", "asset", "weight"))


def w_inv_vol(selected: DataFrame, cov: DataFrame) -> DataFrame:
    """Inverse volatility; a lone name takes everything."""
    variance = cov.where(F.col("i") == F.col("j")).select("date", F.col("i").alias("asset"), F.col("cov"))
    names = with_group_totals(selected.select("date", "asset").distinct(), ["date"], _n=F.count(F.lit(1)))
    joined = names.join(variance, ["date", "asset"], "left")
    inverse = F.when(F.col("_n") == 1, F.lit(1.0)).when(F.col("cov") > 0, 1 / F.sqrt(F.when(F.col("cov") > 0, F.col("cov"))))
    return normalize_to_one(joined.withColumn("weight", inverse).where(F.col("weight").isNotNull()))


def w_market_cap(selected: DataFrame, caps: DataFrame, calendar: DataFrame) -> DataFrame:
    """Positive market caps of the date before, scaled to one."""
    visible = shift(caps, calendar).where(F.col("value") > 0).withColumnRenamed("value", "weight")
    return normalize_to_one(_among(visible, selected))


def uniform(seed: int) -> Column:
    """A number in (0, 1) from a seeded hash of (date, asset)."""
    digest = F.md5(F.concat_ws("|", F.col("date").cast("string"), F.col("asset"), F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def w_random(selected: DataFrame, seed: int = 0) -> DataFrame:
    """Uniform on the simplex: exponential variates over their sum."""
    names = selected.select("date", "asset").distinct()
    return normalize_to_one(names.withColumn("weight", -F.log(uniform(seed))))


# ------------------------------------------------------------------ modifiers
def m_scale(weights: DataFrame, k: float) -> DataFrame:
    return clean(weights.withColumn("weight", F.col("weight") * float(k)))


def m_limit_weights(weights: DataFrame, limit: float) -> DataFrame:
    """Cap weights, the excess shared in proportion among the uncapped names.

    Repeated sharing keeps the uncapped names in proportion, so the result is
    min(limit, s w) with one s per date: with the k largest weights capped,
    s = (total - k limit) / (rest), and k is the smallest count for which the
    next weight stays under the cap.  At most total / limit names can be capped.
    """
    if not 0 < limit <= 1:
        raise ValueError("limit must satisfy 0 < limit <= 1")
    placed = ordered_prefix(clean(weights), ["date"], [Ordering("weight", True), Ordering("asset")], {"_upto": F.col("weight")})
    sized = with_group_totals(placed, ["date"], _total=F.sum("weight"), _n=F.count(F.lit(1)))
    # before this row k = _pos - 1 names are capped; the scale then is
    rest = F.col("_total") - (F.col("_upto") - F.col("weight"))
    scale = F.try_divide(F.col("_total") - (F.col("_pos") - 1) * limit, rest)
    fits = scale * F.col("weight") <= limit + TOLERANCE
    chosen = sized.withColumn("_scale", scale).withColumn("_fits", fits)
    per_date = chosen.groupBy("date").agg(F.min_by("_scale", F.when(F.col("_fits"), F.col("_pos"))).alias("_s"))
    joined = sized.join(per_date, "date")
    capped = F.when(F.col("_s").isNotNull(), F.least(F.lit(float(limit)), F.col("_s") * F.col("weight")))
    # a cap below 1/n cannot hold: the weights stay; no uncapped name left: nothing remains
    value = F.when(F.lit(float(limit)) < 1 / F.col("_n"), F.col("weight")).otherwise(capped)
    return clean(joined.withColumn("weight", value))


def _bounded(rows: DataFrame, limit: float) -> DataFrame:
    """Weights kept within ``limit`` of ``_base`` and scaled to a total of one.

    ``rows`` is (date, asset, weight, _base).  Clipping and rescaling in turn
    only ever moves one way after the first clip: above one the weights shrink
    until some rest on their floor, below one they grow until some rest on their
    ceiling.  The limit of that repetition is max(s w, floor) or min(s w, ceiling)
    with one s per date, found from running sums in the order in which names
    reach their bound.
    """
    sums = with_group_totals(rows, ["date"], _n=F.count(F.lit(1)), _low=F.sum(F.col("_base") - limit), _high=F.sum(F.col("_base") + limit))
    slack = F.greatest((F.col("_low") - 1) / F.col("_n"), (1 - F.col("_high")) / F.col("_n"), F.lit(0.0))
    limited = sums.withColumn("_l", F.lit(float(limit)) + slack)
    floor, ceiling = F.col("_base") - F.col("_l"), F.col("_base") + F.col("_l")
    clipped = limited.withColumn("_c", F.least(F.greatest(F.col("weight"), floor), ceiling))
    clipped = with_group_totals(clipped, ["date"], _sum=F.sum("_c"))
    shrink = F.col("_sum") > 1
    clipped = clipped.withColumn("_edge", F.when(shrink, floor).otherwise(ceiling)).withColumn("_shrink", shrink)
    # the scale at which a name reaches its bound; first to reach it first
    reach = F.when(F.col("_c") > 0, F.col("_edge") / F.when(F.col("_c") > 0, F.col("_c")))
    reach = F.when(F.col("_shrink"), F.coalesce(reach, F.lit(-1e300))).otherwise(F.coalesce(reach, F.lit(1e300)))
    order = F.when(F.col("_shrink"), -reach).otherwise(reach)
    placed = ordered_prefix(
        clipped.withColumn("_reach", reach).withColumn("_order", order),
        ["date"],
        [Ordering("_order"), Ordering("asset")],
        {"_at_edge": F.col("_edge"), "_used": F.col("_c")},
    )
    # with the names before this one on their bound, the others share what is left
    left = 1 - (F.col("_at_edge") - F.col("_edge"))
    rest = F.col("_sum") - (F.col("_used") - F.col("_c"))
    scale = F.try_divide(left, rest)
    fits = F.when(F.col("_shrink"), scale >= F.col("_reach") - TOLERANCE).otherwise(scale <= F.col("_reach") + TOLERANCE)
    chosen = placed.withColumn("_scale", scale).withColumn("_fits", fits & (rest > 0))
    per_date = chosen.groupBy("date").agg(F.min_by("_scale", F.when(F.col("_fits"), F.col("_pos"))).alias("_s"))
    joined = placed.join(per_date, "date")
    scaled = F.col("_s") * F.col("_c")
    moved = F.when(F.col("_shrink"), F.greatest(scaled, F.col("_edge"))).otherwise(F.least(scaled, F.col("_edge")))
    # no scale fits: every name rests on its bound; a total that is not positive is left alone
    value = F.when(F.col("_sum") <= 0, F.col("_c")).otherwise(F.coalesce(moved, F.col("_edge")))
    return clean(joined.withColumn("weight", value))


def m_limit_deltas(weights: DataFrame, current: DataFrame, limit: float = 0.1) -> DataFrame:
    """Keep changes against the current weights within the limit, relaxed where it cannot hold.

    For weights that are not negative against a book that is at most fully
    invested; a name without a current weight starts at zero.
    """
    base = current.select("date", "asset", F.col("weight").alias("_base"))
    rows = clean(weights).join(base, ["date", "asset"], "left").withColumn("_base", F.coalesce("_base", F.lit(0.0)))
    return _bounded(rows, limit)


def m_limit_benchmark(weights: DataFrame, benchmark: DataFrame, limit: float, selected: DataFrame | None = None) -> DataFrame:
    """Keep deviations from the benchmark within the limit.

    The benchmark is restricted to the selected names and scaled to one (equal
    weights when its total is not positive); names outside it are dropped, names
    without a target start at zero.
    """
    rows = benchmark.where(F.col("weight").isNotNull()).select("date", "asset", F.col("weight").alias("_base"))
    if selected is not None:
        rows = _among(rows, selected)
    rows = rows.join(weights.select("date").distinct(), "date", "left_semi")
    sized = with_group_totals(rows, ["date"], _t=F.sum("_base"), _k=F.count(F.lit(1)))
    scaled = F.when(F.col("_t") > 0, F.col("_base") / F.when(F.col("_t") > 0, F.col("_t"))).otherwise(1 / F.col("_k"))
    base = sized.select("date", "asset", scaled.alias("_base"))
    joined = base.join(clean(weights), ["date", "asset"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return _bounded(joined, limit)


def long_short_combine(
    longs: DataFrame, shorts: DataFrame, long_exposure: float = 1.0, short_exposure: float = 1.0
) -> DataFrame:
    """Signed book on every date either sleeve speaks, the other's last word carried forward."""
    spoken = (
        longs.select("date").distinct().withColumn("_l", F.col("date")).withColumn("_s", F.lit(None).cast("date"))
        .unionByName(shorts.select("date").distinct().withColumn("_s", F.col("date")).withColumn("_l", F.lit(None).cast("date")))
        .groupBy("date")
        .agg(F.max("_l").alias("_l"), F.max("_s").alias("_s"))
    )
    # one row per emission date
    until = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    carried = cut_lineage(
        spoken.select("date", F.last("_l", True).over(until).alias("_l"), F.last("_s", True).over(until).alias("_s"))
    )

    def leg(sleeve: DataFrame, column: str, factor: float) -> DataFrame:
        rows = sleeve.select(F.col("date").alias(column), "asset", (F.col("weight") * factor).alias("weight"))
        return rows.join(carried.select("date", column), column).select("date", "asset", "weight")

    both = leg(longs, "_l", float(long_exposure)).unionByName(leg(shorts, "_s", -float(short_exposure)))
    return clean(both.groupBy("date", "asset").agg(F.sum("weight").alias("weight")))


def transition_schedule(targets: DataFrame, calendar: DataFrame, n: int = 10) -> DataFrame:
    """Approach each target in n equal steps, one per trading date, the first on its own date.

    A new target takes over from where the old one had got to; a name it does
    not list is dropped.  Drift between steps is not modelled.
    """
    line = Window.orderBy("pos")
    turns = targets.select("date").distinct().join(calendar.select("date", "pos", "last"), "date")
    turns = cut_lineage(
        turns.select(
            "date",
            "pos",
            F.row_number().over(line).alias("_turn"),
            F.least(F.lead("pos").over(line), F.col("last") + 1).alias("_next"),
            F.col("last"),
        )
    )
    reached = F.coalesce("_next", F.col("last") + 1) - F.col("pos")
    rows = targets.join(turns.withColumn("_steps", F.least(reached, F.lit(n))), "date")
    # where each name stands when its target arrives: from nothing if the target before did not list it
    listed = F.lag("_turn").over(Window.partitionBy("asset").orderBy("_turn")) == F.col("_turn") - 1
    rows = rows.select("asset", "_turn", "pos", "_steps", "weight", F.coalesce(listed, F.lit(False)).alias("_listed"))
    share = F.col("_steps") / F.lit(n)
    moved = affine_scan(rows, ["asset"], "_turn", F.when(F.col("_listed"), 1 - share).otherwise(0.0), share * F.col("weight"), before="_at")
    origin = F.when(F.col("_listed"), F.col("_at")).otherwise(0.0)
    steps = moved.select(
        "asset", "pos", origin.alias("origin"), F.col("weight").alias("goal"), F.explode(F.sequence(F.lit(1), F.col("_steps"))).alias("_k")
    )
    placed = steps.select(
        "asset",
        (F.col("pos") + F.col("_k") - 1).alias("pos"),
        (F.col("origin") + (F.col("goal") - F.col("origin")) * F.col("_k") / n).alias("weight"),
    )
    return clean(placed.join(calendar.select("date", "pos"), "pos"))


def portfolio_sharpe(weights: DataFrame, expected: DataFrame, cov: DataFrame, rf: float = 0.0) -> DataFrame:
    """Expected excess return over volatility, per date.

    Of the covariances the pairs with i <= j are read; each stands for both orders.
    """
    gain = weights.join(expected, ["date", "asset"]).groupBy("date").agg(
        F.sum(F.col("weight") * F.col("expected_return")).alias("_gain")
    )
    left = weights.select("date", F.col("asset").alias("i"), F.col("weight").alias("_wi"))
    right = weights.select("date", F.col("asset").alias("j"), F.col("weight").alias("_wj"))
    cells = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    risk = (
        cov.where("i <= j")
        .join(left, ["date", "i"])
        .join(right, ["date", "j"])
        .groupBy("date")
        .agg(F.sum(cells * F.col("_wi") * F.col("cov") * F.col("_wj")).alias("_risk"))
    )
    ratio = F.when(F.col("_risk") > 0, (F.col("_gain") - rf) / F.sqrt(F.when(F.col("_risk") > 0, F.col("_risk"))))
    return gain.join(risk, "date").select("date", ratio.alias("sharpe"))
