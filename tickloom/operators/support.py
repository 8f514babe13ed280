"""Shared building blocks: group totals and skew-safe ordered prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import cut_lineage


def finite(value: Column) -> Column:
    """The value where it is an ordinary number, else null."""
    as_double = value.cast("double")
    return F.when(F.isnan(as_double) | (F.abs(as_double) == F.lit(float("inf"))), F.lit(None)).otherwise(as_double)


def with_group_totals(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Attach per-group aggregates.

    Written as aggregate + join rather than an unordered window: the aggregate
    combines on the map side and the join back can be split or broadcast by
    adaptive execution, so one hot group never sits in a single task.
    """
    keys = list(keys)
    per_group = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in totals.items()])
    return df.join(per_group, keys)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a single-row frame (an ungrouped aggregate) to every row: a product with one row."""
    return df.crossJoin(F.broadcast(one_row))


def ordered_prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column] | None = None,
    position: str = "_pos",
) -> DataFrame:
    """Exact 1-based position and inclusive running sums inside each group.

    The rows are range-partitioned by (keys, order), so a group that holds most
    of the data is spread over many partitions, ties included.  Each partition
    piece is numbered on its own and shifted by the totals of the pieces before
    it.  The piece ids are written to a table in the checkpoint folder first: they must not
    change when a lost task is run again.
    """
    keys = list(keys)
    sums = sums or {}
    # ordering columns are evaluated once and carried with the row
    ordered = df
    names = []
    for i, expr in enumerate(order):
        ordered = ordered.withColumn(f"_o{i}", expr_value(expr))
        names.append(apply_direction(f"_o{i}", expr))
    for name, expr in sums.items():
        ordered = ordered.withColumn(f"_s_{name}", F.coalesce(expr.cast("double"), F.lit(0.0)))
    ranged = ordered.repartitionByRange(*[F.col(k) for k in keys], *names)
    pieces = cut_lineage(ranged.withColumn("_piece", F.spark_partition_id()))

    totals = pieces.groupBy(*keys, "_piece").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_s_{s}").alias(f"_t_{s}") for s in sums],
    )
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_piece",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0.0)).alias(f"_t0_{s}") for s in sums],
    )
    local = Window.partitionBy(*keys, "_piece").orderBy(*names)
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    numbered = (
        pieces.withColumn("_rn", F.row_number().over(local))
        .select("*", *[F.sum(f"_s_{s}").over(running).alias(f"_r_{s}") for s in sums])
        .join(offsets, [*keys, "_piece"])
    )
    return numbered.select(
        *df.columns,
        (F.col("_n0") + F.col("_rn")).cast("long").alias(position),
        *[(F.col(f"_t0_{s}") + F.col(f"_r_{s}")).alias(s) for s in sums],
    )


def affine_scan(
    df: DataFrame, keys: Sequence[str], order: str, gain: Column, shift: Column, start: float = 0.0,
    before: str = "_before", block: int = 256,
) -> DataFrame:
    """``df`` with the state ahead of each row; a row turns state y into gain * y + shift.

    Two such steps compose into one, so the rows of a group are cut into blocks
    that are folded on their own; a block starts from the fold of the steps of
    the blocks ahead of it.  The work of a group of n rows follows n and
    (n / block) squared, and one shuffle by the keys serves every step.
    ``order`` tells the rows of a group apart.
    """
    keys = list(keys)
    line = Window.partitionBy(*keys).orderBy(order)
    numbered = df.select(
        *[F.col(k) for k in keys], (F.row_number().over(line) - 1).alias("_n"),
        gain.cast("double").alias("_gain"), shift.cast("double").alias("_shift"),
        F.struct(*[F.col(c) for c in df.columns]).alias("_row"),
    )
    blocks = numbered.groupBy(*keys, F.floor(F.col("_n") / block).alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("_n", "_gain", "_shift", "_row"))).alias("_rows")
    )

    def fold(steps: Column, state: Column) -> Column:
        return F.aggregate(steps, state, lambda y, x: y * x["_gain"] + x["_shift"])

    whole = F.struct(F.aggregate("_rows", F.lit(1.0), lambda g, x: g * x["_gain"]).alias("_gain"), fold(F.col("_rows"), F.lit(0.0)).alias("_shift"))
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    opened = blocks.withColumn("_whole", whole).withColumn("_y", fold(F.collect_list("_whole").over(ahead), F.lit(float(start))))
    # the states inside a block, the one ahead of its first row first
    states = F.aggregate(
        "_rows", F.array("_y"), lambda ys, x: F.concat(ys, F.array(F.element_at(ys, -1) * x["_gain"] + x["_shift"]))
    )
    paired = F.transform("_rows", lambda x, i: F.struct(x["_row"].alias("_row"), F.get("_states", i).alias("_y")))
    rows = opened.withColumn("_states", states).select(F.explode(paired).alias("_pair"))
    return rows.select("_pair._row.*", F.col("_pair._y").alias(before))


class Ordering:
    """A column with a direction, kept apart so both halves can be reused."""

    def __init__(self, column: Column | str, descending: bool = False):
        self.column = F.col(column) if isinstance(column, str) else column
        self.descending = descending


def expr_value(item) -> Column:
    return item.column if isinstance(item, Ordering) else (F.col(item) if isinstance(item, str) else item)


def apply_direction(name: str, item) -> Column:
    if isinstance(item, Ordering) and item.descending:
        return F.col(name).desc_nulls_last()
    return F.col(name).asc_nulls_last()


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, probabilities: dict[str, float]
) -> DataFrame:
    """Linear-interpolation quantiles per group, exact for groups of any size.

    Takes the two neighbouring order statistics by position instead of holding
    a group's values in one aggregation buffer.
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull()).select(*keys, value, tie)
    placed = ordered_prefix(present, keys, [Ordering(value), Ordering(tie)], position="_p")
    sized = with_group_totals(placed, keys, _size=F.count(F.lit(1)))
    aggregates = []
    for name, q in probabilities.items():
        at = (F.col("_size") - 1) * F.lit(q) + 1
        low = F.max(F.when(F.col("_p") == F.floor(at), F.col(value)))
        high = F.max(F.when(F.col("_p") == F.ceil(at), F.col(value)))
        share = F.max(at - F.floor(at))
        aggregates.append((low + (high - low) * share).alias(name))
    return sized.groupBy(*keys).agg(*aggregates)
