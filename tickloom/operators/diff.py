"""Row differences, upserts and revision-aware replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.text import signature
from tickloom.operators.snapshots import pick_row

REVISION_COLUMNS = ("TICKER", "OBSERVATION_DATE", "VALUE", "REALTIME_START", "REALTIME_END")


def row_signature(df: DataFrame, columns: Sequence[str]) -> Column:
    """One text per row, equal for rows that mean the same on ``columns``."""
    types = dict(df.dtypes)
    return F.concat_ws("\u0001", *[signature(c, types[c]) for c in columns])


def diff_rows(
    incoming: DataFrame,
    existing: DataFrame,
    exclude: Sequence[str] = ("DATE",),
    compare: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Incoming rows that are new or changed against the stored ones.

    Rows are compared by signature over the shared columns without ``exclude``,
    or over ``compare``.  Rows that repeat inside the batch collapse to the
    first by ``order``, against an empty table too.  Both sides are reduced to
    one row per signature before they meet, so a heavily repeated row cannot
    skew the join.
    """
    excluded = {c.upper() for c in exclude}
    columns = list(compare) if compare else [
        c for c in incoming.columns if c in existing.columns and c.upper() not in excluded
    ]
    if not columns:
        return incoming.distinct()
    signed = incoming.withColumn("_sig", row_signature(incoming, columns))
    ordering = list(order) if order else [c for c in incoming.columns]
    first = pick_row(signed, ["_sig"], [F.col(c) for c in ordering], largest=False)
    stored = existing.select(row_signature(existing, columns).alias("_sig")).distinct()
    return first.join(stored, "_sig", "left_anti").drop("_sig")


def diff_counts(incoming: DataFrame, kept: DataFrame) -> DataFrame:
    """Written and skipped row counts of a diff, one row."""
    seen = incoming.agg(F.count(F.lit(1)).alias("SEEN")).withColumn("WRITTEN", F.lit(0).cast("long"))
    written = kept.agg(F.count(F.lit(1)).alias("WRITTEN")).withColumn("SEEN", F.lit(0).cast("long"))
    total = seen.unionByName(written).agg(F.sum("SEEN").alias("_seen"), F.sum("WRITTEN").alias("WRITTEN"))
    return total.select("WRITTEN", (F.col("_seen") - F.col("WRITTEN")).alias("SKIPPED"))


def existing_for(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows under the keys of the batch; a missing key meets a missing one."""
    wanted = incoming.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return existing.join(wanted, same, "left_semi").select(*existing.columns)


def revision_groups(df: DataFrame) -> DataFrame:
    """Newest vintage per (TICKER, OBSERVATION_DATE); null keys are a group of their own."""
    return df.groupBy(
        F.upper(F.trim("TICKER")).alias("TICKER_KEY"), F.col("OBSERVATION_DATE").alias("OBSERVATION_DATE_KEY")
    ).agg(F.max("REALTIME_START").alias("MAX_REALTIME_START"))


def refresh_actions(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """What to do with each incoming group: insert, replace or keep."""
    new, old = revision_groups(incoming).alias("n"), revision_groups(existing).alias("o")
    same = F.col("n.TICKER_KEY").eqNullSafe(F.col("o.TICKER_KEY")) & F.col("n.OBSERVATION_DATE_KEY").eqNullSafe(
        F.col("o.OBSERVATION_DATE_KEY")
    )
    return new.join(old, same, "left").select(
        "n.TICKER_KEY",
        "n.OBSERVATION_DATE_KEY",
        F.when(F.col("o.MAX_REALTIME_START").isNull(), "insert")
        .when(F.col("n.MAX_REALTIME_START") > F.col("o.MAX_REALTIME_START"), "replace")
        .otherwise("keep")
        .alias("ACTION"),
    )


def refresh_groups(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows of the groups to insert or replace, with the ACTION of their group."""
    rows = incoming.dropDuplicates(list(REVISION_COLUMNS))
    actions = refresh_actions(rows, existing).where(F.col("ACTION") != "keep")
    same = F.upper(F.trim("TICKER")).eqNullSafe(F.col("TICKER_KEY")) & F.col("OBSERVATION_DATE").eqNullSafe(
        F.col("OBSERVATION_DATE_KEY")
    )
    return rows.join(actions, same).select(*rows.columns, "ACTION")


def replace_groups(destination: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The next state of a table: its rows outside the groups of ``rows``, plus ``rows``.

    Produced as one frame, to be written as a new version or by dynamic
    partition overwrite; there is no window in which the group is missing.
    """
    kept = destination.join(rows.select(*keys).distinct(), list(keys), "left_anti")
    return kept.select(*destination.columns).unionByName(rows.select(*destination.columns))


def upsert(destination: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Replace every row of the keys that arrive."""
    return replace_groups(destination, rows, [key])


def reload_keys(destination: DataFrame, fresh: DataFrame, keys: DataFrame, key: str = "TICKER") -> DataFrame:
    """Replace the history of adjusted keys that were stored before by a fresh pull.

    A key that the pull does not bring keeps its stored rows.
    """
    stored = destination.select(key).distinct()
    due = keys.select(key).distinct().join(stored, key, "left_semi").join(fresh.select(key).distinct(), key, "left_semi")
    kept = destination.join(due, key, "left_anti").select(*destination.columns)
    return kept.unionByName(fresh.join(due, key, "left_semi").select(*destination.columns))


def union_all(frames: Sequence[DataFrame], distinct: bool = False) -> DataFrame:
    """Frames stacked by column name; columns a frame lacks are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.distinct() if distinct else out


def merge_latest(older: DataFrame, newer: DataFrame, key: str = "TICKER") -> DataFrame:
    """Union of two caches, the newer row winning per key."""
    both = older.withColumn("_age", F.lit(0)).unionByName(newer.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return pick_row(both, [key], [F.col("_age")]).drop("_age")


def missing_keys(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``want`` that ``have`` lacks."""
    return want.select(key).distinct().join(have.select(key).distinct(), key, "left_anti")


def drop_inactive(selected: DataFrame, *inactive: DataFrame) -> DataFrame:
    """Selection without the rolled and closed names."""
    gone = inactive[0].select("asset")
    for frame in inactive[1:]:
        gone = gone.union(frame.select("asset"))
    return selected.join(gone.distinct(), "asset", "left_anti").select(*selected.columns)
