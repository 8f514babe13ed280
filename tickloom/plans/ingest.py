"""Ingest jobs: landed vendor rows -> rows to store, one spec per dataset.

A job is a chain of DataFrame transforms over the whole landing batch.  It
returns the rows to append (or, for prices and macro series, the next state of
the table), so that a batch run, a backfill and a stream share it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.places import address
from tickloom.functions.text import blank_to_null
from tickloom.operators import aggregates, cleaning, diff, filters, joins, macro, snapshots
from tickloom.functions.places import is_us
from tickloom.sources.catalog import ESTIMATES, STATEMENTS
from tickloom.session import cut_lineage
from tickloom.sources.sinks import align

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class IngestSpec:
    """How a dataset differs from the common job."""

    dataset: str
    dates: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    prepare: tuple[Transform, ...] = field(default_factory=tuple)
    diff: bool = True


def _insider_rows(df: DataFrame) -> DataFrame:
    out = cleaning.classify_transactions(df) if "TEXT" in df.columns else df
    return out.withColumn("URL", blank_to_null("URL")) if "URL" in out.columns else out


SPECS: dict[str, IngestSpec] = {
    s.dataset: s
    for s in [
        IngestSpec("analyst_price_targets", drop=("CURRENT",)),
        IngestSpec("analyst_recommendations"),
        IngestSpec("analyst_upgrades_downgrades", dates=("GRADEDATE",)),
        *[
            IngestSpec(f"{s}_{p}", dates=("REPORT_DATE",), prepare=(cleaning.drop_all_null_rows,))
            for s in STATEMENTS
            for p in ("annual", "quarterly")
        ],
        IngestSpec("eps_revisions", dates=("EARNINGS_DATE",)),
        IngestSpec("earnings_surprises", dates=("EARNINGS_DATE",)),
        *[
            IngestSpec(f"{e}_estimates", prepare=(lambda df, e=e: cleaning.label_estimates(df, e),))
            for e in ESTIMATES
        ],
        IngestSpec("institutional_holders", dates=("DATE_REPORTED",), drop=("VALUE",)),
        IngestSpec("major_holders", drop=("VALUE",)),
        IngestSpec("insider_transactions", prepare=(_insider_rows,)),
        IngestSpec("options", dates=("EXPIRATION", "LASTTRADEDATE")),
        IngestSpec("company_info", prepare=(cleaning.lists_to_null, cleaning.null_tokens, cleaning.epoch_to_date), diff=False),
        IngestSpec("officers"),
    ]
}


def ingest(dataset: str, landed: DataFrame, existing: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of the batch to append: normalised, identified, new or changed, in table shape."""
    spec = SPECS[dataset]
    rows = cleaning.normalize_columns(landed)
    for transform in spec.prepare:
        rows = transform(rows)
    rows = cleaning.drop_columns(rows, spec.drop)
    rows = cleaning.date_only(rows, [c for c in spec.dates if c in rows.columns])
    rows = joins.map_figi_coalesce(rows, mapping)
    rows = align(rows, existing.schema)
    if not spec.diff:
        return rows
    # only the stored rows of the batch's securities take part in the comparison
    stored = diff.existing_for(existing, rows, ["TICKER", "FIGI"])
    return diff.diff_rows(rows, stored)


def _identified(df: DataFrame, names: DataFrame) -> DataFrame:
    """``df`` with the security each row is about: its FIGI, else the one known for its ticker, else the ticker."""
    known = df.join(names, "TICKER", "left")
    return known.withColumn("_security", F.coalesce("FIGI", "_known", "TICKER")).drop("_known")


def ingest_prices(
    landed: DataFrame, existing: DataFrame, mapping: DataFrame, fresh: DataFrame | None = None
) -> DataFrame:
    """Next state of the price table.

    Rows from each security's next start date are appended; names with a
    corporate action among them that were stored before get their whole history
    from ``fresh``.  Securities are told apart by FIGI, so a renamed ticker
    goes on where the old one ended.
    """
    pairs = mapping.select("TICKER", "FIGI").union(existing.select("TICKER", "FIGI")).where("FIGI IS NOT NULL")
    names = pairs.groupBy("TICKER").agg(F.max("FIGI").alias("_known"))
    rows = joins.map_figi_coalesce(cleaning.date_only(cleaning.normalize_columns(landed), ["DATE"]), mapping)
    rows, stored = _identified(rows, names), _identified(existing, names)
    starts = aggregates.start_dates(rows, stored, "_security")
    due = filters.rows_from_start(rows, starts, "_security")
    shaped = [*existing.columns, "_security"]
    appended = stored.select(shaped).unionByName(align(due, stored.select(shaped).schema))
    if fresh is None:
        return appended.drop("_security")
    actions = filters.adjusted_keys(due, "_security")
    known = actions.join(stored.select("_security").distinct(), "_security", "left_semi")
    pulled = _identified(joins.map_figi_coalesce(fresh, mapping), names)
    return diff.reload_keys(appended, align(pulled, appended.schema), known, "_security").drop("_security")


def ingest_holdings(
    raw: DataFrame,
    master: DataFrame,
    exchanges: Sequence[str],
    load_date,
    bounds: Mapping[str, tuple[int, int]] | None = filters.ROW_BOUNDS,
) -> DataFrame:
    """Raw fund sheets (with INDEX) to member rows with FIGI; appended without a diff.

    An index whose number of rows is out of its bounds fails the job; None checks nothing.
    """
    rows = filters.clean_holdings(raw, exchanges).replace(cleaning.TICKER_RENAMES, subset=["TICKER"])
    numeric = [c for c in aggregates.ROLLUP_SUMS if c in rows.columns]
    rows = rows.withColumns({c: F.col(c).try_cast("double") for c in numeric})
    rows = aggregates.normalize_weights(rows, ["INDEX"])
    rows = rows.withColumn("DATE", F.lit(str(load_date)).cast("date"))
    rolled = aggregates.holdings_rollup(rows)
    out = joins.attach_figi(rolled, snapshots.dedupe_master(master, is_us("LOCATION")))
    if not bounds:
        return out
    passed = filters.check_counts(out, "INDEX", bounds).select("INDEX")
    return out.join(passed, "INDEX", "left_semi")


def ingest_security_master(universe: DataFrame, master: DataFrame) -> DataFrame:
    """Rows to look up and add: the part of the universe the master lacks."""
    return joins.anti_join_universe(universe, master)


def ingest_macro(
    landed: DataFrame, existing: DataFrame, metadata: DataFrame
) -> DataFrame:
    """Next state of the macro table.

    Daily series keep one value per observation date; the others are replaced
    group by group when a newer vintage arrives.
    """
    existing = existing.withColumn("TICKER", filters.normalized("TICKER"))
    routes = macro.split_by_frequency(metadata).select("TICKER", "ROUTE")
    rows = macro.normalise_revised(landed).join(routes, "TICKER", "left")
    daily = F.col("ROUTE") == "daily"
    rows = (
        rows.withColumn("REALTIME_START", F.when(daily, F.col("OBSERVATION_DATE")).otherwise(F.col("REALTIME_START")))
        .withColumn("REALTIME_END", F.when(daily, F.col("OBSERVATION_DATE")).otherwise(F.col("REALTIME_END")))
        .drop("ROUTE")
    )
    due = diff.refresh_groups(rows, existing).drop("ACTION")
    return diff.replace_groups(existing, due, ["TICKER", "OBSERVATION_DATE"])


def ingest_macro_metadata(landed: DataFrame, existing: DataFrame) -> DataFrame:
    """Next state of the series catalogue: changed series replaced by ticker."""
    rows = align(cleaning.clean_metadata(cleaning.normalize_columns(landed)), existing.schema)
    changed = diff.diff_rows(rows, existing, exclude=())
    return diff.upsert(existing, changed, "TICKER")


def ingest_addresses(info: DataFrame, cache: DataFrame) -> DataFrame:
    """Address texts still to be located, from the most to the least precise."""
    new = joins.missing_addresses(info, cache).select("ADDRESS1", "CITY", "STATE", "ZIP", "COUNTRY").distinct()
    return new.select(
        "*",
        address("full").alias("FULL_ADDRESS"),
        address("fallback").alias("FALLBACK_ADDRESS"),
        address("city").alias("CITY_ADDRESS"),
    )


def daily_run(
    landed: dict[str, DataFrame],
    stored: dict[str, DataFrame],
    mapping: DataFrame,
    exchanges: Sequence[str] = (),
    load_date=None,
    bounds: Mapping[str, tuple[int, int]] | None = filters.ROW_BOUNDS,
) -> dict[str, DataFrame]:
    """Every job of a day whose rows have landed, in order.

    Fund holdings come first, as their members extend the identifier map; then
    index prices, the prices of what is held, the vendor datasets, the macro
    tables and the addresses still to be located.  Price and macro tables come
    as their next state, the others as the rows to append.  What later jobs
    read, the holdings, the extended identifiers and the prices, is written to
    the checkpoint folder; the other results are lazy.  The caller writes them one after
    another, and a failed write is repeated without harm because a second run
    finds nothing new.
    """
    out: dict[str, DataFrame] = {}
    if "holdings" in landed:
        out["holdings"] = cut_lineage(ingest_holdings(landed["holdings"], stored["security_master"], exchanges, load_date, bounds))
        members = out["holdings"].where("FIGI IS NOT NULL").select("TICKER", "FIGI")
        both = mapping.select("TICKER", "FIGI").withColumn("_own", F.lit(1)).unionByName(members.withColumn("_own", F.lit(0)))
        mapping = cut_lineage(snapshots.pick_row(both, ["TICKER"], [F.col("_own"), F.col("FIGI")]).select("TICKER", "FIGI"))
    if "security_master" in landed:
        out["security_master"] = ingest_security_master(landed["security_master"], stored["security_master"])
    prices = stored.get("prices")
    for name in ("index_prices", "prices"):
        if name in landed:
            prices = cut_lineage(ingest_prices(landed[name], prices, mapping, landed.get(f"{name}_history")))
            out["prices"] = prices
    for name in SPECS:
        if name in landed:
            out[name] = ingest(name, landed[name], stored[name], mapping)
    if "fred_series" in landed:
        out["fred_series"] = ingest_macro_metadata(landed["fred_series"], stored["fred_series"])
    if "fred_economic_data" in landed:
        out["fred_economic_data"] = ingest_macro(
            landed["fred_economic_data"], stored["fred_economic_data"], out.get("fred_series", stored["fred_series"])
        )
    if "company_info" in landed and "addresses" in stored:
        out["addresses"] = ingest_addresses(landed["company_info"], stored["addresses"])
    return out


def subset_run(
    landed: dict[str, DataFrame], stored: dict[str, DataFrame], mapping: DataFrame, members: DataFrame, extra: DataFrame
) -> dict[str, DataFrame]:
    """A second run, prices included, for the names a strategy holds and the index universe lacks."""
    missing = diff.missing_keys(members, extra, "TICKER")
    per_name = {"prices", "prices_history", *SPECS}
    own = {name: df.join(missing, "TICKER", "left_semi") for name, df in landed.items() if name in per_name}
    return daily_run(own, stored, mapping)
