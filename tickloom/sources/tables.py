"""The table-read API: one generic read and a named function per dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.filters import date_filter, in_filter, security_filter
from tickloom.operators.snapshots import latest_date_rows, latest_row
from tickloom.sources.catalog import DATASETS, ESTIMATES, LATEST_FIRST, ROW, STATEMENTS, MarketTables


def scan_table(source: MarketTables, name: str) -> DataFrame:
    """The whole table."""
    return source.table(name)


def scan_filtered(source: MarketTables, name: str, tickers=None, figis=None, start=None, end=None) -> DataFrame:
    """The table with security and inclusive date predicates, all pushed to the scan."""
    dataset = DATASETS[name]
    df = security_filter(source.table(name), tickers, figis)
    return date_filter(df, dataset.date, start, end)


def read_dataset(
    source: MarketTables,
    name: str,
    tickers=None,
    figis=None,
    start_date=None,
    end_date=None,
    get_latest: bool = False,
    extra: dict[str, Sequence[str]] | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Filtered rows of a dataset, or its newest rows per key.

    ``extra`` adds column lists (index, strategy, name).  The newest date is
    taken among the filtered rows, except for a ``LATEST_FIRST`` dataset, where
    the security filter follows.
    """
    dataset = DATASETS[name]
    df = source.table(name)
    missing = [c for c in dataset.required if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks columns {missing}")
    for column in dataset.dates:
        if column in df.columns and dict(df.dtypes)[column] == "string":
            df = df.withColumn(column, F.col(column).try_cast("date"))
    df = date_filter(df, dataset.date, start_date, end_date)
    for column, values in (extra or {}).items():
        df = in_filter(df, column, values)
    if get_latest and dataset.latest == LATEST_FIRST:
        return security_filter(latest_date_rows(df, dataset.keys, dataset.date), tickers, figis)
    df = security_filter(df, tickers, figis)
    if not get_latest:
        return df
    if dataset.latest == ROW:
        return latest_row(df, dataset.keys, dataset.date, ties)
    return latest_date_rows(df, dataset.keys, dataset.date)


def _reader(table: str):
    def read(source, tickers=None, figis=None, start_date=None, end_date=None, get_latest=False, ties=()):
        return read_dataset(source, table, tickers, figis, start_date, end_date, get_latest, ties=ties)

    read.__name__ = f"get_{table}"
    read.__doc__ = f"Filtered or newest rows of ``{table}``."
    return read


get_prices = _reader("prices")
get_analyst_price_targets = _reader("analyst_price_targets")
get_company_info = _reader("company_info")
get_officers = _reader("officers")
get_eps_revisions = _reader("eps_revisions")
get_earnings_surprises = _reader("earnings_surprises")
get_options = _reader("options")
get_institutional_holders = _reader("institutional_holders")
get_major_holders = _reader("major_holders")
get_insider_transactions = _reader("insider_transactions")
get_analyst_recommendations = _reader("analyst_recommendations")
get_analyst_upgrades_downgrades = _reader("analyst_upgrades_downgrades")
get_eps_estimates = _reader("eps_estimates")
get_revenue_estimates = _reader("revenue_estimates")
get_growth_estimates = _reader("growth_estimates")


def get_security_master(source, names=None, tickers=None, figis=None, start_date=None, end_date=None, get_latest=False):
    """Master rows, with a filter on the trimmed NAME."""
    wanted = [n.strip() for n in ([names] if isinstance(names, str) else names or [])]
    return read_dataset(
        source, "security_master", tickers, figis, start_date, end_date, get_latest, extra={"NAME": wanted}
    )


def get_index_holdings(source, indices=None, tickers=None, figis=None, start_date=None, end_date=None, get_latest=False):
    """Index members; the newest date is that of the index, before the security filter."""
    wanted = [indices] if isinstance(indices, str) else indices
    return read_dataset(
        source, "holdings", tickers, figis, start_date, end_date, get_latest, extra={"INDEX": wanted or []}
    )


def get_llm_holdings(source, llms=None, tickers=None, figis=None, start_date=None, end_date=None, get_latest=False):
    """Strategy members; the newest date is taken among the filtered rows."""
    wanted = [llms] if isinstance(llms, str) else llms
    return read_dataset(
        source, "llm", tickers, figis, start_date, end_date, get_latest, extra={"STRATEGY": wanted or []}
    )


def get_fundamentals(source, statement_type, annual=True, **filters):
    """One of the eight statement tables."""
    if statement_type not in STATEMENTS:
        raise ValueError(f"statement_type must be one of {STATEMENTS}")
    return read_dataset(source, f"{statement_type}_{'annual' if annual else 'quarterly'}", **filters)


def get_estimates(source, kind, **filters):
    if kind not in ESTIMATES:
        raise ValueError(f"kind must be one of {ESTIMATES}")
    return read_dataset(source, f"{kind}_estimates", **filters)


def get_economic_data(source, tickers=None, start_date=None, end_date=None):
    """Macro observations with all their vintages, by observation date."""
    return read_dataset(source, "fred_economic_data", tickers, None, start_date, end_date)


def get_economic_metadata(source, tickers=None, start_date=None, end_date=None):
    """Series catalogue, by observation start."""
    return read_dataset(source, "fred_series", tickers, None, start_date, end_date)
