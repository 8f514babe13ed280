"""The market-data tables: where they live, their keys and their "latest" rule."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# "Latest" rules
ROW = "one row per key, newest date among the filtered rows"
DATE_ROWS = "every row on the key's newest date among the filtered rows"
LATEST_FIRST = "every row on the key's newest date, then the security filter"


@dataclass(frozen=True)
class Dataset:
    """What a table read needs to know about one table."""

    table: str
    keys: tuple[str, ...] = ("TICKER",)
    date: str = "DATE"
    latest: str = DATE_ROWS
    required: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()


STATEMENTS = ("financial", "balancesheet", "incomestatement", "cashflow")
ESTIMATES = ("eps", "revenue", "growth")

DATASETS: dict[str, Dataset] = {
    d.table: d
    for d in [
        Dataset("prices", latest=ROW, required=("DATE", "TICKER", "ADJ_CLOSE")),
        Dataset("holdings", keys=("INDEX",), latest=LATEST_FIRST),
        Dataset("llm", keys=("STRATEGY",)),
        Dataset("company_info", latest=ROW),
        Dataset("address", keys=("ADDRESS1",), latest=ROW),
        Dataset("officers"),
        Dataset("security_master"),
        Dataset("options", keys=("TICKER", "CONTRACTSYMBOL"), latest=ROW, dates=("EXPIRATION", "LASTTRADEDATE")),
        *[
            Dataset(f"{s}_{period}", keys=("TICKER", "REPORT_DATE"), dates=("REPORT_DATE",))
            for s in STATEMENTS
            for period in ("annual", "quarterly")
        ],
        *[Dataset(f"{e}_estimates", keys=("TICKER", "PERIOD")) for e in ESTIMATES],
        Dataset("eps_revisions", dates=("EARNINGS_DATE",)),
        Dataset("earnings_surprises", dates=("EARNINGS_DATE",)),
        Dataset("analyst_recommendations"),
        Dataset("analyst_upgrades_downgrades", dates=("GRADEDATE",)),
        Dataset("analyst_price_targets"),
        Dataset("insider_transactions"),
        Dataset("institutional_holders", dates=("DATE_REPORTED",)),
        Dataset("major_holders"),
        Dataset("fred_series", date="OBSERVATION_START", latest=ROW),
        Dataset("fred_economic_data", keys=("TICKER", "OBSERVATION_DATE"), date="OBSERVATION_DATE"),
    ]
}


class MarketTables:
    """Resolves a table name to a DataFrame.

    ``tables`` may hold DataFrames, paths, or functions of the session; a
    ``base`` folder serves every other name as ``base/name.parquet``.
    """

    def __init__(
        self,
        spark: SparkSession,
        base: str | None = None,
        tables: Mapping[str, DataFrame | str | Callable[[SparkSession], DataFrame]] | None = None,
    ):
        self.spark = spark
        self.base = base
        self.tables = dict(tables or {})

    def table(self, name: str) -> DataFrame:
        entry = self.tables.get(name)
        if entry is None:
            if self.base is None:
                raise KeyError(f"no table named {name!r}")
            entry = f"{self.base}/{name}.parquet"
        if isinstance(entry, str):
            return self.spark.read.parquet(entry)
        if isinstance(entry, DataFrame):
            return entry
        return entry(self.spark)
