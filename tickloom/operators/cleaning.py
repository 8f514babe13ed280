"""Normalisation of vendor rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tickloom.functions import text as T
from tickloom.operators.support import finite

# fixed values: company-info fields given in epoch seconds
EPOCH_COLUMNS = [
    "GOVERNANCEEPOCHDATE",
    "COMPENSATIONASOFEPOCHDATE",
    "EXDIVIDENDDATE",
    "DATESHORTINTEREST",
    "LASTFISCALYEAREND",
    "NEXTFISCALYEAREND",
    "MOSTRECENTQUARTER",
    "LASTSPLITDATE",
    "LASTDIVIDENDDATE",
    "POSTMARKETTIME",
    "REGULARMARKETTIME",
    "EARNINGSTIMESTAMP",
    "EARNINGSTIMESTAMPSTART",
    "EARNINGSTIMESTAMPEND",
    "EARNINGSCALLTIMESTAMPSTART",
    "EARNINGSCALLTIMESTAMPEND",
    "NAMECHANGEDATE",
    "IPOEXPECTEDDATE",
]

# fixed values: ticker spellings corrected in index files
TICKER_RENAMES = {
    "LENB": "LEN-B",
    "GEFB": "GEF-B",
    "BRKB": "BRK-B",
    "HEIA": "HEI-A",
    "BFB": "BF-B",
    "UHALB": "UHAL-B",
    "MOGA": "MOG-A",
    "BFA": "BF-A",
    "CWENA": "CWEN-A",
    "GLIBR": "GLIBK",
    "VSNTV UW": "VSNT",
    "VSNT*": "VSNT",
}


def normalize_columns(df: DataFrame) -> DataFrame:
    """Upper-case column names with underscores for spaces."""
    return df.toDF(*[c.upper().replace(" ", "_") for c in df.columns])


def dedupe_column_names(df: DataFrame) -> DataFrame:
    """Number repeated column names: X, X_2, X_3."""
    seen: dict[str, int] = {}
    names = []
    for name in df.columns:
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def to_numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast a text column to double only when every value parses.

    One aggregation decides for all columns and returns a single row.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    texts = [c for c in texts if columns is None or c in columns]
    if not texts:
        return df
    verdict = df.agg(
        *[F.coalesce(F.bool_and(F.col(c).isNull() | F.col(c).try_cast("double").isNotNull()), F.lit(False)).alias(c) for c in texts]
    ).first()
    return df.withColumns({c: F.col(c).cast("double") for c in texts if verdict[c]})


def coerce_datetime(df: DataFrame, columns: Sequence[str], errors: str = "raise") -> DataFrame:
    return df.withColumns({c: T.coerce_datetime(c, errors) for c in columns})


def date_only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: T.date_only(c) for c in columns})


def require_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pass the rows through; the job fails on a null or non-finite value."""
    checked = {}
    for c in columns:
        bad = finite(F.col(c)).isNull()
        checked[c] = F.when(bad, F.raise_error(F.lit(f"{c} has a missing or non-finite value")).cast("double")).otherwise(F.col(c))
    return df.withColumns(checked)


def null_nonfinite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Infinite and NaN values of floating columns become null."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    chosen = [c for c in floats if columns is None or c in columns]
    return df.withColumns({c: finite(F.col(c)) for c in chosen})


def null_tokens(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: T.null_tokens(c) for c in texts if columns is None or c in columns})


def epoch_to_date(df: DataFrame, columns: Sequence[str] = EPOCH_COLUMNS) -> DataFrame:
    return df.withColumns({c: T.epoch_to_date(c) for c in columns if c in df.columns})


def add_ingest_meta(df: DataFrame, ticker: Column | str | None = None, now: Column | None = None) -> DataFrame:
    """Put the load time and the ticker first."""
    stamped = df.withColumn("DATE", F.current_timestamp() if now is None else now)
    if ticker is not None:
        stamped = stamped.withColumn("TICKER", F.lit(ticker) if isinstance(ticker, str) else ticker)
    rest = [c for c in stamped.columns if c not in ("DATE", "TICKER")]
    return stamped.select("DATE", "TICKER", *rest)


def drop_all_null_rows(df: DataFrame, keys: Sequence[str] = ("DATE", "TICKER", "FIGI", "REPORT_DATE")) -> DataFrame:
    """Drop rows without any payload; without payload columns nothing remains."""
    payload = [c for c in df.columns if c not in keys]
    if not payload:
        return df.limit(0)
    return df.na.drop(how="all", subset=payload)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def lists_to_null(df: DataFrame) -> DataFrame:
    """List-valued fields are not stored: their columns stay, empty."""
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    return df.withColumns({c: F.lit(None).cast("string") for c in lists})


def label_estimates(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("ESTIMATE_TYPE", F.lit(kind.upper()))


def statement_to_rows(df: DataFrame, items: Sequence[str], keys: Sequence[str] = ("TICKER", "REPORT_DATE")) -> DataFrame:
    """Line items (ITEM, VALUE) to one row per report date.

    The item list is given, so the pivot needs no extra pass; the first value by
    amount is taken where a feed repeats an item.
    """
    picked = [F.min(F.when(F.col("ITEM") == i, F.col("VALUE"))).alias(i) for i in items]
    return df.groupBy(*keys).agg(*picked)


def union_call_put(calls: DataFrame, puts: DataFrame) -> DataFrame:
    """Both sides of an option chain under one schema."""
    return calls.withColumn("OPTION_TYPE", F.lit("Call")).unionByName(
        puts.withColumn("OPTION_TYPE", F.lit("Put")), allowMissingColumns=True
    )


def explode_officers(df: DataFrame, column: str = "COMPANYOFFICERS", keep: Sequence[str] = ("DATE", "TICKER")) -> DataFrame:
    """One row per entry of a nested officer list."""
    return df.select(*keep, F.explode(column).alias("_officer")).select(*keep, "_officer.*")


def classify_transactions(df: DataFrame, text: str = "TEXT") -> DataFrame:
    return df.withColumn("TRANSACTION", T.classify_transaction(text))


def clean_observations(df: DataFrame) -> DataFrame:
    """Macro observations: missing markers out, typed, upper-case ticker, fixed leading columns."""
    out = df.select(
        F.upper(F.trim("TICKER")).alias("TICKER"),
        F.col("DATE").cast("date").alias("OBSERVATION_DATE"),
        F.col("REALTIME_START").cast("date").alias("REALTIME_START"),
        F.col("REALTIME_END").cast("date").alias("REALTIME_END"),
        T.macro_value("VALUE").alias("VALUE"),
        *[c for c in df.columns if c not in ("TICKER", "DATE", "REALTIME_START", "REALTIME_END", "VALUE")],
    )
    return out.where(F.col("VALUE").isNotNull())


# fixed values: metadata columns the vendor repeats and the table does not keep
METADATA_DROPPED = ["REALTIME_START", "REALTIME_END", "OBSERVATION_END", "LAST_UPDATED"]


def clean_metadata(df: DataFrame) -> DataFrame:
    """Series metadata: ID becomes TICKER, first; bookkeeping columns go."""
    renamed = df.withColumnRenamed("ID", "TICKER").drop(*METADATA_DROPPED)
    renamed = renamed.withColumn("TICKER", F.upper(F.trim("TICKER")))
    return renamed.select("TICKER", *[c for c in renamed.columns if c != "TICKER"])


def vintage_dates(df: DataFrame, column: str = "VINTAGE_DATES") -> DataFrame:
    """One row per vintage date of a series."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(column).alias("_v")).select(*others, F.col("_v").cast("date").alias("VINTAGE_DATE"))


def symbol_variants(df: DataFrame, ticker: str, us: Column) -> DataFrame:
    """One row per spelling of a ticker, in order."""
    return df.select("*", F.posexplode(T.symbol_variants(ticker, us)).alias("VARIANT_RANK", "VARIANT"))
