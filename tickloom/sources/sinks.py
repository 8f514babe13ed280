"""Writes, schema alignment, deletes and write checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.operators.filters import normalized


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 32,
    **options: str,
) -> DataFrame:
    """A relational query as a DataFrame, read in parallel when a column is given."""
    reader = spark.read.format("jdbc").option("url", url)
    for key, value in options.items():
        reader = reader.option(key, value)
    if partition_column is None:
        return reader.option("query", query).load()
    low, high = bounds if bounds else (None, None)
    if low is None or high is None:
        raise ValueError("a partitioned read needs bounds")
    return (
        reader.option("dbtable", f"({query}) q")
        .option("partitionColumn", partition_column)
        .option("lowerBound", str(low))
        .option("upperBound", str(high))
        .option("numPartitions", str(partitions))
        .load()
    )


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, **options: str) -> None:
    """Append to or replace a relational table in batches."""
    writer = df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", str(batch))
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.mode(mode).save()


def write_table(
    df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = (), cluster_by: Sequence[str] = ()
) -> None:
    """Append to or replace a Parquet table.

    Rows are laid out by ``partition_by`` plus ``cluster_by`` before the write so
    that a partition is written by few tasks; an overwrite touches only the
    partitions present in ``df``.
    """
    layout = [*partition_by, *cluster_by]
    if layout:
        # a rebalance lets adaptive execution split a hot partition over many files
        df = df.hint("rebalance", *layout)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def align(df: DataFrame, schema: StructType) -> DataFrame:
    """Shape rows to a destination: missing columns null, extra columns dropped, order and types forced."""
    present = {c.upper(): c for c in df.columns}
    out = []
    for field in schema.fields:
        source = present.get(field.name.upper())
        column = F.col(f"`{source}`").try_cast(field.dataType) if source else F.lit(None).cast(field.dataType)
        out.append(column.alias(field.name))
    return df.select(*out)


def append_evolving(df: DataFrame, destination: DataFrame) -> DataFrame:
    """Destination and new rows together; columns new to the destination are added as text."""
    known = set(destination.columns)
    shaped = df.select(*[F.col(c) if c in known else F.col(c).cast("string").alias(c) for c in df.columns])
    return destination.unionByName(shaped, allowMissingColumns=True)


def delete_where(df: DataFrame, predicate: Column | None) -> DataFrame:
    """The table without the rows the predicate is true for."""
    if predicate is None:
        raise ValueError("a delete needs a predicate")
    return df.where(~F.coalesce(predicate, F.lit(False)))


def missing_keys(payload: DataFrame, destination: DataFrame, ticker: str = "TICKER", date: str = "DATE") -> DataFrame:
    """(ticker, date) pairs of the payload the destination does not hold."""

    def pairs(df):
        return df.select(normalized(ticker).alias(ticker), F.col(date).cast("date").alias(date)).distinct()

    return pairs(payload).join(pairs(destination), [ticker, date], "left_anti")


def validate_write(payload: DataFrame, destination: DataFrame) -> DataFrame:
    """Expected pairs and how many of them are missing, as one row."""
    expected = payload.select(normalized("TICKER").alias("TICKER"), F.col("DATE").cast("date").alias("DATE")).distinct()
    stored = (
        destination.select(normalized("TICKER").alias("TICKER"), F.col("DATE").cast("date").alias("DATE"))
        .distinct()
        .withColumn("_stored", F.lit(True))
    )
    return expected.join(stored, ["TICKER", "DATE"], "left").agg(
        F.count(F.lit(1)).alias("EXPECTED"), F.count_if(F.col("_stored").isNull()).alias("MISSING")
    )


def replace_values(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Rename symbols in one column."""
    return df.replace(dict(mapping), subset=[column])
