"""Incremental jobs: diff-and-append, duplicate removal, latest row per key."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructField, StructType

from tickloom.operators.diff import diff_rows, existing_for
from tickloom.session import checkpoint_root


BUCKETS = 16


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet folder or file as a stream, with the schema of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    folder, _, name = path.rpartition("/")
    if name.endswith(".parquet"):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def stream_diff_append(
    stream: DataFrame,
    table_path: str,
    checkpoint: str,
    exclude: Sequence[str] = ("DATE",),
    keys: Sequence[str] = (),
) -> DataStreamWriter:
    """Append the new or changed rows of every micro-batch to a Parquet table.

    Each batch writes its own ``_batch`` partition and replaces it when it is
    run again, so a batch repeated after a failure leaves the table unchanged;
    the comparison ignores what an earlier attempt of the same batch wrote.
    Given ``keys``, the table is partitioned by a bucket of them, and a batch
    reads only the buckets it has rows for, and of them its keys' rows.
    """
    fields = [StructField("_bucket", LongType()), StructField("_batch", LongType())]
    schema = StructType([*stream.schema.fields, *fields])
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) if keys else F.lit(0).cast("long")

    def write(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumn("_bucket", bucket)
        buckets = [r[0] for r in placed.select("_bucket").distinct().collect()]  # at most BUCKETS
        table = batch.sparkSession.read.schema(schema).parquet(table_path)
        stored = table.where(F.col("_bucket").isin(buckets) & (F.col("_batch") != batch_id)).drop("_bucket", "_batch")
        if keys:
            stored = existing_for(stored, batch, keys)
        fresh = diff_rows(batch, stored, exclude=exclude).withColumn("_bucket", bucket)
        fresh.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").partitionBy("_bucket", "_batch").option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(table_path)

    # the first batch needs a folder to compare with
    stream.sparkSession.createDataFrame([], schema).write.mode("ignore").parquet(table_path)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_dedup(stream: DataFrame, keys: Sequence[str], event_time: str, lateness: str) -> DataFrame:
    """Drop repeated keys that arrive within the lateness bound; the state stays that small."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(list(keys))


def stream_latest(
    stream: DataFrame, keys: Sequence[str], event_time: str, tie: str, columns: Sequence[str] = ()
) -> DataFrame:
    """(keys, event_time, tie, columns) of the latest row per key, maintained as an update stream.

    Among equal times the larger ``tie``, of any ordered type, is later; rows
    equal in both are told apart by ``columns``.  A row without time is older
    than any with one.  The state is one row per key.
    """
    row = F.struct(event_time, tie, *columns)
    return stream.groupBy(*keys).agg(F.max(row).alias("_row")).select(*keys, "_row.*")


# ------------------------------------------------------------------ replays over the given events
def _replay(spark: SparkSession, sf_dir: str, start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """The events through a stream job, landed by thirds of the month; each third is one micro-batch.

    A third lands in as many files as tasks read it, and the job runs on from
    its checkpoint until it has taken them all.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = _folder(spark, "landed")
    for third in range(3):
        events.where(F.floor((F.dayofmonth("ts") - 1) / 11) == third).write.mode("append").parquet(folder)
        start(stream_table(spark, folder)).trigger(availableNow=True).start().awaitTermination()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def replay_diff_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the append job; the resulting table."""
    table, state = _folder(spark, "append"), _folder(spark, "append-state")

    def start(events: DataFrame) -> DataStreamWriter:
        rows = events.select(
            F.col("ts").cast("date").alias("DATE"),
            F.concat(F.lit("U"), F.col("user_id")).alias("TICKER"),
            F.col("event_type").alias("KIND"),
            F.col("value").alias("VALUE"),
        )
        return stream_diff_append(rows, table, state, keys=["TICKER"])

    _replay(spark, sf_dir, start)
    return spark.read.parquet(table).drop("_bucket", "_batch")


def replay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the duplicate filter on (ticker, day); the resulting table."""
    table, state = _folder(spark, "dedup"), _folder(spark, "dedup-state")

    def start(events: DataFrame) -> DataStreamWriter:
        rows = events.select(
            F.concat(F.lit("U"), F.col("user_id")).alias("TICKER"),
            F.col("ts").cast("date").alias("DATE"),
            F.col("ts").cast("timestamp").alias("at"),
        )
        kept = stream_dedup(rows, ["TICKER", "DATE"], "at", "2 days").drop("at")
        return kept.writeStream.format("parquet").option("path", table).option("checkpointLocation", state)

    _replay(spark, sf_dir, start)
    return spark.read.parquet(table)


def replay_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the latest-row job; the last state of each key."""
    table, state = _folder(spark, "latest"), _folder(spark, "latest-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("_batch", F.lit(batch_id).cast("long"))
        stamped.write.mode("overwrite").partitionBy("_batch").option("partitionOverwriteMode", "dynamic").parquet(table)

    def start(events: DataFrame) -> DataStreamWriter:
        rows = events.select(
            F.concat(F.lit("U"), F.col("user_id")).alias("TICKER"), F.col("event_id").alias("SEQ"), F.col("ts").cast("timestamp").alias("ts")
        )
        newest = stream_latest(rows, ["TICKER"], "ts", "SEQ")
        return newest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state)

    _replay(spark, sf_dir, start)
    updates = spark.read.parquet(table)
    last = updates.groupBy("TICKER").agg(F.max("_batch").alias("_batch"))
    return updates.join(last, ["TICKER", "_batch"], "left_semi").select("TICKER", "SEQ", F.col("ts").cast(_time_type(spark, sf_dir)).alias("ts"))


def _time_type(spark: SparkSession, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/events.parquet").schema["ts"].dataType
