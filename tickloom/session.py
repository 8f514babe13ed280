"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tickloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume: AQE on, UTC, Arrow on.

    Broadcasts and skew splits are left to adaptive execution, which measures
    a side before it replaces a shuffle join.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written tables, as the session names it in ``spark.checkpoint.dir``.

    Where a local master names none, one of its own serves: driver and tasks
    are one machine there.  On a cluster it must be set.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    named = named or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
        named = tempfile.mkdtemp(prefix="tickloom-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from there.

    A columnar table keeps what a lost executor would have to compute again,
    lets later readers take only their columns and tells the planner its size.
    The tables of a driver are deleted when it ends.
    """
    path = f"{checkpoint_root(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    _written.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def delete_cut_tables() -> None:
    """Delete what ``cut_lineage`` wrote, as long as its session still runs."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is None:
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


atexit.register(delete_cut_tables)
