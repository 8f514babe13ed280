"""XML spreadsheets through the built-in XML source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

_CELL = StructType([
    StructField("_ss:Index", LongType()),
    StructField("ss:Data", StructType([StructField("_VALUE", StringType()), StructField("_ss:Type", StringType())])),
])
_ROW = StructType([StructField("ss:Cell", ArrayType(_CELL))])
_TABLE = StructType([StructField("ss:Row", ArrayType(_ROW))])
_SHEET = StructType([StructField("_ss:Name", StringType()), StructField("ss:Table", _TABLE)])


def _name(text: Column) -> Column:
    """Column name of a header cell."""
    return F.replace(F.replace(F.upper(F.trim(F.coalesce(text, F.lit("")))), F.lit(" "), F.lit("_")), F.lit("_(%)"), F.lit(""))


def _plain(name: str) -> str:
    return name.strip().upper().replace(" ", "_").replace("_(%)", "")


def read_sheet(spark: SparkSession, path: str, sheet: int = 0, skip: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Sheet ``sheet`` of a spreadsheet, after ``skip`` rows, under its header row.

    The header is each file's first remaining row; only the distinct column
    names reach the driver.  A fund sheet is a few thousand rows; many files are
    read in parallel, one file per task.
    """
    sheets = (
        spark.read.format("xml")
        .schema(_SHEET)
        .option("rowTag", "ss:Worksheet")
        .load(path)
        .withColumn("_file", F.input_file_name())
        .withColumn("_id", F.monotonically_increasing_id())
    )
    # sheets of one file keep their order in the increasing id
    first = sheets.groupBy("_file").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))
    chosen = sheets.join(first, "_file").where(F.col("_id") == F.try_element_at("_ids", F.lit(sheet + 1)))
    rows = chosen.select("_file", F.posexplode(F.col("ss:Table.`ss:Row`")).alias("_row", "_cells"))
    texts = rows.select(
        "_file",
        "_row",
        F.transform(F.col("_cells.`ss:Cell`"), lambda c: F.trim(c["ss:Data"]["_VALUE"])).alias("_texts"),
    ).where(F.col("_row") >= skip)
    body = texts.where(F.col("_row") > skip)
    if columns is not None:
        return body.select(*[F.try_element_at("_texts", F.lit(i + 1)).alias(_plain(c)) for i, c in enumerate(columns)])
    # every file under its own header; the columns are all files' names, in the order they stand in
    heads = texts.where(F.col("_row") == skip).select("_file", F.transform("_texts", _name).alias("_head"))
    found = heads.select(F.posexplode("_head").alias("at", "name")).where("name <> ''").groupBy("name").agg(F.min("at").alias("at"))
    names = [r["name"] for r in found.orderBy("at", "name").collect()]
    named = body.join(heads, "_file")
    return named.select(*[F.get("_texts", F.array_position("_head", F.lit(n)).cast("int") - 1).alias(n) for n in names])
