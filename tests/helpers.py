"""Literal frames for tests."""

import datetime

from pyspark.sql import functions as F


def day(text):
    return datetime.date.fromisoformat(text)


def panel(spark, columns, start="2024-03-01"):
    """{asset: [values by day]} as a long panel; None is a missing cell."""
    first = day(start)
    rows = [
        (first + datetime.timedelta(days=i), asset, None if v is None else float(v))
        for asset, values in columns.items()
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "date date, asset string, value double")


def cells(df, value="value"):
    return {(str(r["date"]), r["asset"]): r[value] for r in df.collect()}


def names(df):
    return sorted(r["asset"] for r in df.collect())


def cross(spark, values, column="factor", date="2024-03-01"):
    rows = [(day(date), a, float(v)) for a, v in values.items()]
    return spark.createDataFrame(rows, f"date date, asset string, {column} double")


def pool(df):
    return df.select("date", "asset").where(F.lit(True))
