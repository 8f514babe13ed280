"""Addresses, locations and market codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.text import col

# fixed values: address formats by country
FULL_FORMATS = {
    "UNITED STATES": "{street}, {city}, {state}, {zip}, {country}",
    "SINGAPORE": "{street}, {city}, {zip}, {country}",
    "BERMUDA": "{street}, {city}, {zip}, {country}",
    "CANADA": "{street}, {city}, {state} {zip}, {country}",
    "UNITED KINGDOM": "{street}, {city}, {zip}, {country}",
    "IRELAND": "{street}, {city}, {zip}, {country}",
    "NETHERLANDS": "{street}, {zip} {city}, {country}",
    "SWITZERLAND": "{street}, {zip} {city}, {country}",
    "LUXEMBOURG": "{street}, {zip} {city}, {country}",
    "FINLAND": "{street}, {zip} {city}, {country}",
    "CAYMAN ISLANDS": "{street}, {city}, {zip}, {country}",
    "FRANCE": "{street}, {zip} {city}, {country}",
    "ITALY": "{street}, {zip} {city}, {country}",
    "DENMARK": "{street}, {zip} {city}, {country}",
    "TAIWAN": "{street}, {city}, {zip}, {country}",
}
FULL_DEFAULT = "{street}, {city}, {state}, {zip}, {country}"

# fixed values: formats without the street
FALLBACK_FORMATS = {
    "UNITED STATES": "{city}, {state}, {zip}, {country}",
    "SINGAPORE": "{city}, {zip}, {country}",
    "BERMUDA": "{city}, {zip}, {country}",
    "CANADA": "{city}, {state}, {zip}, {country}",
    "UNITED KINGDOM": "{city}, {zip}, {country}",
    "IRELAND": "{city}, {zip}, {country}",
    "NETHERLANDS": "{zip} {city}, {country}",
    "SWITZERLAND": "{zip} {city}, {country}",
    "LUXEMBOURG": "{zip} {city}, {country}",
    "FINLAND": "{zip} {city}, {country}",
    "CAYMAN ISLANDS": "{city}, {zip}, {country}",
    "FRANCE": "{zip} {city}, {country}",
    "ITALY": "{zip} {city}, {country}",
    "DENMARK": "{zip} {city}, {country}",
    "TAIWAN": "{city}, {zip}, {country}",
}
FALLBACK_DEFAULT = "{city}, {zip}, {country}"

# fixed values: locations that mean the United States
US_LOCATIONS = ["united states", "united states of america", "usa", "us"]

# fixed values: location -> (code kind, code), in order of preference
MARKET_CODES = {
    "united states": [("micCode", "XNYS"), ("micCode", "XNAS"), ("exchCode", "US")],
    "united states of america": [("micCode", "XNYS"), ("micCode", "XNAS"), ("exchCode", "US")],
    "usa": [("micCode", "XNYS"), ("micCode", "XNAS"), ("exchCode", "US")],
    "us": [("micCode", "XNYS"), ("micCode", "XNAS"), ("exchCode", "US")],
    "canada": [("micCode", "XTSE"), ("exchCode", "CN"), ("exchCode", "CA")],
    "netherlands": [("micCode", "XAMS"), ("exchCode", "NA")],
    "united kingdom": [("micCode", "XLON"), ("exchCode", "LN")],
    "france": [("micCode", "XPAR"), ("exchCode", "FP")],
    "germany": [("micCode", "XETR"), ("exchCode", "GY")],
    "switzerland": [("micCode", "XSWX"), ("exchCode", "SE")],
    "japan": [("micCode", "XTKS"), ("exchCode", "JP")],
    "hong kong": [("micCode", "XHKG"), ("exchCode", "HK")],
    "australia": [("micCode", "XASX"), ("exchCode", "AU")],
}


def normalize_zip(c: Column | str) -> Column:
    """Postal code without its extension."""
    text = col(c)
    return F.when(text.contains("-"), F.trim(F.split_part(text, F.lit("-"), F.lit(1)))).otherwise(text)


def is_us(location: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(location))).isin(US_LOCATIONS), F.lit(False))


def _render(pattern: str, parts: dict[str, Column]) -> Column:
    """A format text as one concat of literals and columns."""
    pieces: list[Column] = []
    rest = pattern
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            pieces.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        pieces.append(parts[name])
    return F.concat(*pieces)


def _by_country(formats: dict[str, str], default: str, parts: dict[str, Column]) -> Column:
    country = F.upper(F.trim(parts["country"]))
    grouped: dict[str, list[str]] = {}
    for name, pattern in formats.items():
        grouped.setdefault(pattern, []).append(name)
    out = None
    for pattern, names in grouped.items():
        text = _render(pattern, parts)
        out = F.when(country.isin(names), text) if out is None else out.when(country.isin(names), text)
    return out.otherwise(_render(default, parts))


def address(level: str, street="ADDRESS1", city="CITY", state="STATE", postal="ZIP", country="COUNTRY") -> Column:
    """Country-aware address text at one of three precisions: full, fallback, city."""
    parts = {
        "street": F.coalesce(col(street), F.lit("")),
        "city": F.coalesce(col(city), F.lit("")),
        "state": F.coalesce(col(state), F.lit("")),
        "zip": F.coalesce(normalize_zip(postal), F.lit("")),
        "country": F.coalesce(col(country), F.lit("")),
    }
    if level == "full":
        return _by_country(FULL_FORMATS, FULL_DEFAULT, parts)
    if level == "fallback":
        raw = F.split(_by_country(FALLBACK_FORMATS, FALLBACK_DEFAULT, parts), ",")
        kept = F.filter(F.transform(raw, lambda p: F.trim(p)), lambda p: p != "")
        return F.array_join(kept, ", ")
    if level == "city":
        known = (parts["city"] != "") & (parts["country"] != "")
        return F.when(known, F.concat(parts["city"], F.lit(", "), parts["country"]))
    raise ValueError("level must be full, fallback or city")


def market_hints(spark: SparkSession) -> DataFrame:
    """Dimension table (location, rank, kind, code); a few dozen literal rows."""
    rows = [
        (location, rank, kind, code)
        for location, codes in MARKET_CODES.items()
        for rank, (kind, code) in enumerate(codes)
    ]
    return spark.createDataFrame(rows, "location string, rank int, kind string, code string")


def with_market_hints(df: DataFrame, location: str = "LOCATION") -> DataFrame:
    """One row per market hint of a row's location, ending with the empty hint."""
    table = market_hints(df.sparkSession)
    hints = F.broadcast(
        table.groupBy("location").agg(
            F.sort_array(F.collect_list(F.struct("rank", "kind", "code"))).alias("_hints")
        )
    )
    key = F.lower(F.trim(F.coalesce(F.col(location), F.lit(""))))
    empty = F.array(F.struct(F.lit(None).cast("int").alias("rank"), F.lit("").alias("kind"), F.lit("").alias("code")))
    joined = df.withColumn("_key", key).join(hints.withColumnRenamed("location", "_key"), "_key", "left")
    listed = F.when(F.col("_hints").isNull(), empty).otherwise(F.concat("_hints", empty))
    return joined.select(*df.columns, F.posexplode(listed).alias("HINT_RANK", "_hint")).select(
        *df.columns, "HINT_RANK", F.col("_hint.kind").alias("CODE_KIND"), F.col("_hint.code").alias("CODE")
    )
