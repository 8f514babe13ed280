"""Text, null-token and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: texts that stand for a missing value
NULL_TOKENS = ["nan", "none", "nat", "null", ""]
INFO_NULL_TOKENS = ["nan", "none", ""]
MACRO_NULL_TOKENS = ["", ".", "nan", "None", "none", "<NA>"]
# what every text that casts to double starts with: a digit, a point and a digit, inf or nan
_NUMBER_START = r"^[\x00-\x20]*[+-]?(\.?[0-9]|[iI][nN][fF]|[nN][aA][nN])"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_tokens(c: Column | str, tokens: list[str] = INFO_NULL_TOKENS) -> Column:
    """Null where the trimmed, lower-case text is a missing-value token."""
    text = col(c)
    return F.when(F.lower(F.trim(text)).isin(tokens), F.lit(None)).otherwise(text)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def macro_value(c: Column | str) -> Column:
    """A vendor number: its missing markers and anything unparsable become null."""
    text = F.trim(col(c).cast("string"))
    value = F.when(text.isin(MACRO_NULL_TOKENS), F.lit(None)).otherwise(text).try_cast("double")
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def epoch_to_date(c: Column | str) -> Column:
    """Epoch seconds, number or text, to a date."""
    return F.to_date(F.timestamp_seconds(col(c).try_cast("double").cast("long")))


def coerce_datetime(c: Column | str, errors: str = "raise") -> Column:
    """Text to a timestamp without zone: a zone label is dropped, the wall clock kept."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), r"(Z|[+-]\d{2}:?\d{2})$", "")
    parsed = text.try_cast("timestamp_ntz")
    if errors == "coerce":
        return parsed
    broken = parsed.isNull() & col(c).isNotNull()
    return F.when(broken, F.raise_error(F.concat(F.lit("not a date: "), text)).cast("timestamp_ntz")).otherwise(parsed)


def date_only(c: Column | str) -> Column:
    return F.to_date(col(c))


def classify_transaction(c: Column | str) -> Column:
    """Insider transaction class of a free text.  The later a word stands in the
    rule list the stronger it is, hence the strongest is tested first."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    # fixed values: word -> class, strongest first
    rules = [
        ("purchase", "BUY"),
        ("conversion", "CONVERSION"),
        ("grant", "GRANT"),
        ("gift", "GIFT"),
        ("sale", "SELL"),
    ]
    out = None
    for word, label in rules:
        test = text.contains(word)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("BUY")


def signature(c: Column | str, data_type: str) -> Column:
    """Canonical text of a value, equal for values that mean the same.

    Missing values share one mark, booleans count as 1 and 0, dates and
    timestamps compare by day, numbers by 15 significant digits, and texts that
    spell one of these compare as what they spell.
    """
    value = col(c)
    missing = F.lit("<NA>")
    if data_type == "boolean":
        return F.coalesce(value.cast("int").cast("string"), missing)
    if data_type in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(value.cast("string"), missing)
    if data_type in ("date", "timestamp", "timestamp_ntz"):
        return F.coalesce(value.cast("date").cast("string"), missing)
    if data_type in ("double", "float") or data_type.startswith("decimal"):
        return F.coalesce(_number_text(value.cast("double")), missing)
    text = F.trim(value.cast("string"))
    lowered = F.lower(text)
    # a cast that fails throws inside, so only what starts like a number is tried
    number = F.when(text.rlike(_NUMBER_START), text).try_cast("double")
    day = F.substring(text, 1, 10).try_cast("date")
    looks_dated = text.rlike(r"^\d{4}-\d{2}-\d{2}([ T].*)?$")
    return (
        F.when(text.isNull() | lowered.isin(NULL_TOKENS), missing)
        .when(lowered == "true", F.lit("1"))
        .when(lowered == "false", F.lit("0"))
        .when(looks_dated & day.isNotNull(), day.cast("string"))
        .when(number.isNotNull(), _number_text(number))
        .otherwise(text)
    )


def _number_text(x: Column) -> Column:
    # 15 significant digits: the scaled integer is the same for values that agree to that many
    scale = F.pow(F.lit(10.0), 14 - F.floor(F.log10(F.abs(x))))
    rounded = F.rint(x * scale) / F.when(scale != 0, scale)
    whole = (F.abs(x) < 1e18) & (x == F.floor(x))
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(None))
        .when(whole, F.when(whole, x).cast("long").cast("string"))
        .otherwise(rounded.cast("string"))
    )


def symbol_variants(ticker: Column | str, is_us: Column) -> Column:
    """Ordered distinct spellings of a ticker: as written, share class by slash or dot, root first abroad."""
    base = F.upper(F.trim(col(ticker)))
    root = F.split_part(base, F.lit("."), F.lit(1))
    both = F.array(
        F.when(~is_us, root),
        base,
        F.when(base.contains("-"), F.replace(base, F.lit("-"), F.lit("/"))),
        F.when(base.contains("-"), F.replace(base, F.lit("-"), F.lit("."))),
        F.when(root.contains("-"), F.replace(root, F.lit("-"), F.lit("/"))),
        F.when(root.contains("-"), F.replace(root, F.lit("-"), F.lit("."))),
    )
    return F.array_distinct(F.filter(both, lambda v: v.isNotNull() & (v != "")))
