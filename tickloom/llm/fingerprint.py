"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is a multiset of paragraphs (its lines that hold more than white space).
Each paragraph is hashed into a wide vector and the vectors are summed, so the
order of paragraphs does not matter, and a paragraph is inserted or deleted by
adding or subtracting its vector.  The vector has two parts:

* 8 lanes of 32 bits, summed modulo 2^32: equal multisets have equal lanes, and
  256 bits keep different ones apart;
* 64 lanes, each the number of the paragraph's sentences whose hash has a given
  bit, summed modulo 2^32 and held in pairs.  They are a linear sketch of the
  multiset of sentences: twice a lane less the number of sentences is a random
  sum of signs, so the lanes of two fingerprints estimate their scalar product
  and with it the share of sentences that two texts have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EQUAL_LANES = 8
BITS = 64
_PAIRS = 32
_PAIR_MASK = (1 << 32) | 1
_LANE = 1 << 32
PARTS = 512  # ranges of doc_id in which neighbours are looked up


def _pieces(text: Column, pattern: str) -> Column:
    """Pieces of a text that hold more than white space, trimmed."""
    return F.filter(F.transform(F.split(text, pattern), lambda p: F.btrim(p, F.lit(" \t\r\n\x0b\x0c"))), lambda p: p != "")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _seeded(seed: int):
    return lambda paragraph: F.xxhash64(paragraph, F.lit(seed))


def _bits(k: int):
    return lambda mark: F.shiftright(mark, k).bitwiseAND(F.lit(_PAIR_MASK))


def with_vector(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the wide vector of a text: array<bigint> of 8 equality lanes, 32 pairs of sketch lanes, the number of sentences.

    A null text is an empty one: all zeros.  The steps are columns of their own,
    each read several times, so that they are computed once a row.
    """
    low = F.lit(_LANE - 1)
    lists = df.withColumn("_paragraphs", _pieces(F.coalesce(F.col(text), F.lit("")), r"\n"))
    # one 64-bit hash gives two equality lanes; a lane is below 2^32, so the sum of 2^31 paragraphs fits
    lists = lists.withColumns(
        {f"_half{k}": F.transform("_paragraphs", _seeded(k)) for k in range(EQUAL_LANES // 2)}
        | {"_sentences": F.flatten(F.transform("_paragraphs", lambda p: _pieces(p, r"(?<=[.!?])\s")))}
    )
    marked = lists.withColumn("_marks", F.transform("_sentences", lambda s: F.xxhash64(s, F.lit("sketch"))))
    lanes = []
    for k in range(EQUAL_LANES // 2):
        half = F.col(f"_half{k}")
        lanes.append(_sum(F.transform(half, lambda h: h.bitwiseAND(low))).bitwiseAND(low))
        lanes.append(_sum(F.transform(half, lambda h: F.shiftrightunsigned(h, 32))).bitwiseAND(low))
    # bits k and k + 32 of a hash are counted in the two halves of a number
    for k in range(_PAIRS):
        lanes.append(_sum(F.transform("_marks", _bits(k))))
    lanes.append(F.size("_marks").cast("long"))
    return marked.select(*[F.col(f"`{c}`") for c in df.columns], F.array(*lanes).alias(name))


def add(a: Column, b: Column) -> Column:
    """The vector of two multisets together."""
    return _lanewise(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    """The vector of a multiset less another."""
    return _lanewise(a, b, lambda x, y: x - y)


def _lanewise(a: Column, b: Column, op) -> Column:
    low = F.lit(_LANE - 1)

    def lane(x: Column, y: Column) -> Column:
        # both halves modulo 2^32, without a carry between them
        bottom = op(x.bitwiseAND(low), y.bitwiseAND(low)).bitwiseAND(low)
        top = op(F.shiftrightunsigned(x, 32), F.shiftrightunsigned(y, 32)).bitwiseAND(low)
        return F.shiftleft(top, 32).bitwiseOR(bottom)

    return F.zip_with(a, b, lane)


def to_text(v: Column) -> Column:
    """The vector as a string: lanes in hexadecimal, joined by points."""
    return F.array_join(F.transform(v, lambda x: F.lower(F.hex(x))), ".")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: an estimate of 2 |A and B| / (|A| + |B|) over sentences; 1 for equal vectors, 0 if just one is empty."""
    n_a, n_b = F.get(a, F.lit(EQUAL_LANES + _PAIRS)), F.get(b, F.lit(EQUAL_LANES + _PAIRS))
    low = F.lit(_LANE - 1)

    def signs(v: Column, n: Column) -> Column:
        pairs = F.slice(v, EQUAL_LANES + 1, _PAIRS)
        halves = F.concat(
            F.transform(pairs, lambda x: x.bitwiseAND(low)), F.transform(pairs, lambda x: F.shiftrightunsigned(x, 32))
        )
        return F.transform(halves, lambda x: (2 * x - n).cast("double"))

    dots = F.zip_with(signs(a, n_a), signs(b, n_b), lambda x, y: F.struct((x * y).alias("ab"), (x * x + y * y).alias("ss")))
    both = F.aggregate(
        dots,
        F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("ss")),
        lambda s, d: F.struct((s["ab"] + d["ab"]).alias("ab"), (s["ss"] + d["ss"]).alias("ss")),
    )
    estimate = F.when(both["ss"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * both["ab"] / both["ss"]))).otherwise(0.0)
    return F.when(a == b, F.lit(1.0)).when((n_a == 0) | (n_b == 0), F.lit(0.0)).otherwise(estimate)


def with_next(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """(doc_id, text, vec, next_text, next_vec): each document with the next one by doc_id, the last with the first.

    The ids are cut into ranges by approximate quantiles, so a range holds
    about 1/parts of the rows; neighbours inside a range come from a window and
    the first row of the next range is joined to the last of each.  Texts move
    once.  Equal ids are ordered by text; a null id comes first.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.col("doc_id").cast("double")
    cuts = base.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], parts * 20).alias("q")).first()["q"] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    # the range of an id: how many cuts are below it
    number = F.coalesce(F.size(F.filter(bounds, lambda c: c < key)), F.lit(0)) if cuts else F.lit(0)
    ranges = base.groupBy(number.alias("part")).agg(F.min("doc_id").alias("least")).orderBy("part").collect()  # at most ``parts``
    numbers = [r["part"] for r in ranges]
    steps = spark.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1])), "before int, part int")
    least = base.where(F.col("doc_id").isNull() | F.col("doc_id").isin([r["least"] for r in ranges]))
    firsts = least.groupBy(number.alias("part")).agg(F.min(F.struct("doc_id", "text")).alias("row"))
    heads = firsts.join(F.broadcast(steps), "part").select(F.col("before").alias("part"), F.col("row.text").alias("first_text"))
    heads = with_vector(heads, "first_text", "first_vec")

    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    placed = with_vector(base.withColumn("part", number), "text", "vec").select(
        "part", "doc_id", "text", "vec", F.lead("text").over(order).alias("next_text"), F.lead("vec").over(order).alias("next_vec")
    )
    last = (placed["part"] == heads["part"]) & placed["next_vec"].isNull()
    return placed.join(heads, last, "left").select(
        "doc_id", "text", "vec",
        F.coalesce("next_text", "first_text").alias("next_text"),
        F.coalesce("next_vec", "first_vec").alias("next_vec"),
    )


def fingerprints(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    One row for each row of ``docs`` (doc_id, text).  The edited text has its
    last floor(n_chars/4) code points replaced by the first as many (or all) of
    the next document.  Nulls: a null text is empty; a null id sorts first.
    Rows of one id are ordered by text.  A single row is its own next document.
    An empty table gives no rows.  Other columns are not read.
    """
    paired = with_next(docs, parts)
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    with_edit = paired.select("doc_id", n.cast("long").alias("n_chars"), "vec", "next_vec", edited.alias("edited"))
    return with_vector(with_edit, "edited", "edited_vec").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        to_text(F.col("vec")).alias("fingerprint"),
        to_text(F.col("edited_vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"),
        likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )
