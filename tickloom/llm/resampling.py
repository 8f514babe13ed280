"""Importance resampling towards a target distribution, by hashed n-grams.

Texts are folded (A-Z only) and what separates words becomes a single space.
For every order n a pattern of n words is scanned with overlapping matches;
look-arounds hold a match to whole words, so each match is the span of one
n-gram, and the CRC-32 of its bytes modulo the number of buckets counts it.

A bucket's gain compares the target's share with the corpus'; a document's
weight is the sum of its features' gains.  Adding Gumbel noise of a hash of the
id and taking the highest scores draws without replacement in proportion to
exp(weight), and the same rows on every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.quality import CRC32_SQL, crc32_sql
from tickloom.llm.wordhash import text_slices
from tickloom.operators.support import Ordering, ordered_prefix
from tickloom.session import cut_lineage

ORDERS = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
# every byte as itself, folded, or a space: what separates words is ASCII, so this holds for UTF-8
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


@cache
def _pattern(n: int) -> regex.Pattern:
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))


@cache
def _separators() -> regex.Pattern:
    return regex.compile(rb" {2,}")


def ngram_buckets(text: bytes, orders: int = ORDERS, buckets: int = BUCKETS) -> list[int]:
    """Buckets of all runs of 1 to ``orders`` words of a text in UTF-8, repeats included."""
    plain = _separators().sub(b" ", text.translate(FOLDED))
    spans = (m.span() for n in range(1, orders + 1) for m in _pattern(n).finditer(plain, overlapped=True))
    return [crc32(plain[a:b]) % buckets for a, b in spans]


def hashed(docs: DataFrame, orders: int, buckets: int, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but ``text``, with n_words and the features' buckets."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("1 to 65,536 buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, text):
            found = [ngram_buckets(data[a:b].tobytes(), orders, buckets) for a, b in zip(offsets, offsets[1:])]
            # a text of w words has w - n + 1 runs of n of them
            words = [_words(len(f), orders) for f in found]
            others = [rows.column(c) for c in rows.schema.names if c != text]
            yield pa.RecordBatch.from_arrays(
                [*others, pa.array(words, pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                [*(c for c in rows.schema.names if c != text), "n_words", "buckets"],
            )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(run, ", ".join([*kept, "n_words long", "buckets array<int>"]))


def _words(features: int, orders: int) -> int:
    """Words of a text by the number of its runs of 1 to ``orders`` words."""
    # with fewer words than orders, w words have w * (w + 1) / 2 runs
    full = (features + orders * (orders - 1) // 2) // orders
    if full >= orders - 1:
        return full
    w = 0
    while w * (w + 1) // 2 < features:
        w += 1
    return w


def bucket_counts(features: DataFrame, name: str) -> DataFrame:
    return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(features: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) of every bucket; ``buckets`` numbers."""
    every = features.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    counts = cut_lineage(
        every.join(bucket_counts(features, "s"), "bucket", "left")
        .join(bucket_counts(target, "t"), "bucket", "left")
        .select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    )
    whole = counts.agg(F.sum("s"), F.sum("t")).first()
    big_s, big_t = (float(n + buckets) for n in whole)
    ratio = (F.col("t") + 1) * F.lit(big_s) / ((F.col("s") + 1) * F.lit(big_t))
    rows = counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("gain").to_numpy()
    return out


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the seed and the id; a null id counts as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS,
    min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row for each row of ``docs`` (doc_id, text).

    Of the N rows with at least ``min_words`` words, floor(percent * N / 100)
    are drawn: those of the highest scores, ties to the smaller id (a null id is
    last).  ``rank`` is their place from 1 on, null for others.  Every text of
    ``target`` (text) counts for the target.

    A null text has no words: no features, weight 0.  Repeated rows are rows of
    their own; of rows with one id and score any may come first, but they differ
    in nothing else than the text they come from.  An empty target or corpus has
    counts of zero.  Other columns of either table are not read.

    The features are written once, so that the texts are scanned once; the
    gains, a number a bucket, are broadcast.  Ranks come from range partitions.
    """
    features = cut_lineage(hashed(docs.select("doc_id", "text"), orders, buckets))
    wanted = cut_lineage(hashed(target.select("text"), orders, buckets))
    sent = docs.sparkSession.sparkContext.broadcast(gains(features, wanted, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column("buckets")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(sent.value[lists.flatten().to_numpy()])])
            ends = np.cumsum(n)
            weight = total[ends] - total[ends - n]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("n_words"), pa.array(n), pa.array(weight.astype(np.int64))],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    weighed = features.mapInArrow(weigh, f"doc_id {id_type}, n_words long, n_features long, weight long")
    scored = cut_lineage(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    drawable = scored.where(F.col("n_words") >= min_words)
    drawn = percent * drawable.count() // 100
    placed = ordered_prefix(drawable, [], [Ordering("score", descending=True), Ordering("doc_id")], position="place")
    ranked = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")).cast("long"))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).union(rest.select(columns))


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[0-9a-z\\x{80}-\\x{10FFFF}]+')"
)

# for ORDERS = 1: a feature is a word
ORACLE_SQL = f"""
WITH {CRC32_SQL.strip()},
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS words FROM documents),
found AS (SELECT r, unnest(words) AS w FROM docs),
wanted AS (SELECT unnest({_WORDS_SQL}) AS w FROM benchmark),
numbered AS (
  SELECT w, ({crc32_sql('w')}) % {BUCKETS} AS bucket
  FROM (SELECT w FROM found UNION SELECT w FROM wanted), crc_table),
corpus AS (SELECT bucket, count(*) AS s FROM found JOIN numbered USING (w) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM wanted JOIN numbered USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM found) + {BUCKETS} AS s_all, (SELECT count(*) FROM wanted) + {BUCKETS} AS t_all),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * s_all::DOUBLE / ((s + 1) * t_all::DOUBLE)))::BIGINT AS gain
  FROM corpus LEFT JOIN target USING (bucket), totals),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM found JOIN numbered USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(words) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)),
places AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, {PERCENT} * count(*) OVER () // 100 AS drawn
  FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank
FROM scored LEFT JOIN places USING (r)
"""
