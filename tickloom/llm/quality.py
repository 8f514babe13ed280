"""Quality rules: surface rules, then a hashed n-gram likelihood ratio against trusted text.

The model is two multinomials over hashed n-grams: one of the trusted documents
and one of the whole corpus.  A token is a run of letters and digits or one
other visible character; an n-gram of tokens is hashed to
(31 * crc32(a) + crc32(b)) mod B, a single token to crc32(a) mod B.  With s of S
features of the corpus and t of T trusted ones in a bucket, its gain is

    floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B))))

A document's verdict is the mean gain of its features against a fixed
threshold.  Gains and their sums are whole numbers, so the verdict does not
depend on the order of any sum.

B grows as the vocabulary of a text does, with the square root of its size:
``BUCKETS_PER_ROOT`` times the root of the corpus' bytes.  The table of gains is
broadcast; four bytes a bucket make 0.3 GB of it over 100 TB of text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import idmap
from tickloom.llm.wordhash import text_slices
from tickloom.session import cut_lineage

BUCKETS_PER_ROOT = 8
LEAST_BUCKETS = 1 << 12
MAX_BROADCAST = 400_000  # trusted ids; more of them meet the texts in a shuffle
THRESHOLD = -50  # thousandths of a nat a feature
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xFF]+|[^\x00-\x20]")
SYMBOLS = b"#*$%&|<>"
_NO_SYMBOL = bytes(set(range(256)) - set(SYMBOLS))
_INSIDE = bytes(range(0x80, 0xC0))  # bytes that continue a character


def features(text: bytes, buckets: int) -> np.ndarray:
    """Buckets of all tokens and of all pairs of neighbouring tokens, repeats included."""
    tokens = np.array([crc32(t) for t in TOKEN.findall(text)], dtype=np.int64)
    return np.concatenate([tokens, 31 * tokens[:-1] + tokens[1:]]) % buckets


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text in UTF-8."""
    words = WORD.findall(text)
    chars = sum(map(len, words)) - len(text) + len(text.translate(None, _INSIDE))
    lines = [line for line in text.split(b"\n") if WORD.search(line)]
    windows = list(zip(words, words[1:], words[2:]))
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeated, upto = 0, 0
    for at, window in enumerate(windows):
        if window in often:
            repeated += at + 3 - max(at, upto)
            upto = at + 3
    symbols = len(text.translate(None, _NO_SYMBOL))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def trusted_ids(labels: DataFrame, max_trusted: int | None = None) -> DataFrame:
    """(doc_id) of all documents that most of their labels call good.

    A caller who asks for fewer gets about ``max_trusted`` of them, chosen by
    their ids alone.
    """
    votes = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.avg("quality").alias("share"))
    good = votes.where("share > 0.5").select("doc_id")
    if max_trusted is None:
        return good
    total = good.count()
    if total > max_trusted:
        slot = F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(1 << 31))
        good = good.where(slot < int((1 << 31) * max_trusted / total))
    return good


def _flagged(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(text, good) of every row of ``docs``; good is true where ``trusted`` (doc_id) has its id, else null.

    Beyond ``MAX_BROADCAST`` ids only the texts that a bit map of the ids does
    not rule out are moved to meet them.
    """
    docs = docs.select("doc_id", "text")
    ids = cut_lineage(trusted.select("doc_id"))
    flag = ids.withColumn("good", F.lit(True))
    if ids.count() <= MAX_BROADCAST:
        return docs.join(F.broadcast(flag), "doc_id", "left").select("text", "good")
    if docs.schema["doc_id"].dataType != ids.schema["doc_id"].dataType:
        # ids of two types are equal by value, not by their hashes
        return docs.join(flag, "doc_id", "left").select("text", "good")
    may = idmap.may_be_in(docs, ids)
    met = docs.where(may).join(flag, "doc_id", "left").select("text", "good")
    return docs.where(~may).select("text", F.lit(None).cast("boolean").alias("good")).union(met)


def bucket_count(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BUCKETS, math.floor(BUCKETS_PER_ROOT * math.sqrt(size)))


def fit(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket that a document of ``docs`` (doc_id, text) has.

    ``trusted`` (doc_id) has each id once, and any number of them.
    """
    known = _flagged(docs, trusted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text", 1 << 22):
            good = rows.column("good").fill_null(False).to_numpy(zero_copy_only=False)
            found = [features(data[a:b].tobytes(), buckets) for a, b in zip(offsets, offsets[1:])]
            all_ = np.unique_counts(np.concatenate(found))
            few = np.unique_counts(np.concatenate([np.zeros(0, np.int64), *(f for f, g in zip(found, good) if g)]))
            trusted_n = np.zeros(len(all_.values), dtype=np.int64)
            trusted_n[np.searchsorted(all_.values, few.values)] = few.counts
            yield pa.RecordBatch.from_arrays(
                [pa.array(all_.values), pa.array(all_.counts.astype(np.int64)), pa.array(trusted_n)], ["bucket", "s", "t"]
            )

    counted = known.mapInArrow(count, "bucket long, s long, t long")
    counts = cut_lineage(counted.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    whole = counts.agg(F.sum("s"), F.sum("t")).first()
    big_s, big_t = (float((n or 0) + buckets) for n in whole)
    ratio = (F.col("t") + 1) * F.lit(big_s) / ((F.col("s") + 1) * F.lit(big_t))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).cast("int").alias("gain"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def quality(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_features, score, base_failed, kept).

    One row for each row of ``docs`` (doc_id, text); ``score`` is the sum of
    gains, and a document is kept if it passes the surface rules and
    score >= threshold * n_features.  Trusted are all documents whose ``labels``
    (doc_id, quality) are mostly 1; without any, every bucket's trusted count
    is zero.

    A null text is an empty one: no words, no features, failed.  Rows without
    id are counted and judged, but never trusted; repeated rows are judged each
    and counted each.  An empty table gives no rows.  Other columns of either
    table are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    buckets = bucket_count(docs)
    rows = fit(docs, trusted_ids(labels), buckets).toArrow()
    gains = np.zeros(buckets, dtype=np.int32)
    gains[rows.column("bucket").to_numpy()] = rows.column("gain").to_numpy()
    sent = spark.sparkContext.broadcast(gains)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            table = []
            for a, b in zip(offsets, offsets[1:]):
                text = data[a:b].tobytes()
                found = features(text, buckets)
                table.append((*base_counts(text), len(found), int(sent.value[found].sum(dtype=np.int64))))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*table))], ["doc_id", *_COUNTS]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.mapInArrow(judge, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in _COUNTS))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold * F.col("n_features"))
    )


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_features", "score")

CRC32_SQL = """
-- CRC-32 by the table of its 256 bytes; bytes of a text from its hexadecimal form
crc_table AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
)"""


def crc32_sql(text: str) -> str:
    """DuckDB: crc32 of a text's UTF-8 bytes, where ``crcs`` of CRC32_SQL is in scope."""
    byte = "(instr('0123456789ABCDEF', substr(hex({t}), 2 * k + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex({t}), 2 * k + 2, 1)) - 1"
    return (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({t})), lambda k: ("
        + byte
        + ")::BIGINT)), lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1])))"
    ).replace("{t}", text)


ORACLE_SQL = f"""
WITH {CRC32_SQL.strip()},
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
size AS (SELECT greatest({LEAST_BUCKETS}, floor({BUCKETS_PER_ROOT} * sqrt(sum(strlen(text)))))::BIGINT AS b FROM docs),
good AS (SELECT doc_id FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING avg(quality) > 0.5),
tokens AS (
  SELECT r, unnest(x) AS token, generate_subscripts(x, 1) AS p
  FROM (SELECT r, regexp_extract_all(text, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+|[^\\x00-\\x20]') AS x FROM docs)),
numbered AS (SELECT token, {crc32_sql('token')} AS c FROM (SELECT DISTINCT token FROM tokens), crc_table),
ones AS (SELECT r, p, c FROM tokens JOIN numbered USING (token)),
feats AS (
  SELECT r, c % b AS bucket FROM ones, size
  UNION ALL SELECT x.r, (31 * x.c + y.c) % b FROM ones x JOIN ones y ON x.r = y.r AND y.p = x.p + 1, size),
counts AS (
  SELECT bucket, count(*) AS s, count(*) FILTER (doc_id IN (SELECT doc_id FROM good WHERE doc_id IS NOT NULL)) AS t
  FROM feats JOIN docs USING (r) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + b)::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM counts) + b)::DOUBLE)))::BIGINT AS gain
  FROM counts, size),
scores AS (SELECT r, count(*) AS n_features, sum(gain) AS score FROM feats JOIN gains USING (bucket) GROUP BY r),
words AS (
  SELECT r, unnest(x) AS w, generate_subscripts(x, 1) AS p
  FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS x FROM docs)),
word_counts AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY r),
windows AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, w, w1, w2) AS n FROM (
    SELECT r, p, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM words WINDOW o AS (PARTITION BY r ORDER BY p)) WHERE w2 IS NOT NULL),
repeats AS (SELECT r, count(DISTINCT p + k) AS n_repeat_words FROM windows, (SELECT unnest(range(3)) AS k) WHERE n > 1 GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
counted AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(score, 0)::BIGINT AS score
  FROM docs LEFT JOIN word_counts USING (r) LEFT JOIN repeats USING (r) LEFT JOIN dups USING (r) LEFT JOIN scores USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND score >= {THRESHOLD} * n_features AS kept
FROM counted
"""
