"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

A word's bigrams are ordered by the number of words that hold them, rarest
first; its prefix are the rarest that together take three places or more.  Two
of them are its pivots: the first place of one and the last place of another
that do not overlap, with the least sum of ranks, by dynamic programming.  An
edit is right of the one or left of the other, so if two words are near, a pivot
of the one whose prefix ends earlier in the order is in the prefix of the other.

Position limits: right of a pivot's first place, an edit leaves that place as
far from the start; left of a last place, as far from the end; the lengths
differ by one at most.  As there are few bigrams and many words, the postings of
a bigram are split: the side that the edit may be on is cut into parts of
``PART`` code points (at most ``MOST_PARTS`` parts), of which the edit is in one,
and a posting's key holds all code points outside of that part.  Frequent
bigrams so become many small groups, and what meets is nearly always near.
Every meeting pair is verified by its edit distance within the join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tickloom.llm.quality import CRC32_SQL, crc32_sql
from tickloom.session import cut_lineage

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
SLIP = 31
PART = 3
MOST_PARTS = 8
LETTERS = re.compile(r"[A-Za-zÀ-ÿ]+")
FOLD = {65 + i: 97 + i for i in range(26)}
_HELD = 200_000  # distinct words that a task gathers before it hands them out


def document_words(doc_id, text: str, slip: int = SLIP) -> Counter:
    """Words of a text and their numbers; one word of ``slip``, by a hash, lacks a code point."""
    out: Counter = Counter()
    for run, n in Counter(LETTERS.findall(text)).items():
        word = run.translate(FOLD)
        h = crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
        if h % slip == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        out[word] += n
    return out


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n) of all words of ``docs`` (doc_id, text) that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for word, n in document_words(doc_id, text.as_py() or "", slip).items():
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= _HELD:
                    yield _counts(held)
                    held = Counter()
        if held:
            yield _counts(held)

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Place of every bigram in the order of how many words hold it, rarest first.

    Words are of 26 + 64 letters, so there are 8,100 bigrams at most.
    """
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2))))
    rows = words.select(F.explode(grams).alias("gram")).groupBy("gram").count().orderBy("count", "gram").collect()
    return {r["gram"]: i for i, r in enumerate(rows)}


def prefix_places(word: str, ranks: dict[str, int]) -> tuple[dict[int, tuple[int, int]], int]:
    """({rank: (first, last place)} of the prefix's bigrams, highest of these ranks)."""
    spans: dict[int, tuple[int, int, int]] = {}
    for at in range(len(word) - 1):
        rank = ranks[word[at: at + 2]]
        first, _, n = spans.get(rank, (at, at, 0))
        spans[rank] = (first, at, n + 1)
    prefix, places = {}, 0
    for rank in sorted(spans):
        first, last, n = spans[rank]
        prefix[rank] = (first, last)
        places += n
        if places >= 3:
            return prefix, rank
    raise ValueError("a word of four code points or more")


def pivot_places(prefix: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """A first and a later last place of the prefix that do not overlap, with the least sum of ranks.

    One pass over the places in order: the rarest first place so far that ends
    before the present one, and the best pair so far.
    """
    firsts = sorted((first, rank) for rank, (first, _) in prefix.items())
    best = None
    rarest = None
    ready = 0
    for last, rank in sorted((last, rank) for rank, (_, last) in prefix.items()):
        while ready < len(firsts) and firsts[ready][0] <= last - 2:
            if rarest is None or firsts[ready][1] < rarest[1]:
                rarest = firsts[ready]
            ready += 1
        if rarest is not None and (best is None or rarest[1] + rank < best[0]):
            best = (rarest[1] + rank, rarest[0], last)
    return best[1:]


def _around(side: str, kept: str, open_side: str, length: int, of: int) -> Iterator[int]:
    """Keys of a bigram's posting in a word of ``of`` code points: the code points outside of each part.

    ``open_side`` are those on the edit's side, away from the bigram on; it is
    cut as a side of ``length`` code points would be.  Keys are 64-bit hashes: a
    chance meeting does not pass the verification.
    """
    part = max(PART, -(-length // MOST_PARTS))
    for at in range(0, max(length, 1), part):
        behind = max(length - at - part, 0)
        near, far = open_side[:at], open_side[len(open_side) - behind:]
        if len(near) == at:
            yield xxh3_64_intdigest(f"{side}{of}|{kept}|{at}|{near}|{far}") - (1 << 63)


def posting_keys(word: str, prefix: dict[int, tuple[int, int]]) -> Iterator[int]:
    """Where a word is found by a bigram of its prefix."""
    for first, last in prefix.values():
        yield from _around("L", word[: first + 2], word[first + 2:], len(word) - first - 2, len(word))
        # read from the bigram to the left
        yield from _around("R", word[last:], word[:last][::-1], last, len(word))


def probe_keys(word: str, pivots: tuple[int, int]) -> Iterator[int]:
    """Where a word looks for near ones: right of its first pivot and left of the other.

    An edit makes a word of as many code points, one more or one less.
    """
    left, right = pivots
    for more in (-1, 0, 1):
        if len(word) - left - 2 + more >= 0:
            yield from _around("L", word[: left + 2], word[left + 2:], len(word) - left - 2 + more, len(word) + more)
        if right + more >= 0:
            yield from _around("R", word[right:], word[:right][::-1], right + more, len(word) + more)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of near words of ``words`` (word, n) once, in both orders.

    Words have at least four code points.
    """
    sent = words.sparkSession.sparkContext.broadcast(gram_ranks(words))

    def keyed(probe: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranks = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 2_000):
                    part = batch.slice(at, 2_000)
                    rows = []
                    for word, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist()):
                        prefix, last = prefix_places(word, ranks)
                        keys = probe_keys(word, pivot_places(prefix)) if probe else posting_keys(word, prefix)
                        rows += [(key, word, n, last) for key in set(keys)]
                    columns = zip(*rows) if rows else ((),) * 4
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "word", "n", "last"])

        return words.select("word", "n").mapInArrow(run, "key long, word string, n long, last int")

    a, b = keyed(True).alias("a"), keyed(False).alias("b")
    near = (F.col("a.last") <= F.col("b.last")) & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & near).select(
        F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n")
    )
    return met.union(met.select("b", "b_n", "a", "a_n")).distinct()


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last word that the forms lead to.

    A form has at least ``RATIO`` times the occurrences, so no chain is longer
    than the digits of a count; each round doubles the steps taken.
    """
    step = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = cut_lineage(step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        step = after.select("word", "root")
        if after.where("moved").isEmpty():
            return step


def variants(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, slip: int = SLIP
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word that is long and frequent enough.

    ``form`` is the near word with most occurrences, of equal ones the least by
    code points, if it has at least ``ratio`` times as many as the word itself;
    ``root`` is where the forms lead.  A null text has no words; a null id is
    read as an empty one; repeated rows count as often as they occur; an empty
    table gives no rows.  Other columns of ``docs`` are not read.
    """
    if min_length < 4 or ratio < 2:
        raise ValueError("words of four code points or more, and a ratio of two or more")
    words = cut_lineage(word_counts(docs, min_length, min_count, slip))
    near = near_pairs(words).groupBy("a", "a_n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("most")
    )
    form_n = -F.col("most.less")
    chosen = form_n >= ratio * F.col("a_n")
    near = cut_lineage(near.select(
        F.col("a").alias("word"), "n_near", F.when(chosen, F.col("most.b")).alias("form"), F.when(chosen, form_n).alias("form_n")
    ))
    roots = follow(near.where("form IS NOT NULL"))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")
    )


ORACLE_SQL = f"""
WITH RECURSIVE {CRC32_SQL.strip()},
runs AS (
  SELECT r, doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM (
    SELECT r, coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run
    FROM (SELECT row_number() OVER () AS r, * FROM documents)) GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql("(doc_id || ':' || run)")} AS h FROM runs, crc_table WHERE length(run) >= {MIN_LENGTH}),
slipped AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
met AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION ALL SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
near AS MATERIALIZED (SELECT DISTINCT word, n, other, other_n FROM met),
best AS (SELECT word, n, count(*) AS n_near, min((-other_n, other)) AS most FROM near GROUP BY word, n),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -most[1] >= {RATIO} * w.n THEN most[2] END AS form, CASE WHEN -most[1] >= {RATIO} * w.n THEN -most[1] END AS form_n
  FROM words w LEFT JOIN best USING (word)),
path AS (
  SELECT word, word AS reached, form AS next FROM formed
  UNION ALL SELECT p.word, f.word, f.form FROM path p JOIN formed f ON f.word = p.next)
SELECT word, n, n_near, form, form_n, reached AS root FROM formed JOIN path USING (word) WHERE next IS NULL
"""
