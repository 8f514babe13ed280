"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed, every run of 5 words (a k-gram) is hashed, and of every 6
neighbouring k-grams the least hash is kept.  Any 10 words that two texts share
hold 6 whole k-grams, so both keep the same least one: joining the kept hashes
finds every document that shares a window with an item.  Each hit is then
extended: the windows around it are written out and joined with the items'
windows as words, so that equal hashes alone never decide.

An item of fewer than 10 words is one window; its own length's word runs are
looked up instead, for just those lengths that the benchmark has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

WINDOW = 10
K = 5
REACH = WINDOW - K + 1  # k-grams of a window
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def words_of(text: Column) -> Column:
    """Words after folding A-Z; none for null."""
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def _upto(last: Column) -> Column:
    """0, 1 ... last; empty below 0."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(_none("int"))


def _runs(hashes: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words, tagged by their length."""
    return F.transform(
        _upto(F.size(hashes) - size), lambda i: F.xxhash64(F.lit(size), *[F.get(hashes, i + k) for k in range(size)])
    )


def _kept(grams: Column) -> Column:
    """The distinct least hashes of every REACH neighbouring k-grams."""
    return F.array_distinct(
        F.transform(_upto(F.size(grams) - REACH), lambda j: F.least(*[F.get(grams, j + k) for k in range(REACH)]))
    )


def _hashed(df: DataFrame, *keep: str) -> DataFrame:
    """(keep..., words, hashes, grams)."""
    worded = df.select(*keep, words_of(F.col("text")).alias("words"))
    hashed = worded.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    return hashed.withColumn("grams", _runs(F.col("hashes"), K))


def _short_lengths(items: DataFrame) -> list[int]:
    """Lengths below WINDOW among the items; nine values at most."""
    n = F.size(words_of(F.col("text")))
    return sorted(r[0] for r in items.select(n.alias("n")).where(f"n BETWEEN 1 AND {WINDOW - 1}").distinct().collect())


def _prints(hashed: DataFrame, key: str, lengths: list[int], whole: bool) -> DataFrame:
    """(key, print): winnowed k-grams and, for short items, the runs of their lengths.

    ``whole`` takes a short text as one run, as items are; documents give all.
    """
    n = F.size("hashes")
    if whole:
        short = F.coalesce(*[F.when(n == m, _runs(F.col("hashes"), m)) for m in lengths], _none("bigint"))
    else:
        short = F.concat(_none("bigint"), *[_runs(F.col("hashes"), m) for m in lengths])
    return hashed.select(key, F.explode(F.array_distinct(F.concat(_kept(F.col("grams")), short))).alias("print"))


def _windows(items: DataFrame) -> DataFrame:
    """(item_id, window): every WINDOW words of an item, or all of a shorter one, as words."""
    n = F.size("words")
    size = F.least(n, F.lit(WINDOW))
    starts = _upto(n - size)
    texts = F.transform(starts, lambda j: F.array_join(F.slice("words", j + 1, size), " "))
    return items.where(n > 0).select("item_id", F.explode(F.array_distinct(texts)).alias("window"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(window, doc_id, start, end): word spans of the documents that are windows of items, with their words.

    Documents without id are not looked up.
    """
    items = _hashed(benchmark.select("item_id", "text"), "item_id")
    lengths = _short_lengths(benchmark)
    prints = cut_lineage(_prints(items, "item_id", lengths, whole=True).select("print").distinct())
    windows = cut_lineage(_windows(items).select("window").distinct())

    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    # the tables just written have a known size: the planner broadcasts them if small, else it shuffles
    met = _prints(_hashed(named, "doc_id"), "doc_id", lengths, whole=False).join(prints, "print", "left_semi")
    candidates = cut_lineage(met.groupBy("doc_id").agg(F.collect_set("print").alias("prints")))

    opened = _hashed(named.join(candidates, "doc_id"), "doc_id", "prints")
    opened = opened.withColumns({f"runs{m}": _runs(F.col("hashes"), m) for m in lengths})
    n = F.size("words")

    def spans(found: str, size: int, back: int) -> Column:
        """Windows of ``size`` words with a run met at i that starts at most ``back`` words after the window, as words."""
        at = F.filter(_upto(F.size(found) - 1), lambda i: F.array_contains("prints", F.get(F.col(found), i)))
        starts = F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - back, F.lit(0)), F.least(i, n - size))))
        return F.transform(
            F.array_distinct(starts),
            lambda s: F.struct(
                s.alias("start"), (s + size).alias("end"), F.array_join(F.slice("words", s + 1, size), " ").alias("window")
            ),
        )

    # a k-gram at i belongs to the windows that start at i - 5 ... i
    none = _none("struct<start:int,end:int,window:string>")
    long = F.when(n >= WINDOW, spans("grams", WINDOW, REACH - 1)).otherwise(none)
    extended = F.concat(long, *[spans(f"runs{m}", m, 0) for m in lengths])
    written = opened.select("doc_id", F.explode(extended).alias("span")).select("doc_id", "span.*")
    return written.join(windows, "window", "left_semi")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with (doc_id, digest of the text) as doc_id: rows of one id differ if their texts do.

    A null id stays null.
    """
    key = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("digest"))
    return docs.select(F.when(F.col("doc_id").isNotNull(), key).alias("doc_id"), "text")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of ``docs``.

    Nulls: a null text has no words, in documents and items; a document without
    id is never hit; an item without id hits but is not listed.  Rows of one
    doc_id are told apart by their texts; rows of one item_id are one item.  An empty
    benchmark hits nothing.  Other columns are not read.
    """
    docs = keyed(docs)
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words"))
    found = cut_lineage(hits(docs, benchmark))
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["end"]).alias("upto"),
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )
    spans = found.groupBy("doc_id").agg(covered.cast("long").alias("n_hit"))
    named = found.select("doc_id", "window").distinct().join(_windows(items), "window").select("doc_id", "item_id").distinct()
    listed = named.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per_doc = cut_lineage(spans.join(listed, "doc_id", "left"))
    items_or_none = F.coalesce("items", _none("string"))
    return (
        docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
        .join(per_doc, "doc_id", "left")
        .select(
            F.col("doc_id.doc_id").alias("doc_id"),
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.size(items_or_none).cast("long").alias("n_items"),
            F.sha2(F.array_join(items_or_none, ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"),
        )
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less the rows that hold a window of an item.

    Of rows of one doc_id only those go whose own text holds one; a row without
    id stays.  The keys found are written first, so the planner knows their size.
    """
    found = cut_lineage(hits(keyed(docs), benchmark).select("doc_id.*").distinct())
    same = (F.col("d.doc_id") == F.col("f.doc_id")) & (F.xxhash64("d.text") == F.col("f.digest"))
    return docs.alias("d").join(found.alias("f"), same, "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])
