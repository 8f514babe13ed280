"""Toxicity by class-conditional Kneser-Ney models.

A word is spelled as a path of ever longer prefixes (3, 5, 7, 9, 12 bytes, the
whole word).  For each class c, toxic and ordinary, the chance of a node x
after its parent y is

    P_c(x|y) = (max(n_c(x) - D, 0) + (D * T_c(y) + K) * S(x|y)) / (n_c(y) + K)

with n_c the documents of the class that hold the node, T_c(y) the distinct
nodes that continue y in the class, and S(x|y) the backoff share of Kneser and
Ney, shared by the classes: of the distinct continuations that all documents
know below y, one more for y's children themselves, the share of x.  A node
whose class counts do not differ from its parent's beyond a G-test threshold is
rare or neutral: both classes then use the shared share alone, and it adds
nothing.

A document's evidence is the length-normalised difference of its toxic and
ordinary log-likelihoods, over the whole text and over its worst passage of 32
words.  A two-feature logistic curve turns it into a score; it is fitted on
training rows whose own counts are taken out first.

The nodes are a table with a row for each distinct prefix of the corpus, under
its 64-bit number; it grows with the corpus.  Only nodes that pass the test
leave it.  Labelled rows are read up to ``MAX_LABELLED``, beyond that a
hash-ordered share of about that many, which bounds those nodes too; continuations
are counted over every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.wordhash import ALNUM, U64, hash_words, text_slices
from tickloom.session import cut_lineage

MAX_LABELLED = 400_000
FOLDS, HELD_OUT = 5, 0
PREFIXES = (3, 5, 7, 9, 12)
LEVELS = len(PREFIXES) + 1
DISCOUNT = 0.75
PRIOR = 5.0
G_TEST = 12.0
PASSAGE = 32
BINS = 48
HELD = 1 << 19  # nodes that a counting task holds before it hands them out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass
class ToxicityModel:
    """Evidence per node: from all counts, and from those less one ordinary or one toxic document."""

    keys: np.ndarray  # numbers of the nodes with evidence, ascending
    evidence: np.ndarray  # (3, nodes) float32
    weights: tuple[float, float, float]  # bias, whole text, worst passage

    @property
    def no_evidence(self) -> float:
        """The score of a text without words or evidence: about the share of toxic labels."""
        return float(_score(self.weights, np.zeros(1), np.zeros(1))[0])


def _score(weights: tuple[float, float, float], mean: np.ndarray, worst: np.ndarray) -> np.ndarray:
    bias, whole, passage = weights
    return 1 / (1 + np.exp(-np.clip(bias + whole * _squash(mean) + passage * _squash(worst), -30, 30)))


def _nodes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the nodes by level and word, whether the node is longer than its parent, first words)."""
    numbers, first = hash_words(data, offsets, ALNUM, PREFIXES)
    longer = np.ones(numbers.shape, dtype=bool)
    longer[1:] = numbers[1:] != numbers[:-1]
    return numbers, longer, first


_COUNTS = "node long, parent long, n0 long, n1 long"


def _together(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counted nodes of several slices as one, a row for each node."""
    node, parent, *counts = (np.concatenate(x) for x in zip(*parts))
    keys, at, group = np.unique(node, return_index=True, return_inverse=True)
    return keys, parent[at], *(np.bincount(group, weights=c, minlength=len(keys)).astype(np.int64) for c in counts)


def _rows(node: np.ndarray, parent: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> Iterator[pa.RecordBatch]:
    columns = [pa.array(x.view(np.int64)) for x in (node, parent, n0, n1)]
    whole = pa.RecordBatch.from_arrays(columns, ["node", "parent", "n0", "n1"])
    for at in range(0, whole.num_rows, 1 << 16):
        yield whole.slice(at, 1 << 16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct nodes of a task's texts, their parents, and the documents of each class that hold them."""
    parts: list[tuple[np.ndarray, ...]] = []
    for rows, data, offsets in text_slices(batches, "text"):
        numbers, longer, first = _nodes(data, offsets)
        parents = np.vstack([np.zeros((1, numbers.shape[1]), dtype=U64), numbers[:-1]])
        keys, at = np.unique(numbers[longer], return_index=True)
        counts = [np.zeros(len(keys), dtype=np.int64) for _ in (0, 1)]
        labels = rows.column(rows.schema.get_field_index("toxic")).fill_null(-1).to_numpy(zero_copy_only=False)
        for row in np.flatnonzero(labels >= 0):
            mine = slice(int(first[row]), int(first[row + 1]))
            held = np.unique(numbers[:, mine][longer[:, mine]])
            counts[int(labels[row])][np.searchsorted(keys, held)] += 1
        parts.append((keys, parents[longer][at], *counts))
        if sum(len(p[0]) for p in parts) >= HELD:
            parts = [_together(parts)]
            if len(parts[0][0]) >= HELD // 2:
                yield from _rows(*parts.pop())
    if parts:
        yield from _rows(*_together(parts))


def _log_ratio(less: tuple[int, int]) -> Column:
    """Log ratio of a node's two chances with ``less`` documents taken out, 0 if it fails the G-test."""
    mine = [F.greatest(F.col(f"n{c}") - less[c], F.lit(0)).cast("double") for c in (0, 1)]
    of = [F.greatest(F.col(f"of{c}") - less[c], mine[c]) for c in (0, 1)]
    chance = [
        (F.greatest(mine[c] - DISCOUNT, F.lit(0.0)) + (DISCOUNT * F.col(f"types{c}") + PRIOR) * F.col("share")) / (of[c] + PRIOR)
        for c in (0, 1)
    ]
    total = F.greatest(mine[0] + mine[1], F.lit(1.0))
    toxic = (of[1] + 0.5) / (of[0] + of[1] + 1)

    def part(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.ln(F.greatest(n, F.lit(1.0)) / (total * expected))).otherwise(0.0)

    g = 2 * (part(mine[0], 1 - toxic) + part(mine[1], toxic))
    return F.when(g >= G_TEST, F.ln(chance[1] / chance[0])).otherwise(0.0)


def evidence_table(known: DataFrame) -> DataFrame:
    """(node, e0, e1, e2): the nodes of (text, toxic) rows with any evidence; a null toxic is no label.

    Counts combine before their shuffle; the table of nodes is written once.
    """
    counted = known.mapInArrow(_count, _COUNTS)
    nodes = cut_lineage(counted.groupBy("node").agg(F.min("parent").alias("parent"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    # a node of its own and its distinct continuations
    wide = nodes.join(children, "node", "left").withColumn("width", 1 + F.coalesce("children", F.lit(0)))
    families = wide.groupBy("parent").agg(
        F.sum("width").alias("widths"),
        *[F.sum(f"n{c}").alias(f"sum{c}") for c in (0, 1)],
        *[F.count_if(F.col(f"n{c}") > 0).alias(f"types{c}") for c in (0, 1)],
    )
    above = nodes.select(F.col("node").alias("parent"), F.col("n0").alias("up0"), F.col("n1").alias("up1"))
    # only nodes of labelled documents can pass the test; the first prefixes have no parent, and their sum stands for it
    tested = wide.where("n0 + n1 > 0").join(families, "parent").join(above, "parent", "left")
    tested = tested.withColumns({f"of{c}": F.coalesce(f"up{c}", f"sum{c}") for c in (0, 1)} | {"share": F.col("width") / F.col("widths")})
    out = tested.select("node", *[_log_ratio(less).alias(f"e{i}") for i, less in enumerate(((0, 0), (1, 0), (0, 1)))])
    return out.where("e0 <> 0 OR e1 <> 0 OR e2 <> 0")


class _Lookup:
    """Positions of numbers among the keys; a table of bits keeps most others from being searched."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = U64(64 - max(10, len(keys).bit_length() + 4))
        self.marked = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.marked[keys >> self.shift] = True

    def __call__(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the numbers are keys, their positions among the keys)."""
        may = np.flatnonzero(self.marked[numbers >> self.shift])
        at = np.searchsorted(self.keys, numbers[may])
        found = self.keys[np.minimum(at, len(self.keys) - 1)] == numbers[may] if len(self.keys) else np.zeros(0, dtype=bool)
        return may[found], at[found]


def _features(
    find: _Lookup, evidence: np.ndarray, data: np.ndarray, offsets: np.ndarray, left_out: np.ndarray
) -> np.ndarray:
    """Per text: words, mean evidence of its words, and the mean over its worst passage."""
    numbers, longer, first = _nodes(data, offsets)
    document = np.repeat(np.arange(len(left_out)), np.diff(first))
    table = left_out[document]
    words = np.zeros(numbers.shape[1])
    for k in range(LEVELS):
        here = np.flatnonzero(longer[k])
        which, at = find(numbers[k][here])
        word = here[which]
        words[word] += evidence[table[word], at]
    out = np.zeros((3, len(left_out)))
    running = np.concatenate([[0.0], np.cumsum(words)])
    out[0] = np.diff(first)
    out[1] = (running[first[1:]] - running[first[:-1]]) / np.maximum(out[0], 1)
    if len(words):
        # passages are PASSAGE words from each word on, less at the end of a text
        end = np.minimum(np.arange(len(words)) + PASSAGE, first[1:][document])
        passage = (running[end] - running[:-1]) / PASSAGE
        full = out[0] > 0
        out[2, full] = np.maximum.reduceat(passage, first[:-1][full])
    return out


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """One (doc_id, toxic) row per labelled training document, about ``max_labelled`` at most.

    Several labels of one document count as their majority; a draw, a null or
    any other value than 0 and 1 is no label.
    """
    votes = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.avg("toxic").alias("share"))
        .where("share <> 0.5")
        .select("doc_id", (F.col("share") > 0.5).cast("int").alias("toxic"))
    )
    total = votes.count()
    if total > max_labelled:
        # which rows are read depends on their ids alone
        slot = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 31))
        votes = votes.where(slot < int((1 << 31) * max_labelled / total))
    return votes


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Counts over all texts, class counts and the curve from labelled training rows.

    Held-out rows (crc32 of the id, modulo 5, is 0) add to the shared counts
    only.  Without labels of both classes every score is the known class.
    """
    spark = docs.sparkSession
    votes = _labelled(docs, labels, max_labelled)
    known = docs.select("doc_id", "text").join(F.broadcast(votes), "doc_id", "left").select("text", "toxic")
    found = evidence_table(known).toArrow()
    keys = found.column("node").to_numpy().view(U64)
    order = np.argsort(keys)
    evidence = np.stack([found.column(f"e{i}").to_numpy()[order] for i in range(3)]).astype(np.float32)
    model = ToxicityModel(keys[order], evidence, (0.0, 0.0, 0.0))
    sent = spark.sparkContext.broadcast((model.keys, evidence))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, evidence = sent.value
        find = _Lookup(keys)
        for rows, data, offsets in text_slices(batches, "text"):
            toxic = rows.column(rows.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False).astype(np.int64)
            _, mean, worst = _features(find, evidence, data, offsets, toxic + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic, pa.int32()), pa.array(_bin(mean), pa.int32()), pa.array(_bin(worst), pa.int32())],
                ["toxic", "mean", "worst"],
            )

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(votes), "doc_id")
        .select("text", "toxic")
        .mapInArrow(features, "toxic int, mean int, worst int")
        .groupBy("toxic", "mean", "worst")
        .count()
        .toArrow()  # at most 2 * BINS * BINS rows
    )
    sent.destroy()
    model.weights = _logistic(*(rows.column(c).to_numpy() for c in ("toxic", "mean", "worst", "count")))
    return model


def _bin(x: np.ndarray) -> np.ndarray:
    """Signed square-root bins: fine around zero, where most texts are."""
    return np.clip(np.round(np.sign(x) * np.sqrt(np.abs(x)) * BINS / 4), -BINS // 2, BINS // 2).astype(np.int32)


def _squash(x: np.ndarray) -> np.ndarray:
    return np.clip(np.sign(x) * np.sqrt(np.abs(x)), -2, 2)


def _logistic(toxic: np.ndarray, mean: np.ndarray, worst: np.ndarray, count: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps, with a small ridge."""
    x = np.stack([np.ones(len(toxic)), mean * 4 / BINS, worst * 4 / BINS], axis=1)
    w = np.zeros(3)
    if not len(toxic):
        return (-20.0, 0.0, 0.0)
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (count * (toxic - p)) - ridge @ w
        curve = (x * (count * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def with_scores(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score", words: str = "n_words") -> DataFrame:
    """``docs`` with two more columns; no shuffle.  Columns of those names are replaced.

    A null or empty text has no words and the score of no evidence.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.keys, model.evidence[:1], model.weights))
    kept = docs.drop(score, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, evidence, weights = sent.value
        find = _Lookup(keys)
        for rows, data, offsets in text_slices(batches, text):
            n, mean, worst = _features(find, evidence, data, offsets, np.zeros(rows.num_rows, dtype=np.int64))
            value = _score(weights, mean, worst)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(value), pa.array(n.astype(np.int64))], [*rows.schema.names, score, words]
            )

    schema = T.StructType([*kept.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(words, T.LongType())])
    return kept.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_words), one row for each row of ``docs``.

    Nulls: a null text scores as an empty one; a row without id is never
    labelled and never held out.  Repeated rows are scored each; an empty table
    gives no rows.  Other columns of either table are not read.
    """
    model = fit(docs, labels, max_labelled)
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_words",
    )
