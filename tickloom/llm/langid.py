"""Language identification by mixture inference.

Every learned language has a distribution of letter trigrams (a letter byte
with its neighbours; everything that is no letter is one boundary mark), mixed
with the distribution of all languages together.  A document is a mixture: each
of its words belongs to one language.  Expectation-maximisation finds the
proportions under which the words' likelihoods are largest, for the best one,
two, three ... languages, as long as a further one can still gain; the set of
languages is the one with the largest likelihood less half the logarithm of the
number of words per further language.  The predicted language has the largest
share of the chosen mixture.

Bounds: trigrams are hashed into 2^16 cells a language, so the model's size
follows the number of languages alone.  Counts cover all training rows.  The
unit is one word in every text; a text longer than a slice is summed over pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import arrays
from tickloom.llm.wordhash import LOWER, text_slices

FOLDS, HELD_OUT = 4, 2
CELLS = 1 << 16
PRIOR = 50.0
ROUNDS = 6
SLICE = 1 << 22  # bytes of text times languages that are read at once
KEPT = 1 << 23  # likelihoods of a longer text that are kept between the rounds; others are computed anew
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells of the letters' trigrams, first letter of each word, words before each text and in all)."""
    a, b = int(offsets[0]), int(offsets[-1])
    letters = _LETTER[LOWER[data[a:b]]].astype(np.uint32)
    inner = offsets - a
    before = np.zeros(len(letters), dtype=np.uint32)
    before[1:] = letters[:-1]
    after = np.zeros(len(letters), dtype=np.uint32)
    after[:-1] = letters[1:]
    starts, ends = inner[:-1], inner[1:]
    starts, ends = starts[ends > starts], ends[ends > starts]
    before[starts] = 0
    after[ends - 1] = 0
    at = np.flatnonzero(letters)
    mixed = (before[at] * np.uint32(65537) + letters[at] * np.uint32(257) + after[at]) * np.uint32(2654435761)
    cells = (mixed >> np.uint32(16)).astype(np.int64)
    word = np.flatnonzero(before[at] == 0)
    return cells, word, np.searchsorted(at[word], inner)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for rows, data, offsets in text_slices(batches, "text"):
        cells, word, first = _trigrams(data, offsets)
        bounds = np.concatenate([word, [len(cells)]])[first]
        langs = np.array(rows.column(rows.schema.get_field_index("lang")).to_pylist(), dtype=object)
        owner = np.repeat(np.arange(len(langs)), np.diff(bounds))
        for lang in set(langs.tolist()):
            total = counts.setdefault(lang, np.zeros(CELLS, dtype=np.int64))
            total += np.bincount(cells[(langs == lang)[owner]], minlength=CELLS)
    yield from arrays.pack(counts)


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log chances by language and cell) from the training rows with text and lang.

    A row with a null id trains like any that is not held out.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    blocks = arrays.merged(known.select("text", "lang").mapInArrow(_count, arrays.SCHEMA), lambda name: "sum")
    counts = arrays.collected(blocks, lambda name: CELLS)
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, CELLS), dtype=np.float32)
    table = np.stack([counts[x] for x in langs]).astype(np.float64)
    shared = (table.sum(axis=0) + 0.1) / (table.sum() + 0.1 * CELLS)
    chance = (table + PRIOR * shared) / (table.sum(axis=1, keepdims=True) + PRIOR)
    return langs, np.log(chance).astype(np.float32)


Pieces = Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]]


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows over the texts that have any."""
    return np.add.reduceat(values, first, axis=0, dtype=np.float64)


def mixtures(pieces: Pieces, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(shares by text and language, size of the chosen set) from the words' log likelihoods.

    ``pieces`` gives on every call the same (log likelihoods by word and
    language, first word of each text) blocks; each has words of all the texts.
    """

    def passed(share: np.ndarray, texts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums of the words' shares, of their log likelihoods, and of their slopes) by text."""
        part_of = value = slope = 0.0
        for likely, first in pieces():
            counts = np.diff(np.concatenate([first, [len(likely)]]))
            if texts is not None:
                likely, counts = likely[np.repeat(texts, counts)], counts[texts]
                first = np.cumsum(counts) - counts
            weighed = np.exp(likely - likely.max(axis=1, keepdims=True))
            part = share[np.repeat(np.arange(len(first)), counts)] * weighed
            mixed = np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
            part_of = part_of + _by_text(part / mixed, first)
            value = value + _by_text(np.log(mixed), first)[:, 0]
            slope = slope + _by_text(weighed / mixed, first)
        return part_of, value, slope

    def climb(share: np.ndarray, texts: np.ndarray | None = None) -> np.ndarray:
        for _ in range(ROUNDS):
            part, _, _ = passed(share, texts)
            share = (part / part.sum(axis=1, keepdims=True)).astype(np.float32)
        return share

    counts, single = 0, 0.0
    for likely, first in pieces():
        counts = counts + np.diff(np.concatenate([first, [len(likely)]]))
        # relative to each word's best language, as all likelihoods here
        single = single + _by_text(likely - likely.max(axis=1, keepdims=True), first)
    n_langs = single.shape[1]
    whole = climb(np.full((n_texts, n_langs), 1 / n_langs, dtype=np.float32))
    _, value, slope = passed(whole)
    # no mixture of whatever languages is likelier: the likelihood is concave in the shares
    most = value + counts * np.log(np.maximum(slope.max(axis=1) / counts, 1))
    best = np.zeros_like(whole)
    best[np.arange(n_texts), single.argmax(axis=1)] = 1
    score, size = single.max(axis=1), np.ones(n_texts, dtype=np.int64)
    # the languages of the full mixture, largest share first
    rank = (-whole).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
    penalty = 0.5 * np.log(counts + 1.0) + 3.0
    for k in range(2, n_langs + 1):
        texts = most - penalty * (k - 1) > score
        if not texts.any():
            break
        start = np.where(rank < k, whole + 1e-3, 0).astype(np.float32)[texts]
        share = climb(start / start.sum(axis=1, keepdims=True), texts)
        value = passed(share, texts)[1] - penalty[texts] * (k - 1)
        better = value > score[texts]
        at = np.flatnonzero(texts)[better]
        best[at], score[at], size[at] = share[better], value[better], k
    return best, size


def _word_chances(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihoods of words by language, words before each text and in all)."""
    cells, word, first = _trigrams(data, offsets)
    if not len(word) or not len(table):
        return np.zeros((len(word), len(table)), dtype=np.float32), first
    return np.stack([np.add.reduceat(row[cells], word) for row in table], axis=1), first


def _long_text(data: np.ndarray, a: int, b: int, table: np.ndarray, limit: int, kept: int = KEPT) -> Pieces | None:
    """The words of the one text in bytes a to b in pieces of about ``limit`` bytes, cut between words; none if it has none.

    About the first ``kept`` likelihoods stay in memory, so that it follows
    neither the length of the text nor, in texts that are not huge, the rounds.
    """
    bounds = [a]
    while bounds[-1] < b:
        end = bounds[-1] + limit
        while end < b:  # a word longer than a piece is not cut
            gaps = np.flatnonzero(_LETTER[LOWER[data[max(bounds[-1], end - limit): end]]] == 0)
            if len(gaps):
                end = max(bounds[-1], end - limit) + int(gaps[-1]) + 1
                break
            end += limit
        bounds.append(min(end, b))
    held, rest, cells = [], [], 0
    for p, q in zip(bounds[:-1], bounds[1:]):
        if cells > kept:
            rest.append((p, q))
            continue
        chances, _ = _word_chances(data, np.array([p, q]), table)
        if len(chances):
            held.append((chances, np.zeros(1, dtype=np.int64)))
            cells += chances.size

    def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from held
        for p, q in rest:
            chances, _ = _word_chances(data, np.array([p, q]), table)
            if len(chances):
                yield chances, np.zeros(1, dtype=np.int64)

    return pieces if held else None


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, n_languages) for every row of ``docs`` (doc_id, text); no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((langs, table))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = sent.value
        limit = SLICE // max(4, len(langs))
        for rows, data, offsets in text_slices(batches, "text", limit):
            pred = np.full(rows.num_rows, "und", dtype=object)
            score, size = np.zeros(rows.num_rows), np.zeros(rows.num_rows, dtype=np.int64)
            if langs and rows.num_rows == 1 and offsets[1] - offsets[0] > limit:
                pieces = _long_text(data, int(offsets[0]), int(offsets[1]), table, limit)
                lettered = np.arange(int(pieces is not None))
            else:
                chances, first = _word_chances(data, offsets, table)
                lettered = np.flatnonzero(np.diff(first) > 0)
                block = (chances, first[:-1][lettered])
                pieces = lambda: [block]
            if langs and len(lettered):
                share, chosen = mixtures(pieces, len(lettered))
                best = share.argmax(axis=1)
                pred[lettered] = np.array(langs, dtype=object)[best]
                score[lettered] = np.clip(share[np.arange(len(best)), best], 0, 1)
                size[lettered] = chosen
            folded = LOWER[data[offsets[0]: offsets[-1]]]
            plain = (folded >= 97) & (folded <= 122)
            inner = offsets - offsets[0]
            letters = np.concatenate([[0], np.cumsum(plain)])[inner]
            for i in lettered[np.diff(letters)[lettered] == 0]:
                # only bytes beyond ASCII: they may be signs without a letter among them
                if not any(c.isalpha() for c in data[offsets[i]: offsets[i + 1]].tobytes().decode()):
                    pred[i], score[i], size[i] = "und", 0.0, 0
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(size)],
                ["doc_id", "lang_pred", "score", "n_languages"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_languages long")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_languages), one row for each row of ``docs`` (doc_id, text, lang).

    ``und`` with score 0 where the text is null or has no letter, and
    everywhere if no row has a language to learn.  score is the predicted
    language's share of the document's mixture.  A null id is not held out.
    Equal shares go to the first language by name.  Repeated rows are predicted
    each; an empty table gives no rows; other columns are not read.
    """
    langs, table = learn(docs)
    return predict(docs, langs, table).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_languages"
    )
