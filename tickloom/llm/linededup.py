"""Substring dedup by hashing of lines and the sentences in them.

A unit is a line or a sentence of a line (a line of one sentence is one unit), so
units never reach over a line.  Units are normalised (A-Z folded, white space
runs as one space, trimmed), their 128-bit digests are grouped over all
documents, and the occurrence with the least (doc_id, offset) is kept.  A later
line is taken out, and so is a later sentence in a run of at least ``MIN_BYTES``
bytes of repeated units: a short sentence that many texts share is not a
passage.  What is taken out is reported by its offsets in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import idmap
from tickloom.llm.wordhash import LOWER, text_slices

# bytes count scripts without spaces too: a letter of theirs, three bytes, says about as much as half a word
MIN_BYTES = 40
_SPACE = rb"[ \t\r\x0b\x0c]"
# the ends 。｡！？ need no white space behind them; closing quotes and brackets belong to the sentence
_WIDE = rb"(?:\xe3\x80\x82|\xef\xbd\xa1|\xef\xbc[\x81\x9f])"
_CLOSING = rb"(?:\xe3\x80[\x8d\x8f]|\xef\xbc\x89|\xe2\x80[\x99\x9d])"
_INNER = rb"(?:[^\n.!?\xe3\xef]++|\xe3(?!\x80\x82)|\xef(?!\xbd\xa1|\xbc[\x81\x9f]))*+"
# a line break belongs to the unit before it; so does the white space behind a sentence
_UNIT = re.compile(
    _INNER + rb"(?:[.!?]++(?!" + _SPACE + rb"|\n)" + _INNER + rb")*+"
    rb"(?:[.!?]++" + _SPACE + rb"*+\n?|" + _WIDE + rb"++" + _CLOSING + rb"*+" + _SPACE + rb"*+\n?|\n|\Z)"
)
_FOLD = LOWER.tobytes()


def units(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of a text's units, in order and without gaps."""
    return [m.span() for m in _UNIT.finditer(text) if m.end() > m.start()]


def lines(text: bytes, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(first unit, one past the last) of each line."""
    first = 0
    for k, (_, b) in enumerate(spans, 1):
        if k == len(spans) or text[b - 1: b] == b"\n":
            yield first, k
            first = k


def _normal(unit: bytes) -> list[bytes]:
    return unit.translate(_FOLD).split()


def _digest(words: list[bytes]) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(b" ".join(words))
    low, high = value & ((1 << 64) - 1), value >> 64
    return low - (1 << 64) * (low >> 63), high - (1 << 64) * (high >> 63)


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for rows, data, offsets in text_slices(batches, column):
        whole = data[offsets[0]: offsets[-1]].tobytes()
        at = offsets - offsets[0]
        yield rows, [whole[a:b] for a, b in zip(at[:-1], at[1:])]


def unit_rows(docs: DataFrame) -> DataFrame:
    """(d1, d2, doc_id, pos): the digest of every unit that has words, by document and place.

    The place of sentence k is 2 k; that of a line of several sentences from k
    on is 2 k + 1.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _texts(batches, "text"):
            low, high, owner, pos = [], [], [], []
            for i, text in enumerate(texts):
                spans = units(text)
                for first, end in lines(text, spans):
                    line: list[bytes] = []
                    found = 0
                    for k in range(first, end):
                        words = _normal(text[spans[k][0]: spans[k][1]])
                        if words:
                            line, found = line + words if found else words, found + 1
                            d = _digest(words)
                            low.append(d[0])
                            high.append(d[1])
                            owner.append(i)
                            pos.append(2 * k)
                    if found > 1:
                        d = _digest(line)
                        low.append(d[0])
                        high.append(d[1])
                        owner.append(i)
                        pos.append(2 * first + 1)
            if owner:
                ids = rows.column(rows.schema.get_field_index("doc_id")).take(pa.array(owner, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low, pa.int64()), pa.array(high, pa.int64()), ids, pa.array(pos, pa.int32())],
                    ["d1", "d2", "doc_id", "pos"],
                )

    schema = T.StructType([
        T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("doc_id", kind),
        T.StructField("pos", T.IntegerType()),
    ])
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, schema)


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, positions): the places of the units of each document that an earlier occurrence makes superfluous.

    The first occurrence is a grouped minimum that combines before its shuffle,
    joined back to the units, so a unit that a third of all rows hold is split
    like any skewed join key.
    """
    found = unit_rows(docs)
    firsts = (
        found.groupBy("d1", "d2")
        .agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("d1", "d2", F.col("first.doc_id").alias("first_id"), F.col("first.pos").alias("first_pos"))
    )
    later = found.join(firsts, ["d1", "d2"]).where("doc_id <> first_id OR pos <> first_pos")
    return later.groupBy("doc_id").agg(F.collect_set("pos").alias("positions"))


def _cut(text: bytes, positions: set[int], min_bytes: int, min_line: int) -> tuple[bytes, list[dict]]:
    """The text without its repeated lines and runs of repeated units of enough bytes, and their spans in code points."""
    spans = units(text)
    size = [len(b" ".join(text[a:b].split())) for a, b in spans]
    gone = [False] * len(spans)
    repeated_ = [2 * k in positions for k in range(len(spans))]
    for first, end in lines(text, spans):
        full = [k for k in range(first, end) if size[k]]
        if 2 * first + 1 in positions or (len(full) == 1 and repeated_[full[0]]):
            for k in range(first, end):
                repeated_[k] = True
                gone[k] = sum(size[first:end]) >= min_line
    k = 0
    while k < len(spans):
        if not repeated_[k]:
            k += 1
            continue
        start, total, last = k, 0, k
        # units without words between repeated ones do not end a run
        while k < len(spans) and (repeated_[k] or not size[k]):
            if size[k]:
                total, last = total + size[k], k
            k += 1
        if total >= min_bytes:
            gone[start: last + 1] = [True] * (last + 1 - start)
    drop: list[tuple[int, int]] = []
    for (a, b), out_ in zip(spans, gone):
        if out_ and drop and drop[-1][1] == a:
            drop[-1] = (drop[-1][0], b)
        elif out_:
            drop.append((a, b))
    if not drop:
        return text, []
    kept, at, chars, out = [], 0, 0, []
    for a, b in drop:
        chars += len(text[at:a].decode())
        size = len(text[a:b].decode())
        out.append({"start": chars, "end": chars + size})
        kept.append(text[at:a])
        chars, at = chars + size, b
    kept.append(text[at:])
    return b"".join(kept), out


def dedup(docs: DataFrame, removed: str = "removed", min_bytes: int = MIN_BYTES, min_line: int = MIN_BYTES) -> DataFrame:
    """``docs`` with the repeated passages cut from ``text``, and their spans in column ``removed``.

    Repeated sentences inside lines go in runs of ``min_bytes`` or more, and
    repeated lines of ``min_line`` bytes or more; 1 takes every later line.

    ``removed`` is an array of (start, end) code point offsets in the original
    text; a column of that name is replaced.  Nulls: a null text stays null; a
    row without doc_id is neither compared nor cut.  Rows that repeat a doc_id
    and its text are one document, that stays in each; rows of one doc_id with
    other texts are documents of their own.  A document all of whose units are repeated is left with an
    empty text; an empty table gives no rows.
    """
    mark = "_positions"
    while mark in docs.columns:
        mark += "_"
    base = docs.drop(removed)
    twice = idmap.repeated_ids(base)
    if not twice.isEmpty():
        return idmap.without_row_keys(_dedup(idmap.with_row_keys(base, twice), removed, mark, min_bytes, min_line))
    return _dedup(base, removed, mark, min_bytes, min_line)


def _dedup(base: DataFrame, removed: str, mark: str, min_bytes: int, min_line: int) -> DataFrame:
    marked = base.join(repeated(base).withColumnRenamed("positions", mark), "doc_id", "left").select(
        *[base[f"`{c}`"] for c in base.columns], mark
    )
    place = base.columns.index("text")
    schema = T.StructType([
        *base.schema.fields,
        T.StructField(removed, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _texts(batches, "text"):
            *cols, marks = rows.columns
            kept, cut = [], []
            for text, positions, there in zip(texts, marks.to_pylist(), np.asarray(cols[place].is_valid())):
                new, out = _cut(text, set(positions), min_bytes, min_line) if positions else (text, [])
                kept.append(new if there else None)
                cut.append(out)
            cols[place] = pa.array(kept, pa.binary()).cast(cols[place].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cut, spans)], [*rows.schema.names[:-1], removed])

    return marked.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_removed, chars_removed, removed, text): what ``dedup`` takes out and leaves, for every row, with every later line."""
    cut = dedup(docs.select("doc_id", "text"), min_line=1)
    return cut.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("chars_removed"),
        "removed",
        "text",
    )
