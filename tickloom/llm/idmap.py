"""Sets of ids as bit maps of a fixed size, to keep rows that cannot be concerned out of a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import arrays
from tickloom.llm.wordhash import U64
from tickloom.session import cut_lineage

BITS = 25  # four megabytes, whatever the number of ids
_BYTES = 1 << (BITS - 3)


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.view(U64) >> U64(64 - BITS)
    return (h >> U64(3)).astype(np.int64), (h & U64(7)).astype(np.uint8)


def marked(ids: DataFrame) -> np.ndarray:
    """The bit map of the 64-bit hashes in the only column of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(_BYTES, dtype=np.uint8)
        for batch in batches:
            at, bit = _places(batch.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(bits, at, np.uint8(1) << bit)
        yield from arrays.pack({"bits": bits})

    merged = arrays.merged(ids.mapInArrow(run, arrays.SCHEMA), lambda name: "or")
    return arrays.collected(merged, lambda name: _BYTES).get("bits", np.zeros(_BYTES, dtype=np.uint8))


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the set; never false for one that is."""
    at, bit = _places(hashes)
    return (bits[at] >> bit & 1).astype(bool)


def may_be_in(docs: DataFrame, ids: DataFrame) -> Column:
    """Whether a row's doc_id may be among ``ids`` (doc_id); only the ids' hashes are looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(marked(ids.select(F.xxhash64("doc_id"))))

    @F.pandas_udf("boolean")
    def look(h: pd.Series) -> pd.Series:
        return pd.Series(holds(sent.value, h.to_numpy()))

    return look(F.xxhash64("doc_id"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id is in ``ids`` (doc_id).

    Rows that the bit map rules out pass at once; only the others meet the ids
    in a join, so the texts of the rows that stay are not moved.  A row without
    doc_id stays.
    """
    known = cut_lineage(ids.select("doc_id"))
    flag = may_be_in(docs, known)
    return docs.where(~flag).union(docs.where(flag).join(known, "doc_id", "left_anti").select(docs.columns))


def repeated_ids(docs: DataFrame) -> DataFrame:
    """(doc_id): the ids that more than one row has; written, so that it can be read again."""
    return cut_lineage(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))


def with_row_keys(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with doc_id as (doc_id, digest of the text), so that rows of one id differ if their texts do.

    The order of the ids stays; the digest is 0 where no other row has the id.
    A null id stays null.
    """
    digest = F.when(may_be_in(docs, repeated), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    key = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("doc_id"), digest.alias("digest")))
    return docs.select(*[key.alias("doc_id") if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns])


def without_row_keys(docs: DataFrame) -> DataFrame:
    """The ids of ``with_row_keys`` as they were."""
    return docs.select(*[F.col("doc_id.doc_id").alias("doc_id") if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns])
