"""Counts of a whole corpus held in NumPy arrays of fixed size.

Every task adds its rows to arrays whose size is a parameter, not the data's,
and hands them out as compressed blocks.  The blocks are dealt out by their
name and merged as a stream, so no task holds more than one block of the
result, and only the merged arrays reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = "name string, block int, dtype string, body binary"
BLOCK = 1 << 16
_MERGE: dict[str, Callable] = {"sum": np.add, "or": np.bitwise_or, "max": np.maximum}


def pack(arrays: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Blocks of one-dimensional arrays; blocks of zeros are left out."""
    packer = zstandard.ZstdCompressor(level=1)
    rows: list[tuple] = []
    for name, values in arrays.items():
        for block in range(0, len(values), BLOCK):
            part = np.ascontiguousarray(values[block: block + BLOCK])
            if part.any():
                rows.append((name, block // BLOCK, part.dtype.str, packer.compress(part.tobytes())))
        if len(rows) >= 64:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, blocks, kinds, bodies = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(names), pa.array(blocks, pa.int32()), pa.array(kinds), pa.array(bodies, pa.binary())],
        ["name", "block", "dtype", "body"],
    )


def _unpack(kind: str, body: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype=kind)


def merged(blocks: DataFrame, how: Callable[[str], str]) -> DataFrame:
    """One row per (name, block): the element-wise sum, or, or max of all tasks' blocks."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        key, total = None, None
        for batch in batches:
            for row in batch.to_pylist():
                part = _unpack(row["dtype"], row["body"])
                if (row["name"], row["block"]) != key:
                    if key is not None:
                        yield _batch([(*key, total.dtype.str, packer.compress(total.tobytes()))])
                    key, total = (row["name"], row["block"]), part.copy()
                else:
                    _MERGE[how(row["name"])](total, part, out=total)
        if key is not None:
            yield _batch([(*key, total.dtype.str, packer.compress(total.tobytes()))])

    dealt = blocks.repartition("name", "block").sortWithinPartitions("name", "block")
    return dealt.mapInArrow(merge, SCHEMA)


def collected(blocks: DataFrame, sizes: Callable[[str], int]) -> dict[str, np.ndarray]:
    """The merged arrays on the driver; their number and size are the caller's parameters."""
    out: dict[str, np.ndarray] = {}
    for row in blocks.toArrow().to_pylist():
        part = _unpack(row["dtype"], row["body"])
        if row["name"] not in out:
            out[row["name"]] = np.zeros(sizes(row["name"]), dtype=part.dtype)
        at = row["block"] * BLOCK
        out[row["name"]][at: at + len(part)] = part
    return out
