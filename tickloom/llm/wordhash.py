"""Words of whole texts as 64-bit numbers, computed on Arrow buffers with NumPy.

Texts are read as UTF-8 bytes; A-Z is folded to a-z; a word is a run of bytes
of a given class.  A word's number is a polynomial of its bytes modulo 2^64,
taken from one running sum, then mixed.  Equal words always get equal numbers;
different ones share a number with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# runs without white space: everything but space and \x09-\x0D
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
# letters and digits: 0-9, a-z (after folding) and all of non-ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U64
)
_PIECE = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _PIECE + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, U64(base), dtype=U64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=U64))
        _powers[:] = tables
    return _powers


def _spans(data: np.ndarray, starts_of_text: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words; a word never reaches over the start of a text."""
    inside = word[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[starts_of_text] = True
    cut[0] = cut[-1] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    return (
        np.flatnonzero(inside & (~before | cut[:-1])),
        np.flatnonzero(inside & (~after | cut[1:])) + 1,
    )


def _hash_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...]) -> np.ndarray:
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
    out = np.empty((len(prefixes) + 1, len(starts)), dtype=U64)
    before, back = total[starts], down[starts]
    for k, upto in enumerate((*(np.minimum(starts + p, ends) for p in prefixes), ends)):
        out[k] = mix((total[upto] - before) * back + (upto - starts).astype(U64))
    return out


def hash_words(
    data: np.ndarray, offsets: np.ndarray, word: np.ndarray = NOT_SPACE, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words in order, first word of each text plus the total).

    ``offsets`` are the texts' byte bounds in ``data``.  The bytes are taken in
    pieces of about a megabyte, cut between words, so the working memory does
    not follow the length of a text.  With ``prefixes`` the numbers are a
    matrix: a row for the words' first p bytes for each p (a shorter word is
    its own prefix), and a last row for the whole words.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    at, hashes, firsts = lo, [], []
    while at < hi:
        end = min(hi, at + _PIECE)
        if end < hi:
            spaces = np.flatnonzero(~word[LOWER[data[at:end]]])
            while not len(spaces) and end < hi:  # one word longer than a piece
                end = min(hi, end + _PIECE)
                spaces = np.flatnonzero(~word[LOWER[data[at:end]]])
            if end < hi:
                end = at + int(spaces[-1]) + 1
        piece = LOWER[data[at:end]]
        inner = offsets[np.searchsorted(offsets, at, "left"): np.searchsorted(offsets, end, "left")] - at
        starts, ends = _spans(piece, inner, word)
        hashes.append(_hash_piece(piece, starts, ends, prefixes))
        firsts.append(starts + at)
        at = end
    if not hashes:
        hashes, firsts = [np.zeros((len(prefixes) + 1, 0), dtype=U64)], [np.zeros(0, dtype=np.int64)]
    numbers = np.concatenate(hashes, axis=1)
    return numbers if prefixes else numbers[0], np.searchsorted(np.concatenate(firsts), offsets, "left")


def byte_windows(data: np.ndarray, size: int) -> np.ndarray:
    """Mixed numbers of all runs of ``size`` bytes, by one running sum."""
    out = []
    # in pieces, so that the working memory does not follow the length
    for at in range(0, len(data) - size + 1, _PIECE - size):
        piece = data[at: at + _PIECE - 1]
        up, down = _power_tables(len(piece) + 1)
        total = np.zeros(len(piece) + 1, dtype=U64)
        np.cumsum((piece.astype(U64) + U64(1)) * up[: len(piece)], out=total[1:])
        part = mix((total[size:] - total[:-size]) * down[: len(piece) - size + 1])
        out.append(part[: _PIECE - size])
    return np.concatenate(out)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Numbers of a text's runs of ``size`` words; a shorter text is one run; no words, none."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, size)
    total = np.full(n - width + 1, U64(width), dtype=U64)
    for k in range(width):
        total += words[k: n - width + 1 + k] * _FACTORS[k]
    return mix(total)


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = _PIECE
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in slices of about ``limit`` bytes of text (a longer text is alone): (rows, bytes, offsets).

    A null text has no bytes.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.null_count:
            texts = texts.fill_null("")
        if pa.types.is_large_string(texts.type):
            width = np.int64
        else:
            width = np.int32
        bounds = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=width)
        bounds = bounds.astype(np.int64)
        body = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), data, bounds[at: end + 1]
            at = end
