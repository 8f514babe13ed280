"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last 16 bytes says so, so equal
passages are cut alike in every document.  A chunk is encoded once and its ids
are used again wherever a task meets it.  A cut may fall inside a token, so
every join is repaired: the text from the last sure boundary before the cut to
the first one after it is encoded anew, and the chunks' ids up to and from
there are kept once the ids' byte lengths meet those boundaries exactly; if
they do not, the repair reaches for the next boundary on either side.

A sure boundary is a space between two ASCII letters or digits: the
pre-tokenizer starts a new piece there whatever stands around it.

Chunks of characters below U+0250 are encoded by tiktoken with the ranks of the
same vocabulary, others by the tokenizers library itself; both give the same
ids.  The vocabulary file is read on the driver and sent to the tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickloom.llm.wordhash import U64, byte_windows, text_slices

SPAN = 16  # bytes the rolling hash sees
CUT_BITS = 10  # a cut every 1024 bytes, about
LEAST, MOST = 256, 1 << 16  # bytes of a chunk; a longer one is cut at MOST
REUSE_BYTES = 32 << 20  # chunk texts a task remembers, about
# fixed value: the split pattern of byte-level BPE vocabularies of this kind
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND = re.compile("[ɐ-\U0010ffff]")
_SURE = np.zeros(256, dtype=bool)
_SURE[48:58] = _SURE[65:91] = _SURE[97:123] = True


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + k)] = b
    return letters


class Vocabulary:
    """One tokenizer, ready in a task: encoding of single texts, token bytes, special tokens."""

    def __init__(self, body: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(body)
        self.library = Tokenizer.from_str(body)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = _byte_letters()
        ids = spec["model"]["vocab"]
        token_bytes = {i: bytes(letters[c] for c in t) for t, i in ids.items() if t not in self.special}
        token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.bytes = [token_bytes[i] for i in range(max(token_bytes) + 1)]
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        # ranks are only the same model if merges come in the order of their ids
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        plain = not spec.get("normalizer") and spec["pre_tokenizer"]["type"] == "ByteLevel"
        plain = plain and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"]["add_prefix_space"]
        self.fast = None
        if plain and all(ids[a + b] == 256 + k for k, (a, b) in enumerate(merges)):
            ranks = {b: i for i, b in token_bytes.items() if i not in self.special.values()}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        named = sorted((t.encode() for t in self.special), key=len, reverse=True)
        self.split = re.compile(b"|".join(map(re.escape, named))) if named else None

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens."""
        if self.fast and (text.isascii() or not _BEYOND.search(text)):
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(sent) -> Vocabulary:
    """The vocabulary of a broadcast value, built once in a worker."""
    key = hash(sent.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(sent.value)
    return _loaded[key]


def cuts(data: np.ndarray) -> np.ndarray:
    """Where the rolling hash cuts, in bytes; never inside a character."""
    if len(data) <= SPAN:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(byte_windows(data, SPAN) >> U64(64 - CUT_BITS) == 0) + SPAN
    # to the start of the next character
    for _ in range(3):
        inside = at < len(data)
        inside[inside] = (data[at[inside]] & 0xC0) == 0x80
        at = at + inside
    return at


def _chunk_ends(possible: np.ndarray, data: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of data[start:end]."""
    ends, at = [], start
    inner = possible[np.searchsorted(possible, start): np.searchsorted(possible, end)]
    for cut in [*inner.tolist(), end]:
        while cut - at > MOST:
            far = at + MOST
            while far > at and (data[far] & 0xC0) == 0x80:
                far -= 1
            ends.append(far)
            at = far
        if cut == end or cut - at >= LEAST:
            ends.append(cut)
            at = cut
    return ends


class ChunkEncoder:
    """Encodes texts chunk by chunk and remembers the chunks' ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.young: dict[bytes, np.ndarray] = {}
        self.old: dict[bytes, np.ndarray] = {}
        self.held = 0
        self.chunks = self.reused = 0

    def chunk(self, text: bytes) -> np.ndarray:
        self.chunks += 1
        ids = self.young.get(text)
        if ids is None:
            ids = self.old.get(text)
            if ids is None:
                ids = self.vocabulary.encode(text.decode())
            else:
                self.reused += 1
            # two generations: the older one goes when the younger is full
            self.young[text] = ids
            self.held += len(text) + ids.nbytes
            if self.held > REUSE_BYTES:
                self.old, self.young, self.held = self.young, {}, 0
        else:
            self.reused += 1
        return ids

    def segment(self, data: np.ndarray, start: int, end: int, possible: np.ndarray, sure: np.ndarray) -> list[np.ndarray]:
        """Ids of data[start:end], which holds no special token."""
        ends = _chunk_ends(possible, data, start, end)
        begins = [start, *ends[:-1]]
        ids = [self.chunk(data[a:b].tobytes()) for a, b in zip(begins, ends)]
        if len(ids) == 1:
            return ids
        bounds = [np.concatenate([[a], a + np.cumsum(self.vocabulary.lengths[x])]) for a, x in zip(begins, ids)]
        out: list[np.ndarray] = []
        done, k = start, 0  # all ids up to byte ``done`` are out; ``done`` lies in chunk k
        while True:
            if k == len(ids) - 1:
                out.append(ids[k][np.searchsorted(bounds[k], done):])
                return out
            # the last sure boundary before the cut that the left chunk's ids meet
            cut = ends[k]
            left = self._meets(sure, bounds[k], max(done, begins[k]), cut, backwards=True)
            if left is None:
                left = done
            else:
                out.append(ids[k][np.searchsorted(bounds[k], done): np.searchsorted(bounds[k], left)])
            # the first one after it that a right chunk's ids meet; chunks in between are encoded again
            right, j = None, k
            while right is None and j < len(ids) - 1:
                j += 1
                right = self._meets(sure, bounds[j], begins[j], ends[j], backwards=False)
            upto = end if right is None else right
            if upto > left:
                out.append(self.vocabulary.encode(data[left:upto].tobytes().decode()))
            if right is None:
                return out
            done, k = right, j

    @staticmethod
    def _meets(sure: np.ndarray, bounds: np.ndarray, low: int, high: int, backwards: bool) -> int | None:
        """A sure boundary in [low, high] at which a token starts; the nearest to the cut."""
        places = sure[np.searchsorted(sure, low): np.searchsorted(sure, high, "right")]
        for place in (places[::-1] if backwards else places).tolist():
            at = np.searchsorted(bounds, place)
            if at < len(bounds) and bounds[at] == place:
                return place
        return None


def _sure_boundaries(data: np.ndarray) -> np.ndarray:
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero((data[1:-1] == 32) & _SURE[data[:-2]] & _SURE[data[2:]]) + 1


def encode_texts(data: np.ndarray, offsets: np.ndarray, encoder: ChunkEncoder) -> Iterator[np.ndarray]:
    """The ids of each text in ``data``, as unsigned 32-bit numbers."""
    vocabulary = encoder.vocabulary
    for a, b in zip(offsets[:-1], offsets[1:]):
        text = data[a:b]
        if not len(text):
            yield np.zeros(0, dtype=np.uint32)
            continue
        possible, sure = cuts(text), _sure_boundaries(text)
        parts = []
        for start, end, token in _segments(text.tobytes(), len(text), vocabulary):
            if end > start:
                parts += encoder.segment(text, start, end, possible, sure)
            if token is not None:
                parts.append(np.array([token], dtype=np.uint32))
        yield np.concatenate(parts).astype(np.uint32, copy=False) if parts else np.zeros(0, dtype=np.uint32)


def _segments(raw: bytes, size: int, vocabulary: Vocabulary) -> Iterator[tuple[int, int, int | None]]:
    """(start, end, special id behind it) of the stretches between special tokens."""
    at = 0
    for m in vocabulary.split.finditer(raw) if vocabulary.split else ():
        yield at, m.start(), vocabulary.special[m[0].decode()]
        at = m.end()
    yield at, size, None


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """``docs`` with a column of ids (little-endian unsigned 32-bit numbers, binary) and their number.

    Special token strings in a text become their ids, as the tokenizers library
    does by default.  A null text is an empty one and has no ids; columns of the
    new names are replaced; no shuffle.  ``tokenizer`` is the path of a
    tokenizers JSON file, read on the driver.
    """
    with open(tokenizer, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    base = docs.drop(ids, count)
    schema = T.StructType([*base.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(_vocabulary(sent))
        for rows, data, offsets in text_slices(batches, text):
            found = list(encode_texts(data, offsets, encoder))
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.columns,
                    pa.array([x.astype("<u4", copy=False).tobytes() for x in found], pa.binary()),
                    pa.array([len(x) for x in found], pa.int64()),
                ],
                schema.names,
            )

    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""
    with open(tokenizer, encoding="utf-8") as file:
        sent = encoded.sparkSession.sparkContext.broadcast(file.read())
    base = encoded.drop(text)
    place = base.columns.index(ids)
    schema = T.StructType([*base.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(sent)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts = [
                    vocabulary.decode(np.frombuffer(x or b"", dtype="<u4")).decode("utf-8", "replace")
                    for x in rows.column(place).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], schema.names)

    return base.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each row of ``docs`` (doc_id, text).

    A null text is an empty one; a null id stays; repeated rows are encoded
    each; an empty table gives no rows; other columns are not read.  Ids are
    encoded, decoded and digested in one pass, so a task needs one worker with
    one vocabulary and no id leaves it.
    """
    with open(tokenizer, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    base = docs.select("doc_id", "text")
    schema = T.StructType([
        base.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(_vocabulary(sent))
        for rows, data, offsets in text_slices(batches, "text"):
            sizes, encoded, decoded = [], [], []
            for ids in encode_texts(data, offsets, encoder):
                sizes.append(len(ids))
                encoded.append(sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest())
                text = encoder.vocabulary.decode(ids).decode("utf-8", "replace")
                decoded.append(sha256(text.encode()).hexdigest())
            columns = [pa.array(sizes, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], schema.names)

    return base.mapInArrow(run, schema)
