"""Byte-level BPE encoding and decoding through a sentencepiece model built from a rank file.

The rank file lists byte strings with their merge ranks.  From it the driver serialises a sentencepiece BPE model:
every byte string becomes a piece spelled with one printable character per byte, its score is the negative rank, and
the normaliser is the identity without dummy prefix or whitespace escaping.  Sentencepiece merges the adjacent pair
with the highest score, leftmost first, which is the merge of the lowest rank, so that ids equal ranks.  Texts are cut
into pre-tokens by the split pattern, and each pre-token is encoded separately.  Decoding maps ids back to bytes.

Work is per row: no shuffle.  The model (about 1 MB, fixed by the vocabulary) is broadcast.  Each Python worker keeps
the ids of pre-tokens seen before in two tables of bounded size: a full young table becomes the old one, so that common
pre-tokens stay.

Defined cases: a null text encodes as the empty text (no ids, empty bytes); a null id list decodes to empty bytes, and
null ids within a list to nothing; equal rows and ties need no rule; an empty table gives an empty table; other
columns pass through, but for one that has the name of the result, which is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import scratch

#: Distinct pre-tokens in each of a worker's two tables.
KNOWN_PRETOKENS = 120_000
#: Longer pre-tokens are encoded each time they occur.
KNOWN_LENGTH = 64
#: Rows that are handled together.
ROWS_AT_ONCE = 128


def byte_alphabet() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One field in the protocol-buffer wire format."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    letters = byte_alphabet()
    pieces = [_field(1, _field(1, "".join(map(letters.__getitem__, t))) + _field(2, -float(ranks[t])) + _field(3, 1)) for t in tokens]
    unknown = _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, "") for n in (46, 47, 48))
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normalizer)


class Known(dict):
    """Ids by pre-token.  A new pre-token gets an empty list at once, which is filled when its batch is encoded."""

    def __init__(self, old: dict[str, list[int]]):
        self.old, self.pending = old, []

    def __missing__(self, pretoken: str) -> list[int]:
        if pretoken in self.old:
            ids = self.old[pretoken]
        else:
            ids = []
            self.pending.append(pretoken)
        self[pretoken] = ids
        return ids


class Encoder:
    """Ids of texts.  ``model`` is a serialised sentencepiece model, ``ranks`` the ids of whole tokens."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.letters = {b: c for b, c in enumerate(byte_alphabet())}
        self.split = regex.compile(pattern).findall
        self.known = Known({})

    def _encode(self, pretokens: list[str]) -> list[list[int]]:
        raw = [p.encode() for p in pretokens]
        ids = [[self.whole[r]] if r in self.whole else None for r in raw]
        rest = [i for i, found in enumerate(ids) if found is None]
        merged = self.model.encode([raw[i].decode("latin-1").translate(self.letters) for i in rest], num_threads=1) if rest else []
        for i, found in zip(rest, merged, strict=True):
            ids[i] = found
        return ids

    def encode_all(self, texts: list[str]) -> list[list[list[int]]]:
        """For each text, the ids of its pre-tokens."""
        known = self.known
        out = [list(map(known.__getitem__, self.split(text))) for text in texts]
        for pretoken, ids in zip(known.pending, self._encode(known.pending), strict=True):
            known[pretoken].extend(ids)
            if len(pretoken) > KNOWN_LENGTH:
                del known[pretoken]
        known.pending.clear()
        if len(known) > KNOWN_PRETOKENS:
            self.known = Known(dict(known))
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(model: bytes, tokens: list[bytes], pattern: str) -> Encoder:
    key = hashlib.sha256(model + pattern.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model, tokens, pattern)
    return _encoders[key]


def _append(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def _shared(df: DataFrame, ranks_path: str):
    scratch.small_batches(df.sparkSession)
    ranks = read_ranks(ranks_path)
    return df.sparkSession.sparkContext.broadcast((serialize_model(ranks), sorted(ranks, key=ranks.__getitem__)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _encoded(texts: pa.Array, encoder: Encoder) -> pa.ListArray:
    ids = encoder.encode_all([t or "" for t in texts.to_pylist()])
    offsets = np.cumsum([0, *(sum(map(len, pieces)) for pieces in ids)], dtype=np.int32)
    flat = np.fromiter(chain.from_iterable(chain.from_iterable(ids)), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _decoded(lists: pa.ListArray, table: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Gathers the bytes of all ids at once; the values of the gathered array are the decoded texts, end to end."""
    flat = lists.flatten()
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    have = np.asarray(flat.is_valid())
    ids = flat.fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(np.where(have, sizes[ids], 0))])[np.concatenate([[0], np.cumsum(lengths)])]
    raw = table.take(pa.array(ids[have])).buffers()[2] or pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), raw])


def _token_table(tokens: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    return pa.array(tokens, pa.binary()), np.array([len(t) for t in tokens], np.int64)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Appends ``ids_col`` (array of int): the tokens of each whole text."""
    df = scratch.without(df, (ids_col,), (text_col,))
    shared, at = _shared(df, ranks_path), df.columns.index(text_col)
    schema = _append(df, ids_col, T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*shared.value, pattern)
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, _encoded(batch.column(at), encoder)], names=[*batch.schema.names, ids_col])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Appends ``bytes_col`` (binary): the bytes that the ids stand for."""
    df = scratch.without(df, (bytes_col,), (ids_col,))
    shared, at = _shared(df, ranks_path), df.columns.index(ids_col)
    schema = _append(df, bytes_col, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _token_table(shared.value[1])
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(batch.column(at), *tokens)], names=[*batch.schema.names, bytes_col])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Encodes, then decodes the ids, in one pass: ``text_col`` gives way to ``ids_col`` and ``bytes_col``."""
    df = scratch.without(df, (ids_col, bytes_col), (text_col,))
    shared, at = _shared(df, ranks_path), df.columns.index(text_col)
    rest = df.drop(text_col)
    schema = T.StructType([*rest.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(bytes_col, T.BinaryType())])
    kept = [i for i in range(len(df.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*shared.value, pattern)
        tokens = _token_table(shared.value[1])
        for batch in _slices(batches):
            ids = _encoded(batch.column(at), encoder)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), ids, _decoded(ids, *tokens)], names=schema.names)

    return df.mapInArrow(run, schema)


def ids_digest(ids_col: str = "ids"):
    """SHA-256, in hex, of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " ").cast("binary"), 256)
