"""Encoding of a corpus with a public byte-level BPE vocabulary.

The vocabulary (a rank file: base64 token, space, rank) is serialised directly as a
sentencepiece BPE model: every byte string becomes a piece over 256 printable
characters, its score is the negative rank, and nothing is normalised. Texts are cut
into pre-tokens first; the model merges inside each pre-token only.

Defined results: a null and an empty text give an empty list; special-token literals
are plain text; lone surrogates are encoded as U+FFFD; there is one output row per
input row, repeated rows included; extra columns are not read.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The public pre-token pattern of this vocabulary family.
PRETOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for texts of ASCII only, where the standard library's engine is faster.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""

CACHE_ENTRIES = 400_000
CACHE_CHARS = 48


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else from U+0100 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order; ranks must run from 0 without gaps."""
    rows = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in rows)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks are not 0..n-1")
    return [token for _, token in ranked]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised ModelProto: one NORMAL piece per token and an <unk> after the last."""
    shown = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(shown[b] for b in token).encode()
        out += _field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens))
    trainer += b"".join(_varint(f << 3) + _varint((1 << 64) - 1) for f in (41, 42, 43))  # no bos, eos, pad
    normalizer = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class PieceEncoder(dict):
    """Maps a pre-token to its ids; results are kept for short pre-tokens."""

    def __init__(self, tokens: list[bytes]):
        import regex
        import sentencepiece

        super().__init__()
        self.tokens = tokens
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.shown = dict(enumerate(byte_characters()))
        self.plain = re.compile(ASCII_PATTERN)
        self.full = regex.compile(PRETOKEN_PATTERN)

    def __missing__(self, pretoken: str) -> list[int]:
        raw = pretoken.encode("utf-8", "replace")
        ids = self.model.encode(raw.decode("latin-1").translate(self.shown))
        if len(pretoken) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[pretoken] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cut = self.plain if text.isascii() else self.full
        if not text.isascii():
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        return list(chain.from_iterable(map(self.__getitem__, cut.findall(text))))

    def decode(self, ids: Iterable[int]) -> str:
        """The inverse mapping; an unknown id raises."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[int, PieceEncoder] = {}


def encoder(tokens: list[bytes]) -> PieceEncoder:
    """One encoder per Python worker and vocabulary."""
    key = hash((len(tokens), tokens[-1] if tokens else b""))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(tokens)
    return _ENCODERS[key]


def _vocabulary(df: DataFrame, path: str):
    """The driver reads the file once; a vocabulary is about a megabyte, whatever the corpus."""
    return df.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode_corpus(
    documents: DataFrame,
    vocabulary_path: str = DEFAULT_VOCABULARY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(id, ids ARRAY<INT>)`` of every document."""
    rows = spread(documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "id")
    vocabulary = _vocabulary(documents, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for batch in batches:
            lists = [enc.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int64)
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    out = rows.mapInArrow(run, "id bigint, ids array<int>")
    return out.select(F.col("id").alias(id_column), "ids")


def token_counts(
    documents: DataFrame,
    vocabulary_path: str = DEFAULT_VOCABULARY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(id, n_tokens INT)`` of every document; null and empty texts count 0."""
    rows = spread(documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "id")
    vocabulary = _vocabulary(documents, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for batch in batches:
            sizes = [len(enc.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], ["id", "n_tokens"])

    out = rows.mapInArrow(run, "id bigint, n_tokens int")
    return out.select(F.col("id").alias(id_column), "n_tokens")


def decode_corpus(encoded: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY, id_column: str = "doc_id") -> DataFrame:
    """``(id, text)`` of encoded documents; an empty list gives an empty text."""
    vocabulary = _vocabulary(encoded, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary.value
        for batch in batches:
            texts = [
                None if ids is None else b"".join(tokens[i] for i in ids).decode("utf-8", "replace")
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_column).alias("id"), "ids")
    return rows.mapInArrow(run, "id bigint, text string").select(F.col("id").alias(id_column), "text")
