"""Encoding of text with a public byte-level BPE vocabulary.

The ranks of the vocabulary are written out directly as a sentencepiece BPE model: every token's bytes
are mapped to one visible character each, the piece's score is its negative rank, normalisation is
identity. sentencepiece merges the pair with the best score first, which is the merge with the lowest
rank, so encoding a pre-token gives the vocabulary's own ids. Pre-tokens come from the vocabulary's
public pattern. Decoding maps pieces back to bytes.

Text is cut at single spaces between non-space characters first: no pre-token spans such a cut and none
depends on what lies beyond it, so equal pieces have equal ids and are looked up in a bounded table.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabulary files; a parameter of every function that reads one.
TOKENIZER_DIR = os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's lookup table before it is emptied, and the longest piece kept in it.
TABLE_SIZE, TABLE_PIECE = 200_000, 48

_SLOW_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r"^ | $| \s|\s ")


def byte_characters() -> list[str]:
    """One visible character for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def read_vocabulary(folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> list[bytes]:
    """Tokens by rank."""
    pairs = [line.split() for line in Path(folder, name).read_bytes().splitlines() if line]
    return [base64.b64decode(token) for token, rank in sorted(pairs, key=lambda p: int(p[1]))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def bpe_model(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose ids are the vocabulary's ranks (the unknown piece comes last)."""
    chars = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _message(1, _message(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    normal, unknown, bpe = 1, 2, 2
    pieces = b"".join(piece("".join(chars[b] for b in token), -float(rank), normal) for rank, token in enumerate(vocabulary))
    none = (1 << 64) - 1  # -1: there is no such piece
    trainer = _number(3, bpe) + _number(4, len(vocabulary) + 1) + _number(40, len(vocabulary)) + b"".join(_number(f, none) for f in (41, 42, 43))
    normalizer = _message(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return pieces + piece("<unk>", 0.0, unknown) + _message(2, trainer) + _message(3, normalizer)


class Encoder:
    """Ids of texts by one serialised model."""

    def __init__(self, model: bytes) -> None:
        import regex
        import sentencepiece

        self._processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._pretokens = regex.compile(PATTERN).findall
        self._map = dict(enumerate(byte_characters()))
        self._inverse = {c: b for b, c in self._map.items()}
        self._table: dict[str, array] = {}

    def _piece_ids(self, piece: str) -> array:
        ids: array = array("i")
        for word in self._pretokens(piece):
            if (known := self._table.get(word)) is None:
                known = array("i", self._processor.encode(word.encode().decode("latin-1").translate(self._map)))
                if len(word) <= TABLE_PIECE:
                    self._table[word] = known
            ids.extend(known)
        return ids

    def encode(self, text: str | None) -> array:
        """Null and empty texts have no ids. Lone surrogates, which UTF-8 has not, become '?'."""
        ids: array = array("i")
        if not text:
            return ids
        try:
            text.encode()
        except UnicodeEncodeError:
            text = text.encode(errors="replace").decode()
        if len(self._table) > TABLE_SIZE:
            self._table.clear()
        pieces = _SLOW_CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        table, lead = self._table, ""
        for piece in pieces:
            piece = lead + piece
            lead = " "
            known = table.get(piece)
            if known is None:
                known = self._piece_ids(piece)
                if len(piece) <= TABLE_PIECE:
                    table[piece] = known
            ids += known
        return ids

    def decode(self, ids: list[int]) -> str:
        return bytes(self._inverse[c] for i in ids for c in self._processor.id_to_piece(int(i))).decode(errors="replace")


_encoders: dict[int, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    """One encoder a worker process: its lookup table serves all tasks that follow."""
    key = hash(model)
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def _run(df: DataFrame, key: str, text: str, output: T.DataType, build, folder: str) -> DataFrame:
    source = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    model = df.sparkSession.sparkContext.broadcast(bpe_model(read_vocabulary(folder)))  # of fixed size: the vocabulary
    schema = T.StructType([T.StructField("_key", source.schema["_key"].dataType), T.StructField("_out", output)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(model.value).encode
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), build(encode, part.column(1).to_pylist())], names=["_key", "_out"])

    return source.mapInArrow(run, schema)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids): ids of every row's text without special tokens; null and empty texts have an empty list.

    One narrow pass, no shuffle. Rows are kept as they are (repeated keys too); other columns are ignored.
    """

    def build(encode, texts: list[str | None]) -> pa.Array:
        flat, offsets = array("i"), [0]
        for t in texts:
            flat += encode(t)
            offsets.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32)))

    return _run(df, key, text, T.ArrayType(T.IntegerType()), build, folder).toDF(key, "ids")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, n_tokens): the lengths of encode_texts' lists, without moving the lists."""
    return _run(df, key, text, T.IntegerType(), lambda encode, texts: pa.array([len(encode(t)) for t in texts], pa.int32()), folder).toDF(key, "n_tokens")
