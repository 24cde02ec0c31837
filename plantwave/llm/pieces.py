"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; its pieces, scores, types and normaliser settings are read field by field.  From
them a tokenizers model is rebuilt: a unigram model from scores, or a merge model in which every pair
of pieces that makes a piece is a merge and better scores come first; byte fallback for characters
without a piece; a space as the metaspace mark, with one in front of the text where the model asks for it.

Where no piece has the mark after another character, no encoding crosses a space, so texts are cut
before runs of spaces (and around line feeds, if no piece holds one) and each different part is
encoded once per batch, many parts to a call on several threads.  `verify` compares with the
sentencepiece library where it is installed.

Encoding follows sentencepiece: control pieces in a text are ordinary characters, and a mark in the text
counts as a space, which decoding turns into a space.  So decoding gives the text back unless it has that
mark.  A null text counts as empty and has no pieces.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, fields, free, row_batches, tidy

MARK = "▁"
# piece types and model types of the file format
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2


# --- the model file -----------------------------------------------------------------------------------

def _number(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def message(raw: bytes) -> list[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: numbers, or bytes for all else."""
    out, at = [], 0
    while at < len(raw):
        key, at = _number(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(raw, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _number(raw, at)
            value, at = raw[at:at + size], at + size
        out.append((key >> 3, value))
    return out


@dataclass
class PieceModel:
    """What the file says: pieces with scores and types, the kind of model and the normaliser's settings."""
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    add_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True
    charsmap: bytes = b""
    unknown: int = 0


def load(raw: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in message(raw):
        if number == 1:
            piece = dict(message(value))
            model.pieces.append(piece[1].decode())
            model.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            model.types.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(message(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            rules = dict(message(value))
            model.charsmap = rules.get(2, b"")
            model.add_prefix = bool(rules.get(3, 1))
            model.squeeze_spaces = bool(rules.get(4, 1))
            model.escape_spaces = bool(rules.get(5, 1))
    model.unknown = next((i for i, t in enumerate(model.types) if t == UNKNOWN), 0)
    return model


def merges(model: PieceModel) -> list[tuple[str, str]]:
    """Every pair of usable pieces that makes a usable piece, best score first."""
    usable = {p: s for p, s, t in zip(model.pieces, model.scores, model.types) if t in (NORMAL, DEFINED)}
    order = {p: i for i, p in enumerate(model.pieces)}
    found = []
    for piece, score in usable.items():
        for k in range(1, len(piece)):
            left, right = piece[:k], piece[k:]
            if left in usable and right in usable:
                found.append((-score, order[left], order[right], left, right))
    return [f[3:] for f in sorted(found)]


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, normalizers
        with open(path, "rb") as f:
            self.model = model = load(f.read())
        if model.kind == UNIGRAM:
            core = models.Unigram([*zip(model.pieces, model.scores)], unk_id=model.unknown,
                                  byte_fallback=model.byte_fallback)
        elif model.kind == MERGES:
            core = models.BPE({p: i for i, p in enumerate(model.pieces)}, merges(model),
                              unk_token=model.pieces[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
        else:
            raise ValueError(f"model type {model.kind} has no counterpart")
        self.tokenizer = Tokenizer(core)
        if model.charsmap:
            self.tokenizer.normalizer = normalizers.Precompiled(model.charsmap)
        usable = [p for p, t in zip(model.pieces, model.types) if t in (NORMAL, DEFINED)]
        self.apart = model.escape_spaces and not model.charsmap and not any(
            re.search(f"[^{MARK}]{MARK}", p) for p in usable)
        lines = not any("\n" in p for p in usable)
        self.parts = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+" if lines else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.dtype = "<u2" if len(model.pieces) <= 65536 else "<u4"
        self.cache = WordCache(self.tokenizer, self._cut, self.dtype, most=100_000)
        # decoding: the bytes of each piece
        self.bytes = []
        for piece, kind in zip(model.pieces, model.types):
            if kind == BYTE:
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif kind in (CONTROL, UNKNOWN):
                self.bytes.append(b"" if kind == CONTROL else " ⁇ ".encode())
            else:
                self.bytes.append(piece.replace(MARK, " ").encode())

    def normal(self, text: str) -> str:
        """The text as the pieces see it, but for the character map, which the tokenizer applies."""
        if not text:
            return ""
        if self.model.squeeze_spaces:
            text = re.sub(" +", " ", text.strip(" "))
            if not text:
                return ""
        if self.model.add_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape_spaces else text

    def _cut(self, text: str) -> list[str]:
        text = self.normal(text)
        return self.parts.findall(text) if self.apart else [text] if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        return self.cache.encode(texts)

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join([self.bytes[i] for i in ids.tolist()])
        if self.model.add_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    def verify(self, texts: list[str], path: str) -> list[int]:
        """The numbers of texts that the sentencepiece library encodes otherwise."""
        import sentencepiece
        other = sentencepiece.SentencePieceProcessor(model_file=path)
        return [i for i, (a, b) in enumerate(zip(self.encode(texts), other.encode(texts)))
                if np.frombuffer(a, self.dtype).tolist() != b]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per process; its parts outlive a task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


# --- Spark jobs -----------------------------------------------------------------------------------------

def with_pieces(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """`docs` with one more column, the piece ids of the text as array<int>; every row stays.

    A column that already has this name is replaced.
    """
    rows = docs.drop(ids_col)
    names = rows.columns
    text, = free(names, "_text")

    def work(batches):
        used = codec(model_path)
        for batch in row_batches(batches, text):
            packed = used.encode([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), _lists(used, packed)],
                                             [*names, ids_col])

    return rows.withColumn(text, F.col(text_col).cast("string")).mapInArrow(
        tidy(work), f"{fields(rows)}, `{ids_col}` array<int>")


def _lists(used: Codec, packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // np.dtype(used.dtype).itemsize for p in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(packed), used.dtype).astype(np.int32))


def with_text(encoded: DataFrame, model_path: str, ids_col: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """`encoded` with one more column, the text of the ids; null ids give a null."""
    rows = encoded.drop(out)
    names = rows.columns

    def work(batches):
        used = codec(model_path)
        for batch in batches:
            texts = [None if x.values is None else used.decode(x.values.to_numpy()) for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())],
                                             [*names, out])

    return rows.mapInArrow(work, f"{fields(rows)}, `{out}` string")


def encoded_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, piece_ids, their number and crc32 (as little-endian u32), and the round trip.

    `restored` tells whether the decoded ids give the text back, with metaspace marks as spaces.
    """
    def work(batches):
        used = codec(model_path)
        for batch in row_batches(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            packed = used.encode(texts)
            every = [np.frombuffer(p, used.dtype) for p in packed]
            back = [used.decode(i) == t.replace(MARK, " ") for i, t in zip(every, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _lists(used, packed), pa.array([len(i) for i in every], pa.int64()),
                 pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in every], pa.int64()), pa.array(back)],
                ["doc_id", "piece_ids", "n_pieces", "ids_crc32", "restored"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        tidy(work), "doc_id long, piece_ids array<int>, n_pieces long, ids_crc32 long, restored boolean")
