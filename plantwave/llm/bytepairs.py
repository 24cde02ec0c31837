"""Byte-level BPE over a rank file: the exact merges by longest matches and backtracking.

Merging pair after pair takes time that grows faster than a piece of text.  Here a piece is covered from
left to right instead.  Bytes are read as Latin-1 characters, so that one pyahocorasick automaton over all
tokens gives the longest token that starts at each place.  The cover takes the longest token, then its
longest proper prefix that is a token, and so on, until the token may stand behind the one before it; where none
may, the token before is shortened in the same way, and the place it ended at is never tried again.  So
each place is left at most once and the work is linear in the piece.

Two tokens may stand side by side if merging their joined bytes would keep the cut between them.  That is
read off by undoing merges at the cut, the later one first, and asking at each step whether the two parts
there would have been merged earlier.  Answers are kept between pieces, up to a bound.

This needs a vocabulary in which every token is the merge of two tokens of lower rank, as trained
vocabularies are; a file that breaks this is refused.

Text is cut by the pattern of the vocabulary first.  No match of the pattern crosses the cut before the last
character of a run of white space, so texts are cut there by a plainer pattern, and each different unit
of a batch is matched and encoded once.  Letters and digits are those of the regex library's Unicode version; code
points assigned after the version another library was built with may be cut otherwise there.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, free, row_batches

#: Units, matches of the pattern and token pairs kept between batches, in entries.  Units live in two generations of
#: this size: one that is not met again while the younger fills up goes.
KEPT_UNITS = 160_000
KEPT_PIECES = 200_000
KEPT_PAIRS = 300_000
#: A unit beyond this many characters is not kept.
LONGEST_UNIT = 64
#: Unicode's White_Space, which the patterns of such vocabularies mean by \s.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(f"[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]?[^{_SPACE}]+")
_NO_TOKEN = -1


def load_ranks(path: str) -> list[bytes]:
    """The bytes of each token, by rank, from lines of base64 bytes and rank."""
    found = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks have to run from 0 without a gap")
    return [found[i] for i in range(len(found))]


class BytePairs:
    """Encoder and decoder of one rank file."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import ahocorasick
        import regex
        self.tokens = tokens
        self.pattern = regex.compile(pattern)
        self.rank = {t: i for i, t in enumerate(tokens)}
        if len(self.rank) != len(tokens) or any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("tokens have to be distinct and to include every single byte")
        self.length = [len(t) for t in tokens]
        self.parts = [self._parts(t) for t in tokens]
        self.merged = {p: i for i, p in enumerate(self.parts) if p is not None}
        self.known = {t.decode("latin-1"): i for i, t in enumerate(tokens)}
        self.first = dict(self.known)  # and, once met, paths that lead to longer tokens: one for each prefix of a token at most
        self.most = max(self.length)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.known.items():
            self.automaton.add_word(token, i)
        self.shorter = [self._shorter(t) for t in tokens]
        self.names = [str(i) for i in range(len(tokens))]
        self.fits: dict[tuple[int, int], bool] = {}
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _parts(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge is this one; None for a single byte."""
        if len(token) == 1:
            return None
        own, parts = self.rank[token], [self.rank[token[k:k + 1]] for k in range(len(token))]
        while len(parts) > 2:
            ranks = [self.rank.get(self.tokens[a] + self.tokens[b], own) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best >= own:
                raise ValueError(f"token {own} is not the merge of two tokens of lower rank")
            k = ranks.index(best)
            parts[k:k + 2] = [best]
        return parts[0], parts[1]

    def _shorter(self, token: bytes) -> int:
        """The longest proper prefix of a token that is a token."""
        for k in range(len(token) - 1, 0, -1):
            found = self.rank.get(token[:k])
            if found is not None:
                return found
        return _NO_TOKEN

    def _longest(self, path: str) -> int:
        """The longest token that a path of the automaton starts with; a single byte at least."""
        return next(self.known[path[:k]] for k in range(len(path), 0, -1) if path[:k] in self.known)

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens keeps the cut between them."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            known = self.fits[left, right] = self._keeps_cut(left, right)
        return known

    def _keeps_cut(self, left: int, right: int) -> bool:
        """Walk back in time: before rank `now`, the parts at the cut are `left` and `right`.

        A merge of the two that comes before `now`, when both were there already, would have crossed the cut.
        Equal ranks merge from left to right, so the right part counts as made just after the left.
        """
        now = len(self.tokens) + 1
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and crossing < now:
                return False
            whole_left, whole_right = self.parts[left] is None, self.parts[right] is None
            if whole_left and whole_right:
                return True
            # single bytes were there from the start
            if whole_right or (not whole_left and left > right):
                now, left = left, self.parts[left][1]
            else:
                now, right = right + 1, self.parts[right][0]

    def cover(self, piece: str) -> list[int]:
        """The ids of a piece that merges treat as a whole, its bytes as Latin-1 characters."""
        first, length, shorter, fits = self.first, self.length, self.shorter, self.fits
        whole = self.known.get(piece)
        if whole is not None:
            return [whole]
        reach, most, size = self.automaton.longest_prefix, self.most, len(piece)
        left_for_good = bytearray(size + 1)
        out: list[int] = []
        at, token = 0, _NO_TOKEN
        while at < size:
            if token < 0:
                ahead = piece[at:at + most]
                ahead = ahead[:reach(ahead)]
                token = first.get(ahead)
                if token is None:
                    token = first[ahead] = self._longest(ahead)
            end = at + length[token]
            if left_for_good[end]:
                good = False
            elif not out:
                good = True
            else:
                good = fits.get((out[-1], token))
                if good is None:
                    good = self.side_by_side(out[-1], token)
            if good:
                out.append(token)
                at = end
                token = _NO_TOKEN
                continue
            token = shorter[token]
            if token < 0:  # nothing may start here: shorten the token before
                left_for_good[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def _unit(self, unit: str) -> bytes:
        """The ids of a unit, packed.  Most new units are known words with other signs around them, so matches are kept too."""
        pieces, out = self.pieces, []
        for piece in self.pattern.findall(unit):
            packed = pieces.get(piece)
            if packed is None:
                packed = array("i", self.cover(piece if piece.isascii() else piece.encode().decode("latin-1"))).tobytes()
                if len(piece) <= LONGEST_UNIT:
                    if len(pieces) >= KEPT_PIECES:
                        pieces.clear()
                    pieces[piece] = packed
            out.append(packed)
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit integers."""
        cut = [_UNITS.findall(t) for t in texts]
        ids: dict[str, bytes] = {}
        for unit in set().union(*cut):
            packed = self.units.get(unit)
            if packed is None:
                packed = self.older.get(unit)
                if packed is None:
                    packed = self._unit(unit)
                if len(unit) <= LONGEST_UNIT:
                    if len(self.units) >= KEPT_UNITS:
                        self.older, self.units = self.units, {}
                    self.units[unit] = packed
            ids[unit] = packed
        return [b"".join(map(ids.__getitem__, row)) for row in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def decimal(self, ids: np.ndarray) -> str:
        """The ids in decimal digits, joined by one space."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


_CODECS: dict[tuple[str, str], BytePairs] = {}


def codec(path: str, pattern: str) -> BytePairs:
    """The codec a worker process uses; it keeps one at a time."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = BytePairs(load_ranks(path), pattern)
    return _CODECS[key]


def _lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(packed), np.int32))


def with_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text",
                out: str = "token_ids") -> DataFrame:
    """`docs` with one more column, the token ids of the whole text as array<int>; every row stays.

    A null text counts as empty and has no ids.  Special tokens in a text are ordinary text.  A column that
    already has this name is replaced; an empty table gives an empty table.
    """
    rows = docs.drop(out)
    names = rows.columns
    text, = free(names, "_text")

    def work(batches):
        used = codec(path, pattern)
        for batch in row_batches(batches, text):
            packed = used.encode([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), _lists(packed)], [*names, out])

    return rows.withColumn(text, F.col(text_col).cast("string")).mapInArrow(work, f"{fields(rows)}, `{out}` array<int>")


def with_bytes(encoded: DataFrame, path: str, pattern: str, ids_col: str = "token_ids",
               out: str = "decoded") -> DataFrame:
    """`encoded` with one more column, the bytes of the ids; null ids give a null.

    Bytes, not text: ids from elsewhere may end inside a character.
    """
    rows = encoded.drop(out)
    names = rows.columns

    def work(batches):
        used = codec(path, pattern)
        for batch in batches:
            raw = [None if x.values is None else used.decode(x.values.to_numpy()) for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(raw, pa.binary())],
                                             [*names, out])

    return rows.mapInArrow(work, f"{fields(rows)}, `{out}` binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, the SHA-256 of its decimal ids and of the bytes decoded from them.

    One row for each row of `docs`, also for null, empty and repeated ones; a null text counts as empty.
    Ids are packed and unpacked in the same task, so that texts cross to Python once.
    """
    def work(batches):
        used = codec(path, pattern)
        for batch in row_batches(batches, "text"):
            counts, ids_hash, bytes_hash = [], [], []
            for packed in used.encode([t or "" for t in batch.column("text").to_pylist()]):
                ids = np.frombuffer(packed, np.int32)
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(used.decimal(ids).encode()).hexdigest())
                bytes_hash.append(hashlib.sha256(used.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()),
                 pa.array(bytes_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, f"{fields(rows.select('doc_id'))}, n_tokens long, ids_sha256 string, "
                                 "decoded_sha256 string")
