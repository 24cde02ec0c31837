"""Token ids in compact files: frequency ranks, byte-aligned lengths, control bytes apart.

A file image holds whole documents in order:

    magic ``TIDS1``, then four little-endian u64 numbers: documents, ids, control bytes, data bytes
    document ids (i64 each), 1 where the id is present (u8 each), ids per document (u64 each)
    control stream: two bits per id (its byte length less one), four ids to a byte, each
                    document starting on a new byte
    data stream: the rank of each id, least significant byte first, 1 to 4 bytes

Rank 0 is the most frequent id, so that common ids take one byte.  Ranks come from exact counts
over all documents (ties to the smaller id) and are stored once beside the images.  Images lie in
a Parquet table, one row each, so that Spark's committer writes them on any store it knows and a
repeated task leaves no second copy.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import WordCache, row_batches, staged

MAGIC = b"TIDS1"
#: Ids of one image at most, unless a single document has more.
IMAGE_IDS = 1_000_000
_HEAD = struct.Struct("<5sQQQQ")
#: Byte lengths of the four ids that a control byte describes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


# --- the coding, on numpy arrays --------------------------------------------------------------

def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of documents whose ranks lie end to end, `counts` of them each."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros(int(((counts + 3) // 4).sum()) * 4, dtype=np.uint8)
    four[_slots(counts)] = extra
    control = four[0::4] | four[1::4] << 2 | four[2::4] << 4 | four[3::4] << 6
    wide = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), wide[np.arange(4, dtype=np.uint8) <= extra[:, None]].tobytes()


def _slots(counts: np.ndarray) -> np.ndarray:
    """The place of each id among the four-id groups, where each document starts a new group."""
    blocks = (counts + 3) // 4
    first = np.cumsum(blocks * 4) - blocks * 4
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of all documents of an image, from a table lookup of the control bytes."""
    lengths = LENGTHS[control].ravel()[_slots(counts)]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = data[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        ranks[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def image(doc_ids: list[int | None], rank_arrays: list[np.ndarray]) -> bytes:
    counts = np.array([len(r) for r in rank_arrays], dtype=np.int64)
    control, data = pack(np.concatenate(rank_arrays), counts)
    return b"".join([
        _HEAD.pack(MAGIC, len(doc_ids), int(counts.sum()), len(control), len(data)),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is not None for d in doc_ids], dtype="u1").tobytes(),
        counts.astype("<u8").tobytes(), control, data])


def read_image(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, and the ranks of all documents."""
    magic, docs, ids, n_control, n_data = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token id image")
    at = _HEAD.size
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    present = np.frombuffer(raw, "u1", docs, at + 8 * docs)
    counts = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    if len(raw) != at + n_control + n_data or counts.sum() != ids:
        raise ValueError("damaged token id image")
    control = np.frombuffer(raw, "u1", n_control, at)
    data = np.frombuffer(raw, "u1", n_data, at + n_control)
    return [int(d) if p else None for d, p in zip(doc_ids, present)], counts, unpack(control, data, counts)


# --- Spark jobs ---------------------------------------------------------------------------------

_ENCODERS: dict[tuple, tuple] = {}


def _cut(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


#: ASCII punctuation that ends a word; a tokenizer that splits letters from the rest cuts before it.
_MARKS = ".,;:!?%&#$*|"


class _Direct:
    """Words of letters, with marks after them, straight to the tokenizer's merges.

    Skips the normaliser and the splitter, which leave lower-cased letters in composed form as they are.
    `fits` tells whether this holds for a given tokenizer; it compares both ways on its probe words.
    """

    def __init__(self, tokenizer, dtype: str, most: int = 700_000):
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.code, self.most = np.dtype(dtype).char, most
        splitter = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {b: splitter.pre_tokenize_str(chr(b))[0][0][-1] for b in range(128)}
        for b in range(128, 192):  # continuation and lead bytes of two-byte characters
            self.bytes[b] = splitter.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][-1]
        for b in range(0xC3, 0xCA):
            self.bytes[b] = splitter.pre_tokenize_str(bytes([b, 0x80]).decode())[0][0][0]
        self.ends: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def __call__(self, piece: str) -> bytes | None:
        word = piece.rstrip(_MARKS)
        ids = self.words.get(word)
        if ids is None:
            low = self.spelled(word)
            if low is None:
                return None
            if len(self.words) > self.most:
                self.words.clear()
            ids = self.words[word] = array(self.code, [t.id for t in self.model.tokenize(low)]).tobytes()
        if len(word) == len(piece):
            return ids
        end = piece[len(word):]
        if end not in self.ends:
            if len(self.ends) > self.most:
                self.ends.clear()
            self.ends[end] = array(self.code, self.tokenizer.encode(end, add_special_tokens=False).ids).tobytes()
        return ids + self.ends[end]

    def spelled(self, word: str) -> str | None:
        """The word as the merges know it, or None when it needs the whole tokenizer."""
        if not word.isalpha() or len(word) > 100:
            return None
        low = word.lower()
        if low.isascii():
            return low
        # Latin letters in composed form, one or two bytes each, that lower-case one by one
        if max(word) >= "\u0250" or min(c for c in word if c > "\x7f") < "\xc0" or "\u0130" in word:
            return None
        return low.encode().decode("latin-1").translate(self.bytes)

    def fits(self) -> bool:
        probe = ["the", "Straße,", "été", "Ñandú!!", "ABCdef%%%", "œuvre|", "x", "zażółć.", "señor", "Éa&&&", "don", "ll",
                 "Ümläut;", "ſt", "ǅ", "internationalisation", "re", "ve", "ŋ", "ÿ", "Ÿ?", "ªb", "µm"]
        return all(got is None or array(self.code, got).tolist() == self.tokenizer.encode(
            w, add_special_tokens=False).ids for w in probe for got in [self(w)])


def _encoder(path: str) -> tuple[WordCache, int]:
    """One encoder per Python worker; its piece store outlives a task."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        size = tokenizer.get_vocab_size()
        dtype = "<u2" if size <= 65536 else "<u4"
        direct = _Direct(tokenizer, dtype)
        _ENCODERS[path] = (WordCache(tokenizer, _cut, dtype, direct if direct.fits() else None), size)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """`(doc_id, ids)`: packed ids (u16, or u32 for large vocabularies) with the end id last.

    For tokenizers that drop spaces and line feeds and treat the parts between them separately.  A null
    text counts as empty: its only id is the end id.
    """
    def work(batches) -> Iterator[pa.RecordBatch]:
        cache, _ = _encoder(tokenizer_path)
        end = array(cache.code, [end_id]).tobytes()
        for batch in row_batches(batches, "text", 8_000_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            packed = [ids + end for ids in cache.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())],
                                             ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids binary")


def id_counts(encoded: DataFrame, dtype: str) -> dict[int, int]:
    """How often each id occurs over all documents; as many entries as the vocabulary at most."""
    def work(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype))
            if len(got) > len(total):
                got, total = total, got
            total[:len(got)] += got
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["id", "n"])

    counted = encoded.select("ids").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r.id: r.n for r in counted.collect()}


@dataclass
class IdFiles:
    """Where a written set lies, and how many ids of the vocabulary it can hold."""
    path: str
    vocabulary: int


def write(encoded: DataFrame, path: str, vocabulary: int, image_ids: int = IMAGE_IDS) -> IdFiles:
    """Write images of `(doc_id, ids)` in ascending doc_id order under `path`.

    Null document ids come first; rows with the same id are ordered by length, then by content.
    Documents are dealt by ranges of doc_id, so no task sees more than its range.
    """
    spark = encoded.sparkSession
    dtype = "<u2" if vocabulary <= 65536 else "<u4"
    counts = id_counts(encoded, dtype)
    order = sorted(counts, key=lambda i: (-counts[i], i))
    ranks = np.zeros(max(order, default=0) + 1, dtype=np.uint32)
    ranks[order] = np.arange(len(order), dtype=np.uint32)
    spark.createDataFrame([(np.array(order, dtype="<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(
        f"{path}/ranks")

    def work(batches):
        part, seq, names, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            raw = image(names, held)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([raw], pa.binary())], ["part", "seq", "n_ids", "image"])

        for batch in batches:
            for name, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                got = ranks[np.frombuffer(raw.as_buffer(), dtype)]
                if held and size + len(got) > image_ids:
                    yield flush()
                    seq, names, held, size = seq + 1, [], [], 0
                names.append(name)
                held.append(got)
                size += len(got)
        if held:
            yield flush()

    ordered = encoded.repartitionByRange(F.col("doc_id")).sortWithinPartitions(
        "doc_id", F.length("ids"), F.xxhash64("ids"))
    # ids of this table are already dense; compressing the images again gains nothing
    ordered.mapInArrow(work, "part long, seq long, n_ids long, image binary").write.option(
        "compression", "none").parquet(f"{path}/images")
    return IdFiles(path, vocabulary)


def _documents(spark: SparkSession, files: IdFiles, make, names: list[str], schema: str) -> DataFrame:
    """A row `(part, seq, pos, doc_id, *make(ids))` for each document of the images, ids being packed u32."""
    order = np.frombuffer(spark.read.parquet(f"{files.path}/ranks").first().ids, "<u4")

    def work(batches):
        for batch in batches:
            for part, seq, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "image"))):
                docs, counts, ranks = read_image(raw)
                ids, n, ends = order[ranks], len(docs), np.cumsum(counts)
                made = zip(*(make(ids[e - c:e].tobytes()) for c, e in zip(counts.tolist(), ends.tolist())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array([seq] * n, pa.int64()),
                     pa.array(np.arange(n, dtype=np.int64)), pa.array(docs, pa.int64()), *map(pa.array, made)],
                    ["part", "seq", "pos", "doc_id", *names])

    return spark.read.parquet(f"{files.path}/images").select("part", "seq", "image").mapInArrow(
        work, f"part long, seq long, pos long, doc_id long, {schema}")


def read(spark: SparkSession, files: IdFiles) -> DataFrame:
    """`(part, seq, pos, doc_id, ids)`: the documents of each image in order, original ids as packed u32."""
    return _documents(spark, files, lambda ids: (ids,), ["ids"], "ids binary")


def digests(spark: SparkSession, files: IdFiles) -> DataFrame:
    """Per document, read back from the files: start, n_tokens and the crc32 of its ids as u32.

    The start of an image is a running sum in two levels: over the images of a range, and over
    the ranges, of which there are as many as tasks that wrote them.
    """
    rows = _documents(spark, files, lambda ids: (len(ids) // 4, zlib.crc32(ids)), ["n_tokens", "ids_crc32"],
                      "n_tokens long, ids_crc32 long")
    sizes = spark.read.parquet(f"{files.path}/images").select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    images = sizes.withColumn("image_start", F.coalesce(F.sum("n_ids").over(
        Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = images.join(parts, "part").select("part", "seq", (
        F.col("image_start") + F.col("part_start")).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part", "seq").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None,
                image_ids: int = IMAGE_IDS) -> IdFiles:
    """Encode all documents and write their ids; `path` defaults to a new folder in the shared one."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/token-ids-{uuid4().hex}"
    size = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    encoded = staged(encode(docs, tokenizer_path, end_id), "ids", compression="zstd")
    return write(encoded, path, size, image_ids)
