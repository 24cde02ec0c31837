"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
from array import array
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Characters of text handled at a time inside a task; one longer text is a batch of its own.
CHARS_AT_A_TIME = 3_000_000


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write `df` to the shared folder and read it back: a lost executor costs no more than a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Fewer rows to an Arrow batch than Spark's default, as texts are long; a session's own choice stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def row_batches(batches: Iterable[pa.RecordBatch], text: str,
                most: int = CHARS_AT_A_TIME) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one piece have about `most` bytes in all."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = np.nan_to_num(np.asarray(pc.binary_length(batch.column(text)).to_numpy(
            zero_copy_only=False), dtype=np.float64)).astype(np.int64)
        piece = (np.cumsum(lengths) - lengths) // most
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            yield batch.slice(start, end - start)


def give_back() -> None:
    """Return freed memory of this worker process to the system.

    Workers outlive tasks, and several wait on one machine; what they hold on to is memory others lack.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(work: Callable) -> Callable:
    """A function over batches that gives memory back when its task's batches are through."""
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()
    return run


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def spread_sample(df: DataFrame, key: Column, rows: int, seed: int) -> DataFrame:
    """About `rows` rows of `df`, chosen by a hash of `key`: the same rows in each run."""
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * 2**40)
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2**40)) < share).limit(2 * rows)


class WordCache:
    """Ids of texts through a tokenizer that never joins text across certain cuts.

    `cut` splits a text into pieces whose encodings, put one after another, are the encoding of
    the whole.  Pieces repeat a lot, so each goes to the library once per call of `encode`, many at
    a time; it encodes them on several threads.  `direct`, if given, may return the packed ids of a
    piece by a shorter way, or None.  Ids of up to `most` pieces are kept between calls.
    """

    def __init__(self, tokenizer, cut: Callable[[str], list[str]], dtype: str,
                 direct: Callable[[str], bytes | None] | None = None, most: int = 200_000, longest: int = 200):
        self.tokenizer, self.cut, self.direct = tokenizer, cut, direct
        self.code = np.dtype(dtype).char
        self.most, self.longest = most, longest
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """One packed id array per text."""
        pieces = [self.cut(t) for t in texts]
        ids: dict[str, bytes] = {}
        new = []
        for piece in set().union(*pieces):
            packed = self.direct(piece) if self.direct is not None else None
            if packed is None:
                packed = self.known.get(piece)
            if packed is None:
                new.append(piece)
            else:
                ids[piece] = packed
        if len(self.known) > self.most:
            self.known = {}
        for i in range(0, len(new), 50_000):
            some = new[i:i + 50_000]
            for piece, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                ids[piece] = array(self.code, got.ids).tobytes()
                if len(piece) <= self.longest:
                    self.known[piece] = ids[piece]
        return [b"".join(map(ids.__getitem__, row)) for row in pieces]


def free(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be none of `columns`."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def fields(df: DataFrame) -> str:
    """The schema of `df` as a DDL string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
