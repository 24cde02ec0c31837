"""Dataset snapshots: content hashes, ids, diffs and verification as table joins."""

from __future__ import annotations

import _hashlib
import ctypes
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Bytes of a file that one task reads; longer files are hashed by a chain of jobs.
PIECE_BYTES = 256 << 20

SNAPSHOT_DDL = (
    "snapshot_id STRING, created_at TIMESTAMP, message STRING, name STRING, sha256 STRING, size_bytes LONG, "
    "n_rows LONG, n_cols INT, modified_at TIMESTAMP"
)


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


class Sha256:
    """SHA-256 that goes on from a kept state: OpenSSL's own functions, as hashlib does not hand its state out.

    Where Python has no OpenSSL with them, `library` is None.
    """

    try:
        library = ctypes.CDLL(_hashlib.__file__)
        library.SHA256_Init, library.SHA256_Update, library.SHA256_Final
    except (AttributeError, OSError):
        library = None

    def __init__(self, state: bytes | None = None):
        self.context = ctypes.create_string_buffer(state, 256) if state else ctypes.create_string_buffer(256)
        if not state:
            self.library.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        self.library.SHA256_Update(self.context, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state(), 256)
        self.library.SHA256_Final(out, last)
        return out.raw.hex()


def _hash_on(rows: pd.DataFrame, piece: int) -> Iterator[dict]:
    """Each file's state after its next `piece` bytes, and its hash after the last one."""
    for row in rows.to_dict("records"):
        if row["at"] < row["size_bytes"]:
            whole = Sha256.library is None  # then no state can be handed on
            h = hashlib.sha256() if whole else Sha256(row["state"])
            end = row["size_bytes"] if whole else min(row["at"] + piece, row["size_bytes"])
            with open(re.sub("^file:/*", "/", row["path"]), "rb") as f:
                f.seek(row["at"])
                while row["at"] < end:
                    data = f.read(min(4 << 20, end - row["at"]))
                    if not data:
                        raise EOFError(f"{row['path']} has become shorter")
                    h.update(data)
                    row["at"] += len(data)
            row["state"] = None if whole else h.state()
            if row["at"] == row["size_bytes"]:
                row["sha256"] = h.hexdigest()
        yield row


def _long_hashes(files: DataFrame, piece: int) -> DataFrame:
    """`(path, sha256)` of files `(path, size_bytes)`: a job takes the next `piece` bytes of every file, a task each."""
    ensure_checkpoint_dir(files.sparkSession)
    names = ["path", "size_bytes", "at", "state", "sha256"]
    size = files.agg(F.count(F.lit(1)).alias("n"), F.max("size_bytes").alias("most")).first()
    d = files.select("path", "size_bytes", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("state"),
                     F.lit(None).cast("string").alias("sha256"))

    def step(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame(list(_hash_on(pdf, piece)), columns=names)

    for _ in range(-(-(size.most or 0) // piece)):
        d = d.repartitionByRange(size.n, "path").mapInPandas(step, "path string, size_bytes long, at long, state binary, sha256 string").checkpoint()
    return d.select("path", "sha256")


def file_meta(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Name, sha256, size and time of every file, plus CSV dimensions.

    Whole files are hashed; hidden files are skipped.  A file of up to `PIECE_BYTES`, or of a file system that only
    Spark opens, is read by one task at a time.  Longer ones are read piece by piece, each by a task that goes on
    from the state of the one before.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    raw = raw.withColumn("name", _name(F.col("path"))).filter(~F.col("name").startswith("."))
    kept = [F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")]
    whole = lambda d: d.select("name", F.sha2("content", 256).alias("sha256"), *kept)
    out = whole(raw.filter(F.col("length") <= PIECE_BYTES))  # by length alone, so that the others are not opened
    long, local = raw.filter(F.col("length") > PIECE_BYTES), F.col("path").startswith("file:")
    pieces = long.filter(local).select("path", "name", *kept)
    if not pieces.isEmpty():
        out = out.unionByName(pieces.join(_long_hashes(pieces, PIECE_BYTES), "path").select(*out.columns))
    if not long.filter(~local).select("path").isEmpty():
        out = out.unionByName(whole(long.filter(~local)))
    return out


def csv_dimensions(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Rows without the header and columns of the header per file."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path).select(
        _name(F.col("_metadata.file_path")).alias("name"), "value",
        F.col("_metadata.file_block_start").alias("_at"))
    w = F.when(F.col("_at") == 0, F.size(F.split("value", ",")))
    first = lines.select("name", "value", "_at", F.monotonically_increasing_id().alias("_i"))
    head = first.filter(F.col("_at") == 0).groupBy("name").agg(
        F.min_by(F.size(F.split("value", ",")), "_i").alias("n_cols"))
    return lines.groupBy("name").agg((F.count(F.lit(1)) - 1).alias("n_rows")).join(head, "name", "left")


def snapshot_id(files: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """First 12 hex digits of the hash over the sorted "name=sha256" lines (a row per file)."""
    lines = F.transform(F.array_sort(F.array_agg(F.struct("name", "sha256"))),
                        lambda f: F.concat(f["name"], F.lit("="), f["sha256"]))
    return files.groupBy(*keys).agg(
        F.substring(F.sha2(F.concat_ws("\n", lines), 256), 1, 12).alias("snapshot_id"),
        F.count(F.lit(1)).alias("n_files"))


def take_snapshot(spark: SparkSession, path: str, message: str = "", pattern: str = "*.csv",
                  created_at: Column | None = None) -> DataFrame:
    """Snapshot rows of a folder; the same content always gets the same id."""
    meta = file_meta(spark, path, pattern).join(csv_dimensions(spark, path, pattern), "name", "left")
    if meta.isEmpty():
        raise FileNotFoundError(f"no files matching {pattern!r} under {path}")
    sid = snapshot_id(meta).select("snapshot_id")
    return meta.join(F.broadcast(sid)).select(
        "snapshot_id", (created_at if created_at is not None else F.current_timestamp()).alias("created_at"),
        F.lit(message).alias("message"), "name", "sha256", "size_bytes",
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
        F.coalesce("n_cols", F.lit(0)).cast("int").alias("n_cols"), "modified_at")


def list_snapshots(snapshots: DataFrame) -> DataFrame:
    return (snapshots.groupBy("snapshot_id").agg(
        F.max("created_at").alias("created_at"), F.max_by("message", "created_at").alias("message"),
        F.countDistinct("name").alias("n_files")).orderBy("created_at", "snapshot_id"))


def load_snapshot(snapshots: DataFrame, wanted: str) -> DataFrame:
    d = snapshots.filter(F.col("snapshot_id") == wanted)
    if d.isEmpty():
        raise LookupError(f"snapshot {wanted!r} not found")
    return d


def diff_snapshots(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, change) with both hashes and row counts; unchanged files are left out."""
    cols = ["sha256", "n_rows"]
    x = a.select("name", *[F.col(c).alias(f"{c}_a") for c in cols], F.lit(True).alias("_a"))
    y = b.select("name", *[F.col(c).alias(f"{c}_b") for c in cols], F.lit(True).alias("_b"))
    d = x.join(y, "name", "full")
    change = (F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
              .when(F.col("sha256_a") != F.col("sha256_b"), "changed"))
    return d.withColumn("change", change).filter(F.col("change").isNotNull()).drop("_a", "_b")


def verify_counts(snapshot: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: ok and the numbers of missing, extra and mismatched files."""
    c = F.col("change")
    return diff_snapshots(snapshot, fresh).agg(
        (F.count(F.lit(1)) == 0).alias("ok"), F.count_if(c == "removed").alias("missing"),
        F.count_if(c == "added").alias("extra"), F.count_if(c == "changed").alias("mismatched"))


def verify_snapshot(snapshot: DataFrame, fresh: DataFrame) -> DataFrame:
    """(name, problem) rows, empty when the folder still matches; see `verify_counts`."""
    problem = (F.when(F.col("change") == "removed", "missing").when(F.col("change") == "added", "extra")
               .otherwise("mismatched"))
    return diff_snapshots(snapshot, fresh).select("name", problem.alias("problem"), "sha256_a", "sha256_b")
