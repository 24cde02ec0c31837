"""Many keys share one key of a stateful stream.

A call, a frame, state requests and timers per key cost far more than the few rows a key has in a micro-batch.  So a
stream is grouped by a hash into `BUCKETS` buckets, whose state is a list of Arrow pieces with the rows of many keys.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets of a stream: state and readings of a bucket in one micro-batch have to fit a task, so more of both need more.
BUCKETS = 512
PIECE_DDL = "piece BINARY"


def bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def pack(frame: pd.DataFrame, schema: pa.Schema, rows: int = 20_000) -> list[tuple[bytes]]:
    """Rows of a list state, each an Arrow stream of up to `rows` rows."""
    table, out = pa.Table.from_pandas(frame, schema=schema, preserve_index=False), []
    for start in range(0, table.num_rows, rows):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as writer:
            writer.write_table(table.slice(start, rows))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def unpack(pieces: Iterable[tuple], schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(pa.py_buffer(bytes(p[0]))).read_all() for p in pieces]
    return (pa.concat_tables(tables) if tables else schema.empty_table()).to_pandas()
