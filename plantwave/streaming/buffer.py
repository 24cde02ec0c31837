"""The live path: readings into an event-time buffer, evaluations at its timers, new recommendations out.

Buckets of assets hold their recent readings as list state.  An event-time timer at every boundary (a multiple of `every`)
hands on the windows of `length` that have ended, drops what no later window needs, and sets the next
timer, or clears the state of a bucket whose assets have gone silent.  So state ends with the data, a window is evaluated
once, when no more of it can come, and late readings within the watermark are in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.errors import AnalysisException

from ..session import ROCKSDB
from .buckets import PIECE_DDL, bucket, pack, unpack
from .live import until_closed

WINDOW_DDL = "asset STRING, scenario STRING, as_of TIMESTAMP, ts TIMESTAMP, tag STRING, value DOUBLE"


#: What a bucket holds of its readings.
HELD = pa.schema([("asset", pa.string()), ("scenario", pa.string()), ("us", pa.int64()), ("tag", pa.string()), ("value", pa.float64())])
#: Rows of windows handed on in one frame, at least.
FRAME_ROWS = 200_000


class BufferProcessor(StatefulProcessor):
    """Windows (as_of - length, as_of] of each asset and scenario, at the multiples of `every`.

    Its key is a bucket of assets whose rows name asset and scenario, or an (asset, scenario).
    """

    def __init__(self, length_s: float, every_s: float):
        self.length, self.every = int(length_s * 1e6), int(every_s * 1e3) * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", PIECE_DDL)
        self.due = handle.getValueState("due", "at_us LONG")

    def _boundary(self, us):
        return -(-us // self.every) * self.every

    def _expect(self, at: int) -> None:
        # one millisecond later, when no reading of that very time can come any more
        self.handle.registerTimer(at // 1000 + 1)
        self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if not len(pdf):
                continue
            if len(key) == 2:
                pdf = pdf.assign(asset=key[0], scenario=key[1])
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            self.rows.appendList(pack(pdf.assign(us=us, value=pdf["value"].astype(float))[HELD.names], HELD))
            first = int(us.min()) if first is None else min(first, int(us.min()))
        if first is None:
            return
        at, due = self._boundary(first), self.due.get()
        if due is None or at < due[0]:
            if due is not None:
                self.handle.deleteTimer(due[0] // 1000 + 1)
            self._expect(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due.get()
        at = (expiredTimerInfo.getExpiryTimeInMs() - 1) * 1000
        if due is None or due[0] != at:
            return
        held = unpack(self.rows.get(), HELD)
        us = held["us"].to_numpy()
        # a jump of event time may end several windows at once; they share frames, as a frame costs more than its rows
        last = (timerValues.getCurrentWatermarkInMs() * 1000 - 1) // self.every * self.every
        end, places, ends = self._boundary(us), [], []
        for _ in range(-(-self.length // self.every)):
            ended = np.flatnonzero((end < us + self.length) & (end >= at) & (end <= last))
            places.append(ended)
            ends.append(end[ended])
            if sum(map(len, places)) >= FRAME_ROWS:
                yield self._windows(held, places, ends)
                places, ends = [], []
            end = end + self.every
        if any(map(len, places)):
            yield self._windows(held, places, ends)
        left = us > last + self.every - self.length
        if left.any():
            self.rows.put(pack(held[left], HELD))
            self._expect(max(last + self.every, self._boundary(int(us[left].min()))))
        else:
            self.rows.clear()
            self.due.clear()

    @staticmethod
    def _windows(held: pd.DataFrame, places: list[np.ndarray], ends: list[np.ndarray]) -> pd.DataFrame:
        d = held.take(np.concatenate(places))
        return pd.DataFrame({"asset": d["asset"].to_numpy(), "scenario": d["scenario"].to_numpy(),
                             "as_of": pd.to_datetime(np.concatenate(ends), unit="us"), "ts": pd.to_datetime(d["us"].to_numpy(), unit="us"),
                             "tag": d["tag"].to_numpy(), "value": d["value"].to_numpy()})

    def close(self) -> None:
        pass


def windows(readings: DataFrame, length_s: float, every_s: float, late: str = "10 minutes") -> DataFrame:
    """A stream of whole windows `(asset, scenario, as_of, ts, tag, value)`; readings without a value stay out."""
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # before the closing row joins, which has no value: a condition on the value would be pushed below the watermark
    d = readings.select("asset", "scenario", "ts", "tag", "value").filter(F.col("value").isNotNull())
    d = until_closed(d, "ts", late, ["asset", "scenario"])
    return d.withColumn("bucket", bucket("asset", "scenario")).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=BufferProcessor(length_s, every_s), outputStructType=WINDOW_DDL, outputMode="Append",
        timeMode="EventTime")


def windows_of(readings: DataFrame, length_s: float, every_s: float) -> DataFrame:
    """The same windows of a table, for a batch run: each reading once for each window it is in."""
    length, every = int(length_s * 1e6), int(every_s * 1e3) * 1000
    us = F.unix_micros("ts")
    first = F.ceil(us / every) * every
    ends = F.sequence(first, us + length - 1, F.lit(every))
    d = readings.filter(F.col("value").isNotNull() & F.col("ts").isNotNull())
    return d.withColumn("_at", F.explode(F.when(first <= us + length - 1, ends).otherwise(F.array().cast("array<bigint>")))).select(
        "asset", "scenario", F.timestamp_micros("_at").alias("as_of"), "ts", "tag", "value")


def stored(spark: SparkSession, path: str, epoch: int | None = None) -> DataFrame | None:
    """What an epoch-keyed table holds, without the rows of `epoch`; None where nothing is written yet."""
    try:
        d = spark.read.parquet(path)
    except AnalysisException:
        return None
    return d if epoch is None else d.filter(F.col("epoch") != epoch)


def evaluation_batches(path: str, evaluate: Callable[[DataFrame], DataFrame], min_samples: int = 30):
    """foreachBatch body: windows of `min_samples` readings at least are evaluated, and recommendations with new ids stored.

    `evaluate` gets whole windows, several assets and several `as_of` at a time, and returns rows with an `id` made of
    their content.  An epoch writes its own folder, so running it again replaces its rows and changes nothing else.
    """
    def body(batch: DataFrame, epoch: int) -> None:
        # every use of a batch that is not kept runs the stateful step once more
        batch = batch.persist()
        try:
            enough = batch.groupBy("asset", "scenario", "as_of").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_samples)
            ready = batch.join(enough.drop("_n"), ["asset", "scenario", "as_of"], "left_semi")
            if ready.isEmpty():
                return
            found = evaluate(ready).dropDuplicates(["id"])
            seen = stored(batch.sparkSession, path, epoch)
            if seen is not None:
                found = found.join(seen.select("id"), "id", "left_anti")
            found.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        finally:
            batch.unpersist()
    return body


def outbox_batches(path: str, send: Callable[[DataFrame, int], None]):
    """foreachBatch body: rows go to the epoch's folder of an outbox, then to `send`, then the epoch is marked as sent.

    A replayed epoch that was marked is not sent again.  Put `live.unseen` in front, whose state holds the ids that
    may still come again, so the outbox has each id once.  When a run dies between sending and marking, the same rows
    with the same ids are sent again: receivers tell them by their id.
    """
    def body(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        sent = stored(spark, f"{path}/sent")
        if sent is not None and not sent.filter(F.col("epoch") == epoch).isEmpty():
            return
        target = f"{path}/rows/epoch={epoch}"
        batch.write.mode("overwrite").parquet(target)
        send(spark.read.schema(batch.schema).parquet(target), epoch)
        spark.range(1).select(F.current_timestamp().alias("sent_ts")).write.mode("overwrite").parquet(f"{path}/sent/epoch={epoch}")
    return body
