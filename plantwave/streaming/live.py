"""Streams built from built-in windows, deduplication and joins."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import severity_rank
from ..operators.drift import histogram, psi_of_counts
from ..operators.scale import fits
from ..session import shared_dir
from ..sources.tables import routed

#: Folders of closing rows start so; a closing row is later than any reading or decision.
CLOSING, CLOSING_DDL, CLOSED = "closing-", "closing_ts timestamp", "9999-01-01"


def session_stream(alerts: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of a live alert stream, each put out once when no alert can join it; alerts exactly one gap apart stay together."""
    d = until_closed(alerts.withColumn("tag_key", F.coalesce("tag", F.lit(""))), "ts", late, ["asset", "detector", "tag_key"])
    g = d.groupBy("asset", "detector", "tag_key", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("alert_count"),
        F.max(severity_rank("severity")).alias("peak_rank"))
    return g.drop("w")


def downsample_stream(readings: DataFrame, period: str, how: str = "last", late: str = "10 minutes",
                      keys: Sequence[str] = ("asset", "tag")) -> DataFrame:
    """Tumbling `last` or `mean` of the raw readings; a stream puts a window out once, when it is over."""
    agg = F.max_by("value", "ts") if how == "last" else F.avg("value")
    d = until_closed(readings, "ts", late, keys)
    return (d.groupBy(*keys, F.window("ts", period).alias("w")).agg(agg.alias("value"))
            .select(*keys, F.col("w.start").alias("ts"), "value"))


def rolling_buffer(readings: DataFrame, length: str = "4 hours", slide: str = "10 minutes",
                   late: str = "10 minutes") -> DataFrame:
    """Sliding summary of the recent buffer: values, oldest and newest; a stream puts a window out once, when it is over."""
    d = until_closed(readings, "ts", late, ["asset"])
    return d.groupBy("asset", F.window("ts", length, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("n_values"), F.min("ts").alias("oldest"), F.max("ts").alias("newest")).select(
        "asset", F.col("w.end").alias("as_of"), "n_values", "oldest", "newest")


def unseen(recs: DataFrame, late: str = "1 day", id_column: str = "id") -> DataFrame:
    """Each id once while it may still arrive again; ids are content-derived."""
    return recs.withWatermark("ts", late).dropDuplicatesWithinWatermark([id_column])


def _closing(spark: SparkSession) -> str:
    """An empty folder of closing rows; `run_to_parquet` fills it once the streams that read it have run dry."""
    path = f"{shared_dir(spark)}/{CLOSING}{uuid.uuid4().hex}"
    spark.createDataFrame([], CLOSING_DDL).write.parquet(path)
    return path


def _closed_by(stream: DataFrame, path: str, ts: str, keys: Sequence[str]) -> DataFrame:
    """The stream with the closing row of a folder; its keys are not null, as joins filter nulls before the watermark."""
    rows = stream.sparkSession.readStream.schema(CLOSING_DDL).parquet(path).withColumnRenamed("closing_ts", ts)
    rows = rows.withColumns({k: F.lit(0).cast(stream.schema[k].dataType) for k in keys})
    return stream.unionByName(rows, allowMissingColumns=True)


def until_closed(rows: DataFrame, ts: str, late: str, keys: Sequence[str]) -> DataFrame:
    """A stream behind its watermark, whose event time ends with a closing row, so that all state comes out; a table as it is.

    The closing row passes the watermark and goes then: the condition is on the event time itself.
    """
    if not rows.isStreaming:
        return rows
    closed = _closed_by(rows, _closing(rows.sparkSession), ts, keys)
    return closed.withWatermark(ts, late).filter(F.col(ts) < F.lit(CLOSED).cast("timestamp"))


def deferred_outcomes(decisions: DataFrame, readings: DataFrame, reach: str = "5 minutes",
                      late: str = "10 minutes") -> DataFrame:
    """Predicted against actual, one row per decision, once event time has passed its due time and `reach`.

    `decisions`: id, asset, tag, due_ts, predicted.  The nearest reading within `reach`
    counts, the earlier one on a tie; `actual` is null where there is none.  `run_to_parquet` ends event time
    after the last row, so decisions still waiting then are put out as well.
    """
    r = readings.select(F.col("asset").alias("r_asset"), F.col("tag").alias("r_tag"), F.col("ts").alias("r_ts"), "value")
    d = decisions
    if d.isStreaming and r.isStreaming:
        path = _closing(d.sparkSession)
        d, r = _closed_by(d, path, "due_ts", ["asset", "tag"]), _closed_by(r, path, "r_ts", ["r_asset", "r_tag"])
    # a condition on the event time itself, so that the closing row passes the watermark first
    d = d.withWatermark("due_ts", late).filter(F.col("due_ts") < F.lit(CLOSED).cast("timestamp"))
    r = r.withWatermark("r_ts", late)
    span = F.expr(f"INTERVAL {reach}")
    j = d.join(r, (F.col("asset") == F.col("r_asset")) & (F.col("tag") == F.col("r_tag"))
               & (F.col("r_ts") >= F.col("due_ts") - span) & (F.col("r_ts") <= F.col("due_ts") + span), "left_outer")
    gap = F.abs(F.unix_micros("r_ts") - F.unix_micros("due_ts"))
    return (j.groupBy("id", "asset", "tag", F.window("due_ts", "1 second").alias("w"))
            .agg(F.first("predicted").alias("predicted"),
                 F.min_by("value", F.struct(gap, F.unix_micros("r_ts"))).alias("actual"))
            .withColumn("dev_pct", F.abs(F.col("actual") - F.col("predicted"))
                        / F.greatest(F.abs(F.col("predicted")), F.lit(1e-6)))
            .withColumn("within", F.col("dev_pct") < 0.5).drop("w"))


def drift_counts(readings: DataFrame, edges: DataFrame, keys: Sequence[str] = ("tag",)) -> DataFrame:
    """The live histogram `(keys, bin, n)` as aggregation state: counts of any micro-batches add up, a row per bin.

    Run it in complete mode; its rows are bins, whatever the number of readings.
    """
    return histogram(readings, edges, keys, small=fits(edges))


def drift_batches(edges: DataFrame, reference_counts: DataFrame, sink: Callable[[DataFrame, int], None],
                  keys: Sequence[str] = ("tag",)):
    """foreachBatch body scoring the live counts so far against the histogram of the reference, which is not read again."""
    def body(counts: DataFrame, epoch: int) -> None:
        sink(psi_of_counts(edges, reference_counts, counts, keys), epoch)
    return body


def routing_batches(sink: Callable[[DataFrame, int], None], threshold: str = "critical", chat: bool = False):
    """foreachBatch body sending request bodies of urgent recommendations to `sink`."""
    def body(batch: DataFrame, epoch: int) -> None:
        sink(routed(batch, threshold, chat), epoch)
    return body


def evaluation_batches(recent: Callable[[DataFrame], DataFrame], evaluate: Callable[[DataFrame], DataFrame],
                       stored: Callable[[], DataFrame | None], sink: Callable[[DataFrame, int], None],
                       min_samples: int = 30):
    """foreachBatch body re-running a batch evaluation on a buffer that the caller keeps; `buffer` keeps one as state.

    `recent` widens a micro-batch to the rolling buffer, `evaluate` turns readings into
    recommendations, and only ids not in `stored` reach the sink.
    """
    def body(batch: DataFrame, epoch: int) -> None:
        buffer = recent(batch)
        if buffer.limit(min_samples).count() < min_samples:
            return
        recs, seen = evaluate(buffer), stored()
        sink(recs if seen is None else recs.join(seen.select("id"), "id", "left_anti"), epoch)
    return body


def emitted_between(events: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Replay step: events in (start, end]; no start means everything up to `end`."""
    d = events.filter(F.col(ts) <= end)
    return d if start is None else d.filter(F.col(ts) > start)


def _run(stream: DataFrame, base: str, mode: str, sink: Callable, progress: list | None = None) -> None:
    """Run over everything available, and where it reads closing rows once more with them."""
    def once():
        w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        q = sink(w).start()
        q.awaitTermination()
        if progress is not None:
            progress.extend(q.recentProgress)
        return q.lastProgress

    last = once()
    sources = [re.search(rf"\[(.*/{CLOSING}[0-9a-f]+)\]", x["description"]) for x in (last or {"sources": []})["sources"]]
    folders = {m[1] for m in sources if m}
    for folder in folders:
        stream.sparkSession.sql(f"SELECT timestamp'{CLOSED}' AS closing_ts").write.mode("append").parquet(folder)
    if folders:
        once()


def run_to_parquet(stream: DataFrame, name: str, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Run a stream over everything available into the shared folder and read the result.

    In complete mode every batch replaces the result, so the last one remains.  A stream with closing rows runs
    on from its state with them, which puts out what still waits for later event times.  `progress` takes the
    progress reports of its micro-batches.
    """
    spark: SparkSession = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = f"{base}/out"

    if mode == "append":
        sink = lambda w: w.format("parquet").option("path", out)
    else:
        sink = lambda w: w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    _run(stream, base, mode, sink, progress)
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, name: str, body: Callable[[DataFrame, int], None], mode: str = "append",
                progress: list | None = None) -> None:
    """Run a foreachBatch evaluation over everything available; a stream with closing rows to its end."""
    base = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _run(stream, base, mode, lambda w: w.foreachBatch(body), progress)
