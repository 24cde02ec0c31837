"""Which sessions accompany a session, counted per stream instead of paired.

A session accompanies another of the same run when the starts are at most `window`
apart or the two overlap.  Sessions of one (detector, tag) stream never overlap each
other, so per stream the answer is

    starts in [start − w, max(start + w, end)]  +  [last earlier session still open]

which needs only running counts at two probe times.  No session pairs are built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import plus_minutes
from .ordered import last_known, running_total
from .scale import with_chunk

RUN_STREAM = ["asset", "scenario", "o_detector", "o_tag_key"]


def streams_of(sessions: DataFrame) -> DataFrame:
    """The (detector, tag) streams of every run."""
    return (sessions.select("asset", "scenario", F.col("detector").alias("o_detector"),
                            F.coalesce("tag", F.lit("")).alias("o_tag_key")).distinct())


def co_occurrence_counts(sessions: DataFrame, window_minutes: float = 90.0,
                         streams: DataFrame | None = None, only: Column | None = None,
                         causal: bool = False, seconds: int | None = None) -> DataFrame:
    """(session_id, o_detector, o_tag, n) with n > 0 accompanying sessions.

    `streams` limits the counted streams to fixed (o_detector, o_tag_key) rows; `only`
    limits the sessions asked about.  `causal` ignores sessions that start later.
    """
    w = F.lit(float(window_minutes))
    asked = sessions if only is None else sessions.filter(only)
    start, end = F.col("start_ts"), F.col("end_ts")
    hi = start if causal else F.greatest(plus_minutes(start, w), end)
    asked = asked.select("asset", "scenario", "session_id", "start_ts", "detector",
                         F.coalesce("tag", F.lit("")).alias("tag_key"),
                         plus_minutes(start, -w).alias("_lo"), hi.alias("_hi"))
    if streams is None:
        probes = asked.join(streams_of(sessions), ["asset", "scenario"])
        known = sessions
    else:
        rows = streams.select("o_detector", "o_tag_key").collect()  # fixed rule vocabulary
        array = F.array(*[F.struct(F.lit(r.o_detector).alias("o_detector"),
                                   F.lit(r.o_tag_key).alias("o_tag_key")) for r in rows])
        probes = asked.withColumn("_s", F.explode(array)).select("*", "_s.*").drop("_s")
        known = sessions.filter(
            F.array_contains(array, F.struct(F.col("detector").alias("o_detector"),
                                             F.coalesce("tag", F.lit("")).alias("o_tag_key"))))
    # at one instant: lower probes, then session starts, then upper probes
    events = known.select(
        "asset", "scenario", F.col("detector").alias("o_detector"),
        F.coalesce("tag", F.lit("")).alias("o_tag_key"), F.col("start_ts").alias("ts"),
        F.lit(1).alias("_side"), F.lit(1).alias("_one"), F.col("end_ts").alias("_open"))
    mine = F.struct("session_id", "start_ts",
                    ((F.col("detector") == F.col("o_detector"))
                     & (F.col("tag_key") == F.col("o_tag_key"))).alias("own"))
    asks = probes.select(
        *RUN_STREAM, mine.alias("_ask"),
        F.explode(F.array(F.struct(F.col("_lo").alias("ts"), F.lit(0).alias("_side")),
                          F.struct(F.col("_hi").alias("ts"), F.lit(2).alias("_side")))).alias("_p"),
    ).select(*RUN_STREAM, "_ask", "_p.*")
    both = events.unionByName(asks, allowMissingColumns=True).withColumn("_us", F.unix_micros("ts"))
    both = with_chunk(both, "ts", seconds) if seconds else both
    order = ["_us", "_side"]
    both = running_total(both, RUN_STREAM, order, F.coalesce("_one", F.lit(0)), "_seen", seconds=seconds)
    both = last_known(both, RUN_STREAM, order, F.col("_open"), "_last_end", seconds=seconds)
    lower = F.col("_side") == 0
    per = both.filter(F.col("_side") != 1).groupBy(
        F.col("_ask.session_id").alias("session_id"), "o_detector", "o_tag_key").agg(
        F.first("_ask.own").alias("_own"),
        F.sum(F.when(lower, -F.col("_seen")).otherwise(F.col("_seen"))).alias("_starts"),
        F.max(F.when(lower & (F.col("_last_end") >= F.col("_ask.start_ts")), 1)
              .otherwise(0)).alias("_open"))
    n = F.col("_starts") + F.col("_open") - F.col("_own").cast("int")
    return (per.withColumn("n", n).filter(F.col("n") > 0)
            .select("session_id", "o_detector",
                    F.when(F.col("o_tag_key") != "", F.col("o_tag_key")).alias("o_tag"), "n"))
