"""Alert grouping: gap islands per (run, detector, tag)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.times import minutes_between
from ..model import severity_rank
from .ordered import last_known, previous_value
from .scale import CHUNK, with_chunk

STREAM = ["asset", "scenario", "detector", "tag_key"]


def mark_sessions(alerts: DataFrame, gap_minutes: float = 30.0, seconds: int | None = None) -> DataFrame:
    """Add `session_start`: a gap above the limit opens a session, an equal gap joins."""
    d = alerts.withColumn("tag_key", F.coalesce("tag", F.lit(""))) \
              .withColumn("_us", F.unix_micros("ts"))
    d = with_chunk(d, "ts", seconds) if seconds else d
    d = previous_value(d, STREAM, ["_us"], "_us", "_prev", seconds=seconds)
    opens = F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") > F.lit(int(gap_minutes * 60e6)))
    d = last_known(d, STREAM, ["_us"], F.when(opens, F.col("ts")), "session_start", seconds=seconds)
    return d.drop("_prev", "_us", CHUNK)


def sessionise(alerts: DataFrame, gap_minutes: float = 30.0, seconds: int | None = None) -> DataFrame:
    """One row per session, with first and peak alert and merged contributors.

    The peak is the worst severity, then the largest distance from the limit, then
    the earliest alert.
    """
    d = mark_sessions(alerts, gap_minutes, seconds)
    d = d.withColumn("_a", F.struct(
        "ts", "severity", "side", "value", "lim", "confidence", "message", "extra"))
    distance = F.abs(F.coalesce("value", F.lit(0.0)) - F.coalesce("lim", F.lit(0.0)))
    peak_key = F.struct(severity_rank("severity"), distance, -F.unix_micros("ts"))
    groups = [*STREAM, "session_start"]
    # one pass over the alerts: per contributor first, then per session
    d = d.select(*groups, "ts", "severity", "_a", peak_key.alias("_key"),
                 F.posexplode_outer("contributors").alias("_pos", "_k", "_v"))
    part = d.groupBy(*groups, "_k").agg(
        F.max("_v").alias("_v"), F.max("ts").alias("end_ts"), F.max(severity_rank("severity")).alias("peak_rank"),
        F.count_if(F.coalesce("_pos", F.lit(0)) == 0).alias("alert_count"),
        F.min("ts").alias("_first_ts"), F.min_by("_a", F.unix_micros("ts")).alias("first_alert"),
        F.max("_key").alias("_key"), F.max_by("_a", "_key").alias("peak_alert"))
    entries = F.array_sort(F.array_agg(F.when(F.col("_k").isNotNull(), F.struct(
        "_k", F.greatest("_v", F.lit(0.0)).alias("_v")))))
    out = part.groupBy(*groups).agg(
        F.max("end_ts").alias("end_ts"), F.max("peak_rank").alias("peak_rank"),
        F.sum("alert_count").alias("alert_count"),
        F.min_by("first_alert", "_first_ts").alias("first_alert"), F.max_by("peak_alert", "_key").alias("peak_alert"),
        entries.alias("_entries"))
    out = out.withColumn("contributors", F.when(
        F.size("_entries") > 0, F.map_from_entries(F.array_compact("_entries"))))
    return out.select(
        "asset", "scenario",
        stable_id("SES", *[F.col(c) for c in STREAM], F.unix_micros("session_start")).alias("session_id"),
        "detector",
        F.when(F.col("tag_key") != "", F.col("tag_key")).alias("tag"),
        F.col("session_start").alias("start_ts"), "end_ts",
        minutes_between(F.col("end_ts"), F.col("session_start")).alias("duration_min"),
        "alert_count",
        F.col("peak_alert.severity").alias("peak_severity"), "peak_rank",
        "first_alert", "peak_alert", "contributors",
    )


def longest_sessions(sessions: DataFrame, n: int = 5) -> DataFrame:
    return sessions.orderBy(F.desc("duration_min"), "start_ts", "session_id").limit(n)


def worst_sessions(sessions: DataFrame, n: int = 8) -> DataFrame:
    return sessions.orderBy(F.desc("peak_rank"), F.desc("alert_count"), "start_ts", "session_id").limit(n)


def first_per_rule(recs: DataFrame, keys=("scenario", "rule_id")) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts", "id")
    return recs.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1).drop("_rk")
