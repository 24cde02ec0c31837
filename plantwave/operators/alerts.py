"""One alert layout for all detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ALERT_COLUMNS, EXTRA_DDL

EXTRA_FIELDS = [f.strip().split(" ") for f in EXTRA_DDL.split(",")]


def extra_struct(**values: Column) -> Column:
    """The typed `extra` struct; fields not given are null."""
    return F.struct(*[
        (values[name] if name in values else F.lit(None)).cast(kind.lower()).alias(name)
        for name, kind in EXTRA_FIELDS
    ])


def as_alerts(df: DataFrame, *, detector: str, alert_type: str, severity: Column, value: Column,
              lim: Column, confidence: Column, message: Column, side: Column | None = None,
              tag: Column | None = None, contributors: Column | None = None,
              extra: Column | None = None) -> DataFrame:
    """Project detector output onto the alert schema."""
    none_map = F.lit(None).cast("map<string,double>")
    out = df.select(
        F.col("asset").cast("string"), F.col("scenario").cast("string"), "ts",
        F.lit(detector).alias("detector"),
        F.lit(alert_type).alias("alert_type"),
        severity.alias("severity"),
        (tag if tag is not None else F.col("tag")).cast("string").alias("tag"),
        (side if side is not None else F.lit(None)).cast("string").alias("side"),
        value.cast("double").alias("value"),
        lim.cast("double").alias("lim"),
        confidence.cast("double").alias("confidence"),
        message.alias("message"),
        (contributors if contributors is not None else none_map).alias("contributors"),
        (extra if extra is not None else extra_struct()).alias("extra"),
    )
    assert out.columns == ALERT_COLUMNS
    return out


def after_warmup(alerts: DataFrame, starts: DataFrame, minutes: float) -> DataFrame:
    """Drop alerts in the first `minutes` of their run; `starts` has a row per run."""
    cut = F.col("t_start") + F.make_dt_interval(mins=F.lit(0), secs=F.lit(minutes * 60.0))
    return (alerts.join(starts.select("asset", "scenario", "t_start"), ["asset", "scenario"])
            .filter(F.col("ts") >= cut).drop("t_start"))


def run_starts(readings: DataFrame) -> DataFrame:
    """First timestamp of every run."""
    return readings.groupBy("asset", "scenario").agg(F.min("ts").alias("t_start"))


def union_alerts(*streams: DataFrame) -> DataFrame:
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out
