"""Checks on uploaded scenarios and on single readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import last_known, previous_value
from .scale import checked_broadcast, with_chunk

MIN_ROWS, MAX_ROWS = 60, 100_000
NAME_PATTERN = r"^[a-z0-9_]{2,40}$"


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns a wide frame does not have, in the order given."""
    return [c for c in required if c not in df.columns]


def missing_tags(readings: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared tags a run has no reading of; `declared` is a tag dimension."""
    present = readings.select("asset", "scenario", "tag").distinct()
    runs = present.select("asset", "scenario").distinct()
    tags = [r.tag for r in declared.select("tag").distinct().collect()]  # dimension rows
    wanted = runs.withColumn("tag", F.explode(F.array(*[F.lit(t) for t in tags])))
    return wanted.join(present, ["asset", "scenario", "tag"], "left_anti")


def row_count_check(df: DataFrame, keys: Sequence[str], low: int = MIN_ROWS,
                    high: int = MAX_ROWS) -> DataFrame:
    n = F.col("n_rows")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "verdict", F.when(n < low, "too_few").when(n > high, "too_many").otherwise("ok"))


def numeric_check(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per column: rows, unreadable ratio and verdict (error / warning / ok), in one pass."""
    bad = [F.count_if(F.expr(f"try_cast(`{c}` AS DOUBLE)").isNull()).alias(c) for c in columns]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *bad)
    long = counts.unpivot([*keys, "n_rows"], list(columns), "column", "n_bad")
    ratio = F.col("n_bad") / F.col("n_rows")
    return long.withColumn("bad_ratio", ratio).withColumn(
        "verdict", F.when(ratio >= 1.0, "error").when(ratio > 0.10, "warning").otherwise("ok"))


def timestamp_check(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    bad = F.count_if(F.expr(f"try_to_timestamp(`{column}`)").isNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), bad.alias("n_bad"))


def coerce(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unreadable numbers become null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns})


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME_PATTERN), F.lit(False))


def quality_flags(raw: DataFrame, tag_map: DataFrame, keys: Sequence[str] = ("asset", "tag"),
                  ts: str = "ts", value: str = "value", stale_s: float = 10.0,
                  seconds: int | None = None) -> DataFrame:
    """3 unreadable, 1 out of range, 2 unchanged for longer than `stale_s`, else 0.

    `tag_map` is the tag dimension (tag, min_range, max_range).
    """
    d = raw.join(checked_broadcast(tag_map.select("tag", "min_range", "max_range")), "tag")
    x = F.expr(f"try_cast(`{value}` AS DOUBLE)")
    d = d.withColumn("_x", x).withColumn("_us", F.unix_micros(F.col(ts)))
    good = d.filter(F.col("_x").isNotNull())
    lost = d.filter(F.col("_x").isNull()).withColumn("quality", F.lit(3))
    good = with_chunk(good, ts, seconds) if seconds else good
    good = previous_value(good, keys, ["_us"], "_x", "_prev", ts, seconds)
    moved = F.col("_prev").isNull() | (F.abs(F.col("_x") - F.col("_prev")) >= 1e-9)
    good = last_known(good, keys, ["_us"], F.when(moved, F.col("_us")), "_changed", ts, seconds)
    out = F.coalesce((F.col("_x") < F.col("min_range")) | (F.col("_x") > F.col("max_range")), F.lit(False))
    stale = ~moved & (F.col("_us") - F.col("_changed") > F.lit(int(stale_s * 1e6)))
    good = good.withColumn("quality", F.when(out, 1).when(stale, 2).otherwise(0))
    cols = [*raw.columns, "quality"]
    return good.select(*cols).unionByName(lost.select(*cols))


def bad_per_sample(flagged: DataFrame, keys: Sequence[str] = ("asset", "ts")) -> DataFrame:
    return flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"),
                                      F.count_if(F.col("quality") != 0).alias("n_bad"))


def setpoint_gate(requests: DataFrame, tag_map: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Status of each (tag, value[, readback]) write request against the tag map."""
    m = checked_broadcast(tag_map.select("tag", "min_range", "max_range", "writable",
                                   F.lit(True).alias("_known")))
    d = requests.join(m, "tag", "left")
    v = F.col("value")
    status = (F.when(F.col("_known").isNull(), "tag_not_found")
              .when(~F.col("writable"), "blocked_not_writable")
              .when(v < F.col("min_range"), "blocked_below_range")
              .when(v > F.col("max_range"), "blocked_above_range"))
    if "readback" in requests.columns:
        gap = F.abs(F.col("readback") - v) / F.greatest(F.abs(v), F.lit(1e-9))
        status = status.when(gap > tolerance, "readback_mismatch")
    return d.withColumn("status", status.otherwise("success")).select(*requests.columns, "status")


def latest_first_window(keys: Sequence[str], ts: str, *tie: str) -> Window:
    return Window.partitionBy(*keys).orderBy(F.desc(ts), *[F.desc(t) for t in tie])
