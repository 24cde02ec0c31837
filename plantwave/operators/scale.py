"""Sizing of ordered work so that no task ever holds an unbounded series.

An ordered operator partitions by ``(series, time chunk)``.  The chunk width is
chosen from the data: one small aggregate finds the busiest hour of the busiest
series.  When every series is small enough the width is ``None`` and operators
use one partition per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_ROWS = 250_000
BROADCAST_ROWS = 100_000
CHUNK = "_chunk"


def chunk_seconds_for(df: DataFrame, keys: Sequence[str], ts: str = "ts",
                      target_rows: int = TARGET_ROWS, at_least: int = 1) -> int | None:
    """Chunk width in seconds that keeps a (series, chunk) near `target_rows` rows.

    ``None`` means every series already fits.  Reads only the key and time columns.
    """
    hourly = df.groupBy(*keys, F.floor(F.unix_seconds(F.col(ts)) / 3600).alias("_hour")).count()
    series = hourly.groupBy(*keys).agg(F.sum("count").alias("n"), F.max("count").alias("peak"))
    top = series.agg(F.max("n").alias("n"), F.max("peak").alias("peak")).first()
    if top is None or top.n is None or top.n <= target_rows:
        return None
    return max(at_least, int(3600 * target_rows / top.peak))


def with_chunk(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Add the chunk number, or keep the one an earlier step put there.

    Keeping it lets consecutive steps share one shuffle.  Any chunking that grows with
    time gives the same results.
    """
    if CHUNK in df.columns:
        return df
    return df.withColumn(CHUNK, F.floor(F.unix_seconds(F.col(ts)) / F.lit(seconds)))


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when `df` has at most `rows` rows; reads no more than that plus one."""
    return df.limit(rows + 1).count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting; beyond the bound the join shuffles."""
    return F.broadcast(df) if fits(df, rows) else df


def attach_small(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Column,
                 counted_small: bool | None = None) -> DataFrame:
    """Join a parameter table: broadcast when counted small, else salted over its keys."""
    if fits(small) if counted_small is None else counted_small:
        return big.join(F.broadcast(small), list(on))
    return salted_join(big, small, on, spread)


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Column,
                salts: int = 32, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys are split over `salts` tasks.

    `spread` is any well-distributed expression of the big side; the small side
    is repeated once per salt, so its cost is a constant factor.
    """
    left = big.withColumn("_salt", F.pmod(F.hash(spread), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
