"""Forecast windows, time split, fills and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import index_rows, last_known, next_known, row_frame, with_halo
from .scale import TARGET_ROWS, chunk_seconds_for, with_chunk


def forecast_windows(wide: DataFrame, features: Sequence[str], targets: Sequence[str], lookback: int,
                     horizon: int, keys: Sequence[str] = ("asset", "scenario"), ts: str = "ts",
                     tie: Sequence[str] = (), every: int = 1, seconds: int | None = None) -> DataFrame:
    """`x` = the last `lookback` rows, `y` = the next `horizon` rows, complete windows only.

    Rows with a null in any used column are removed first; windows never cross `keys`.
    `every` keeps one origin per that many rows.
    """
    used = list(dict.fromkeys([*features, *targets]))
    d = index_rows(wide.dropna(subset=used), keys, [ts, *tie], ts, seconds)
    d, parts, own = with_halo(d, keys, lookback, horizon, TARGET_ROWS if seconds else None)
    past, ahead = row_frame(parts, "rn", -(lookback - 1), 0), row_frame(parts, "rn", 1, horizon)
    ready = (F.col("rn") >= lookback) & (F.col("rn") + horizon <= F.col("n_rows"))
    origin = (F.col("rn") - lookback) % every == 0
    return (d.withColumn("x", F.collect_list(F.struct(*features)).over(past))
            .withColumn("y", F.collect_list(F.struct(*targets)).over(ahead))
            .filter(own & ready & origin)
            .select(*keys, F.col(ts).alias("now_ts"), "rn", "x", "y"))


def lag_features(wide: DataFrame, features: Sequence[str], targets: Sequence[str], lags: Sequence[int],
                 horizons: Sequence[int], keys: Sequence[str] = ("asset", "scenario"), ts: str = "ts",
                 tie: Sequence[str] = (), seconds: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Flat training rows: `f__lag` inputs and `t__h` outputs, complete rows only.

    Without horizons the rows are those to predict from, up to the last one; `carry` columns come along.
    """
    used = list(dict.fromkeys([*features, *targets, *carry]))
    ahead = max(horizons, default=0)
    d = index_rows(wide.dropna(subset=used), keys, [ts, *tie], ts, seconds)
    d, parts, own = with_halo(d, keys, max(lags), ahead, TARGET_ROWS if seconds else None)
    from pyspark.sql import Window
    w = Window.partitionBy(*parts).orderBy("rn")
    xs = {f"{f}__lag{k}": F.lag(f, k).over(w) for f in features for k in lags}
    ys = {f"{t}__h{h}": F.lead(t, h).over(w) for t in targets for h in horizons}
    d = d.select(*keys, F.col(ts).alias("now_ts"), "rn", "n_rows", own.alias("_mine"), *carry,
                 *[c.alias(n) for n, c in {**xs, **ys}.items()])
    return d.filter("_mine").drop("_mine").filter(
        (F.col("rn") > max(lags)) & (F.col("rn") + ahead <= F.col("n_rows"))).drop("n_rows")


def time_split(df: DataFrame, fraction: float = 0.2, ts: str = "now_ts", tie: Sequence[str] = (),
               seconds: int | None = None) -> DataFrame:
    """Add `is_val`: the last max(1, floor(n × fraction)) rows by time over the whole frame."""
    d = df.withColumn("_all", F.lit(0))
    seconds = seconds or chunk_seconds_for(d, ["_all"], ts)
    d = index_rows(d, ["_all"], [ts, *tie], ts, seconds, rn="_rn", total="_n")
    n_val = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(fraction)))
    return d.withColumn("is_val", F.col("_rn") > F.col("_n") - n_val).drop("_all", "_rn", "_n")


def fill_both_ways(df: DataFrame, columns: Sequence[str], keys: Sequence[str], ts: str = "ts",
                   tie: Sequence[str] = (), seconds: int | None = None) -> DataFrame:
    """Forward fill, then backward fill what is still missing."""
    had = df.columns
    df = with_chunk(df, ts, seconds) if seconds else df
    for c in columns:
        df = last_known(df, keys, [ts, *tie], F.col(c), "_f", ts, seconds)
        df = next_known(df, keys, [ts, *tie], F.col(c), "_b", ts, seconds)
        df = df.withColumn(c, F.coalesce("_f", "_b")).drop("_f", "_b")
    return df.select(*had)


def scaler(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per column; a constant column scales by one."""
    out = []
    for c in columns:
        sd = F.stddev_pop(c)
        out += [F.avg(c).alias(f"{c}__mean"), F.when(sd < 1e-9, 1.0).otherwise(sd).alias(f"{c}__std")]
    return df.groupBy(*keys).agg(*out)


def point_horizons(df: DataFrame, trajectory: str, horizons_min: Sequence[float], period_min: float = 1.0) -> DataFrame:
    """Trajectory values at round(h / period), where the trajectory is that long."""
    d = df
    for h in horizons_min:
        step = int(round(h / period_min))
        d = d.withColumn(f"at_{h:g}min", F.when((F.size(trajectory) >= step) & F.lit(step >= 1),
                                               F.get(F.col(trajectory), F.lit(step - 1))))
    return d


def aligned_forecasts(forecasts: DataFrame, readings: DataFrame, keys: Sequence[str],
                      period_us: int, ts: str = "ts", value: str = "value", future: bool = False) -> DataFrame:
    """Every trajectory point with the reading at its own time.

    Points without a reading are left out; with `future` they stay and their `actual` is null.
    """
    d = forecasts.select(*keys, F.col(ts).alias("origin_ts"), F.posexplode("trajectory").alias("pos", "predicted"))
    d = d.withColumn(ts, F.timestamp_micros(F.unix_micros("origin_ts") + (F.col("pos") + 1) * F.lit(period_us)))
    actual = readings.select(*keys, ts, F.col(value).alias("actual"))
    return d.join(actual, [*keys, ts], "left" if future else "inner")


def latest_windows(wide: DataFrame, features: Sequence[str], lookback: int,
                   keys: Sequence[str] = ("asset", "scenario"), ts: str = "ts", tie: Sequence[str] = (),
                   seconds: int | None = None) -> DataFrame:
    """The present state of each series as one row, to forecast from.

    `x` = its last `lookback` rows without a null feature, `ts` = the time of the last one, `have` = the
    smaller of its rows and `lookback`, `warming_up` = whether there are too few; `x` is null then.  A series
    without a complete row has `have` 0 and a null `ts`.
    """
    d = index_rows(wide.dropna(subset=list(features)), keys, [ts, *tie], ts, seconds)
    last = d.filter(F.col("rn") > F.col("n_rows") - lookback).groupBy(*keys).agg(
        F.max(ts).alias(ts), F.count(F.lit(1)).alias("have"),
        F.array_sort(F.collect_list(F.struct("rn", F.struct(*features).alias("row")))).alias("_rows"))
    found = wide.select(*keys).distinct().join(last, list(keys), "left")
    short = F.coalesce(F.col("have"), F.lit(0)) < lookback
    return found.select(
        *keys, ts, F.coalesce("have", F.lit(0)).cast("long").alias("have"), F.lit(lookback).alias("needs"),
        short.alias("warming_up"), F.when(~short, F.transform("_rows", lambda r: r["row"])).alias("x"))
