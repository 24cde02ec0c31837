"""Finite row-frame detectors: frozen sensors and trend projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ladders import severity_from_minutes
from ..model import SERIES
from .alerts import as_alerts, extra_struct
from .ordered import index_rows, row_frame, with_halo
from .recurrences import thin
from .scale import TARGET_ROWS, checked_broadcast


def sampling_period(df: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts",
                    default_s: float = 60.0) -> DataFrame:
    """Seconds between the first two timestamps of each series (default when unknown or zero)."""
    first_two = F.slice(F.array_sort(F.array_agg("_us")), 1, 2)
    ranked = (df.select(*keys, F.unix_micros(F.col(ts)).alias("_us"))
              .withColumn("_rk", F.row_number().over(Window.partitionBy(*keys).orderBy("_us")))
              .filter(F.col("_rk") <= 2))
    gap = (F.col("_t")[1] - F.col("_t")[0]) / 1e6
    return (ranked.groupBy(*keys).agg(first_two.alias("_t"))
            .select(*keys, F.when((F.size("_t") == 2) & (gap > 0), gap)
                    .otherwise(F.lit(default_s)).alias("period_s")))


def rows_for(minutes: float, period_s: float, at_least: int) -> int:
    return max(at_least, int(minutes * 60 / period_s))


def frozen_windows(df: DataFrame, rows: int, min_std: float = 1e-4, keys: Sequence[str] = SERIES,
                   ts: str = "ts", value: str = "value", tie: Sequence[str] = (),
                   seconds: int | None = None) -> DataFrame:
    """Rows whose previous `rows` readings do not vary; `stuck_value` is the previous reading."""
    d = index_rows(df, keys, [ts, *tie], ts, seconds)
    d, parts, own = with_halo(d, keys, rows, block_rows=TARGET_ROWS if seconds else None)
    past = row_frame(parts, "rn", -rows, -1)
    d = (d.withColumn("window_std", F.stddev_pop(value).over(past))
         .withColumn("_n", F.count(value).over(past))
         .withColumn("stuck_value", F.lag(value).over(Window.partitionBy(*parts).orderBy("rn"))))
    return (d.filter(own & (F.col("_n") == rows) & (F.col("window_std") < F.lit(min_std)))
            .drop("_n", "_own", "_block", "n_rows"))


def frozen_alerts(df: DataFrame, rows: int, window_minutes: float = 20, min_std: float = 1e-4,
                  cooldown_s: float = 1800, seconds: int | None = None) -> DataFrame:
    v = thin(frozen_windows(df, rows, min_std, seconds=seconds), SERIES, cooldown_s, seconds=seconds)
    return as_alerts(
        v, detector="FrozenSensor", alert_type="frozen_sensor", severity=F.lit("high"),
        value=F.col("stuck_value"), lim=F.lit(float(min_std)), confidence=F.lit(0.95),
        message=F.format_string("%s has not moved from %.4f for %d readings", F.col("tag"),
                                F.col("stuck_value"), F.lit(rows)),
        extra=extra_struct(duration_minutes=F.lit(float(window_minutes))),
    )


def trend_fits(df: DataFrame, rows: int, smooth_rows: int, step: int = 1, keys: Sequence[str] = SERIES,
               ts: str = "ts", value: str = "value", tie: Sequence[str] = (),
               seconds: int | None = None) -> DataFrame:
    """Rolling mean, then least squares over `rows` smoothed readings ending at the row.

    Evaluated at rows rows, rows+step, …; slope is per minute.
    """
    d = index_rows(df, keys, [ts, *tie], ts, seconds)
    # short blocks spread a long series over tasks and keep the sums below well conditioned
    reach = rows + smooth_rows
    d, parts, own = with_halo(d, keys, reach, block_rows=max(512, 8 * reach))
    d = d.withColumn("smooth", F.avg(value).over(row_frame(parts, "rn", -(smooth_rows - 1), 0)))
    # minutes from a point inside the block: least squares does not depend on the origin
    origin = F.min(ts).over(Window.partitionBy(*parts))
    d = d.withColumn("_min", (F.unix_micros(F.col(ts)) - F.unix_micros(origin)) / 60e6)
    w = row_frame(parts, "rn", -(rows - 1), 0)
    y, x = F.col("smooth"), F.col("_min")
    n = F.lit(float(rows))
    d = (d.withColumn("_n", F.count(y).over(w)).withColumn("_sx", F.sum(x).over(w))
         .withColumn("_sy", F.sum(y).over(w)).withColumn("_sxx", F.sum(x * x).over(w))
         .withColumn("_sxy", F.sum(x * y).over(w)).withColumn("_var", F.var_pop(y).over(w)))
    at = ((F.col("rn") - F.lit(rows)) % F.lit(step) == 0) & (F.col("rn") >= rows)
    d = d.filter(own & at & (F.col("_n") == rows))
    cxx = F.col("_sxx") - F.col("_sx") * F.col("_sx") / n
    cxy = F.col("_sxy") - F.col("_sx") * F.col("_sy") / n
    cyy = F.col("_var") * n
    # fewer than three rows, one instant or no variation: no trend
    level = F.lit(rows < 3) | (cxx < 1e-12)
    d = d.withColumn("slope", F.when(level, 0.0).otherwise(cxy / cxx))
    d = d.withColumn("r2", F.when(level | (cyy < 1e-12), 0.0).otherwise(
        F.least(F.greatest(cxy * cxy / (cxx * cyy), F.lit(0.0)), F.lit(1.0))))
    return d.drop("_n", "_sx", "_sy", "_sxx", "_sxy", "_var", "_min", "_own", "_block", "n_rows")


def time_to_limit(fits: DataFrame, min_r2: float = 0.25, horizon_minutes: float = 240) -> DataFrame:
    """Fits whose line reaches `low` or `high` within the horizon (needs those columns)."""
    cur, slope = F.col("smooth"), F.col("slope")
    up = (slope > 1e-9) & F.col("high").isNotNull() & (cur < F.col("high"))
    down = (slope < -1e-9) & F.col("low").isNotNull() & (cur > F.col("low"))
    d = fits.withColumn("breach", F.when(up, F.col("high")).when(down, F.col("low")))
    d = d.withColumn("minutes_to_limit", (F.col("breach") - cur) / slope)
    return d.filter((F.col("r2") >= min_r2) & F.col("minutes_to_limit").between(0, horizon_minutes))


def trend_alerts(df: DataFrame, limits: DataFrame, rows: int, smooth_rows: int, step: int = 1,
                 min_r2: float = 0.25, horizon_minutes: float = 240, cooldown_s: float = 1800,
                 seconds: int | None = None) -> DataFrame:
    """`limits` is a dimension (tag, low, high) of declared tags."""
    lim = checked_broadcast(limits.select("tag", "low", "high")
                      .filter(F.col("low").isNotNull() | F.col("high").isNotNull()))
    fits = trend_fits(df.join(checked_broadcast(limits.select("tag")), "tag", "left_semi"),
                      rows, smooth_rows, step, seconds=seconds)
    v = time_to_limit(fits.join(lim, "tag"), min_r2, horizon_minutes)
    v = thin(v, SERIES, cooldown_s, seconds=seconds)
    return as_alerts(
        v, detector="Trend.Projection", alert_type="trend_projection",
        severity=severity_from_minutes(F.col("minutes_to_limit")), value=F.col("smooth"),
        side=F.when(F.col("slope") > 0, "above").otherwise("below"),
        lim=F.col("breach"), confidence=F.col("r2"),
        message=F.format_string("%s at %.3f moves %+.4f per minute and meets %.3f in %.1f min", F.col("tag"),
                                F.col("smooth"), F.col("slope"), F.col("breach"),
                                F.col("minutes_to_limit")),
        extra=extra_struct(slope_per_minute=F.col("slope"), r_squared=F.col("r2"),
                           minutes_to_limit=F.col("minutes_to_limit")),
    )
