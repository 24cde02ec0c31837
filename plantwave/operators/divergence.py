"""Sustained disagreement of a model with a measurement, and forecast violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ladders import severity_from_divergence
from .alerts import as_alerts, extra_struct
from .ordered import index_rows, last_known, previous_value
from .recurrences import thin
from .scale import checked_broadcast, with_chunk


def divergence_runs(scored: DataFrame, keys: Sequence[str], min_rows: int, cooldown_rows: int,
                    abs_tol: float = 0.5, rel_tol: float = 0.01, ts: str = "ts", actual: str = "actual",
                    predicted: str = "predicted", std: str = "std", seconds: int | None = None) -> DataFrame:
    """Runs of consecutive rows beyond max(abs_tol, rel_tol·|y|, 3σ), long enough and rested.

    One row per emitted run with its peak row; the cooldown counts rows between run starts.
    """
    d = scored.withColumn("residual", F.col(actual) - F.col(predicted))
    d = d.withColumn("threshold", F.greatest(
        F.lit(float(abs_tol)), rel_tol * F.abs(F.col(actual)), 3.0 * F.col(std)))
    d = d.withColumn("_off", F.coalesce(F.abs(F.col("residual")) > F.col("threshold"), F.lit(False)))
    d = with_chunk(d, ts, seconds) if seconds else d
    d = index_rows(d, keys, [ts], ts, seconds)
    d = previous_value(d, keys, [ts], "_off", "_was", ts, seconds)
    opens = F.col("_off") & ~F.coalesce("_was", F.lit(False))
    d = last_known(d, keys, [ts], F.when(opens, F.col("rn")), "run_start", ts, seconds).filter("_off")
    size = F.abs(F.col("residual"))
    runs = d.groupBy(*keys, "run_start").agg(
        F.count(F.lit(1)).alias("run_rows"),
        F.max_by(F.struct(F.col(ts).alias("ts"), actual, predicted, "residual", "threshold"),
                 F.struct(size, -F.col("rn"))).alias("_p"))
    runs = (runs.filter(F.col("run_rows") >= min_rows)
            .select(*keys, "run_start", "run_rows", "_p.*")
            .withColumn("cooldown_s", F.lit(cooldown_rows / 1e6)))
    kept = _thin_by_row(runs, keys)
    ratio = F.abs(F.col("residual")) / F.greatest(F.col("threshold"), F.lit(1e-6))
    return kept.withColumn("ratio", ratio).withColumn("severity", severity_from_divergence(ratio))


def _thin_by_row(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    # row numbers stand in for time; 1 µs per row
    d = runs.withColumn("_row_ts", F.timestamp_micros(F.col("run_start")))
    return thin(d, keys, ts="_row_ts").drop("_row_ts", "cooldown_s")


def divergence_alerts(scored: DataFrame, tag: str, min_rows: int, cooldown_rows: int, period_s: float = 60.0,
                      seconds: int | None = None, **tolerance) -> DataFrame:
    runs = divergence_runs(scored, ["asset", "scenario"], min_rows, cooldown_rows, seconds=seconds, **tolerance)
    minutes = F.col("run_rows") * period_s / 60.0
    return as_alerts(
        runs, detector="SoftSensor.Divergence", alert_type="trend_projection", severity=F.col("severity"),
        tag=F.lit(tag), side=F.when(F.col("residual") > 0, "above").otherwise("below"),
        value=F.col("actual"), lim=F.col("predicted"), confidence=F.lit(0.80),
        message=F.format_string(tag.replace("%", "%%") + " differs from its model by %.3f for %.0f min",
                                F.abs(F.col("residual")), minutes),
        extra=extra_struct(actual=F.col("actual"), predicted=F.col("predicted"), residual=F.col("residual"),
                           duration_minutes=minutes))


def forecast_violations(forecasts: DataFrame, limits: DataFrame, period_min: float = 1.0,
                        cooldown_minutes: float = 30.0, keys: Sequence[str] = ("asset", "scenario"),
                        seconds: int | None = None, steps: Sequence[int] | None = None) -> DataFrame:
    """Earliest predicted limit crossing per target.

    `forecasts`: keys, ts, tag, current, trajectory array.  `limits` (fixed rows): tag,
    limit, direction, near, far, far_offset.  `steps` are the periods ahead of the trajectory's
    values, in ascending order; by default 1, 2, 3, …
    """
    d = forecasts.join(checked_broadcast(limits), "tag")
    crossed = F.transform("trajectory", lambda v: F.when(
        F.col("direction") == "below", v < F.col("limit")).otherwise(v > F.col("limit")))
    step = F.array_position(crossed, F.lit(True))
    d = d.withColumn("step", step).filter(F.col("step") > 0)
    d = d.withColumn("predicted", F.element_at("trajectory", F.col("step").cast("int")))
    if steps is not None:
        d = d.withColumn("step", F.element_at(F.array(*map(F.lit, steps)), F.col("step").cast("int")))
    d = d.withColumn("horizon_minutes", F.col("step") * float(period_min))
    d = d.withColumn("excess", F.when(F.col("direction") == "below", F.col("limit") - F.col("predicted"))
                     .otherwise(F.col("predicted") - F.col("limit")))
    d = d.withColumn("severity", F.when(F.col("excess") >= F.col("far_offset"), F.col("far"))
                     .otherwise(F.col("near"))).drop("trajectory")
    return thin(d, [*keys, "tag", "direction"], cooldown_minutes * 60, strict=False, seconds=seconds)


def forecast_alerts(forecasts: DataFrame, limits: DataFrame, period_min: float = 1.0,
                    cooldown_minutes: float = 30.0, seconds: int | None = None,
                    steps: Sequence[int] | None = None) -> DataFrame:
    v = forecast_violations(forecasts, limits, period_min, cooldown_minutes, seconds=seconds, steps=steps)
    return as_alerts(
        v, detector="LSTM.Forecast", alert_type="trend_projection", severity=F.col("severity"),
        side=F.col("direction"), value=F.col("current"), lim=F.col("limit"), confidence=F.lit(0.75),
        message=F.format_string("%s is forecast %s %.2f in %.0f min (%.2f)", F.col("tag"), F.col("direction"),
                                F.col("limit"), F.col("horizon_minutes"), F.col("predicted")),
        extra=extra_struct(direction=F.col("direction"), predicted=F.col("predicted"),
                           actual=F.col("current"), horizon_minutes=F.col("horizon_minutes"),
                           excess=F.col("excess")))
