"""Trained models as detectors of a monitoring run: pass them to `monitor(…, extra=[…])`.

Each takes the readings of all runs and returns alerts, so their sessions reach the rules like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import physical_name
from ..operators.divergence import divergence_alerts, forecast_alerts
from ..operators.learn import Forecaster, SoftSensor
from ..operators.windows import lag_features
from ..sources.samples import to_wide
from .monitoring import Detector


def _columns(needed: Sequence[str], tags: Sequence[str]) -> None:
    absent = sorted(set(needed) - {physical_name(t) for t in tags})
    if absent:
        raise ValueError(f"the model needs columns that no tag gives: {', '.join(absent)}")


def soft_sensor_detector(sensor: SoftSensor, tags: Sequence[str], target: str, period_s: float = 60.0,
                         min_minutes: float = 10.0, cooldown_minutes: float = 30.0, seconds: int | None = None,
                         **tolerance) -> Detector:
    """Alerts where the reading of `target` leaves its model's prediction for `min_minutes` or longer.

    `tags` name the model's inputs and the target.  A time at which one of them has no reading has no
    prediction and ends a run, so a run without these tags raises nothing.
    """
    _columns([*sensor.features, physical_name(target)], tags)

    def detect(readings: DataFrame) -> DataFrame:
        scored = sensor.predict(to_wide(readings, tags)).withColumn("actual", F.col(physical_name(target)))
        return divergence_alerts(
            scored.select("asset", "scenario", "ts", "actual", "predicted", "std"), target,
            max(3, int(min_minutes * 60 / period_s)), max(1, int(cooldown_minutes * 60 / period_s)), period_s,
            seconds=seconds, **tolerance)
    return detect


def forecast_detector(model: Forecaster, tags: Sequence[str], limits: DataFrame, period_s: float = 60.0,
                      every_minutes: float = 15.0, cooldown_minutes: float = 30.0,
                      seconds: int | None = None) -> Detector:
    """Alerts on the earliest forecast step of each target that passes its limit.

    Every run is evaluated each `every_minutes` from its first row with a whole lookback on, its last
    rows included.  `limits` are the rows that `forecast_violations` takes; a target without one is skipped.
    """
    _columns([*model.features, *model.targets], tags)
    named = {physical_name(t): t for t in tags}
    every, steps = max(1, round(every_minutes * 60 / period_s)), sorted(model.horizons)

    def detect(readings: DataFrame) -> DataFrame:
        rows = lag_features(to_wide(readings, tags), model.features, [], model.lags, [], seconds=seconds,
                            carry=model.targets)
        rows = model.predict(rows.filter((F.col("rn") - max(model.lags) - 1) % every == 0))
        ahead = F.explode(F.array(*[F.struct(
            F.lit(named[t]).alias("tag"), F.col(t).cast("double").alias("current"),
            F.array(*[F.col(f"p_{t}__h{h}") for h in steps]).alias("trajectory")) for t in model.targets]))
        forecasts = rows.select("asset", "scenario", F.col("now_ts").alias("ts"), ahead.alias("x")).select(
            "asset", "scenario", "ts", "x.*")
        return forecast_alerts(forecasts, limits, period_s / 60.0, cooldown_minutes, seconds=seconds, steps=steps)
    return detect
