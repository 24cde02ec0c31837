"""Train, evaluate, stamp with the data snapshot and decide on promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.learn import (collapse_metrics, evaluate_forecaster, fit_soft_sensor, holdout,
                               should_promote)
from ..operators.reports import regression_metrics
from ..sources.tables import latest_metrics

METRICS_DDL = (
    "model STRING, run_ts TIMESTAMP, snapshot_id STRING, mae DOUBLE, rmse DOUBLE, r2 DOUBLE, n_train LONG, n_test LONG"
)


def _stamped(metrics: DataFrame, model: str, snapshot: str, run_ts: Column, n_train: int) -> DataFrame:
    return metrics.select(
        F.lit(model).alias("model"), run_ts.alias("run_ts"), F.lit(snapshot).alias("snapshot_id"),
        "mae", "rmse", "r2", F.lit(n_train).cast("long").alias("n_train"), F.col("n").alias("n_test"))


def with_promotion(new: DataFrame, history: DataFrame, threshold: float = 0.0, force: bool = False) -> DataFrame:
    """The new metrics row with its baseline and the promotion verdict; `force` promotes in any case."""
    base = latest_metrics(history).select("model", F.col("mae").alias("baseline_mae"))
    return new.join(base, "model", "left").withColumn(
        "promoted", F.lit(force) | should_promote(F.col("mae"), F.col("baseline_mae"), threshold))


def retrain_soft_sensor(samples: DataFrame, features: Sequence[str], target: str, key: Column, history: DataFrame,
                        snapshot: str, run_ts: Column, threshold: float = 0.0, force: bool = False, **model_args):
    train, test = holdout(samples, key)
    sensor = fit_soft_sensor(train, features, target, key, **model_args)
    metrics = regression_metrics(sensor.predict(test), [], target, "predicted")
    return sensor, with_promotion(_stamped(metrics, "soft_sensor", snapshot, run_ts, sensor.n_train),
                                  history, threshold, force)


def retrain_forecaster(wide: DataFrame, features, targets, lags, horizons, history: DataFrame, snapshot: str,
                       run_ts: Column, keys=("asset", "scenario"), ts: str = "ts", threshold: float = 0.0,
                       seconds: int | None = None, force: bool = False):
    model, metrics = evaluate_forecaster(wide, features, targets, lags, horizons, keys, ts, seconds=seconds)
    flat = metrics.agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2"),
                       F.max("n").alias("n"))
    worst = collapse_metrics(metrics).select("mae_worst")
    new = _stamped(flat, "forecaster", snapshot, run_ts, model.n_train)
    return model, with_promotion(new, history, threshold, force).join(F.broadcast(worst)), metrics
