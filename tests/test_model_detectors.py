"""Trained models as detectors, from readings to rules; forced promotion."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantwave.operators import learn, rules, sessions
from plantwave.operators.windows import lag_features
from plantwave.plans import retrain
from plantwave.plans.model_detectors import forecast_detector, soft_sensor_detector
from plantwave.sources.samples import to_wide

from . import data

TAGS = ["column.T_top_C", "column.RR", "column.purity_B"]
T, RR, PURITY = "column_T_top_C", "column_RR", "column_purity_B"


def plant(seed, n=240):
    d = data.wide(n, seed)[["ts", *TAGS]]
    d["column.RR"] += np.sin(np.arange(n) / 9)
    d["column.purity_B"] = 90 + d["column.RR"] + np.random.default_rng(seed).normal(0, 0.01, n)
    return d


@pytest.fixture(scope="module")
def readings(spark):
    off, falling = plant(2), plant(3)
    off.loc[100:129, "column.purity_B"] += 2.5
    falling["column.purity_B"] -= np.linspace(0, 6, len(falling))
    few = plant(4, 3)
    return data.readings(spark, *(data.long(d, s) for d, s in ((plant(1), "normal"), (off, "off"), (falling, "falling"), (few, "few")))).cache()


def limits(spark):
    return spark.createDataFrame([("column.purity_B", 91.0, "below", "medium", "high", 1.0)],
                                 "tag string, limit double, direction string, near string, far string, far_offset double")


def test_soft_sensor_in_a_run(spark, readings):
    normal = to_wide(readings.filter("scenario = 'normal'"), TAGS)
    sensor = learn.fit_soft_sensor(normal, [T, RR], PURITY, F.unix_seconds("ts"), n_models=2, trees=12, depth=4, step=0.3, min_leaf=5)
    alerts = soft_sensor_detector(sensor, TAGS, "column.purity_B", abs_tol=1.0)(readings).checkpoint()
    assert {(r.scenario, r.tag, r.side) for r in alerts.filter("scenario <> 'falling'").collect()} == {("off", "column.purity_B", "above")}
    with pytest.raises(ValueError):
        soft_sensor_detector(sensor, TAGS[1:], "column.purity_B")
    found = sessions.sessionise(alerts, 30.0).checkpoint()
    recs = rules.recommend(rules.session_context(found, readings), rules.PILOT_RULES)
    assert "R09_SoftSensorDivergence" in {r.rule_id for r in recs.filter("scenario = 'off'").collect()}


@pytest.mark.parametrize("seconds", [None, 1800])
def test_forecasts_in_a_run(spark, readings, seconds):
    lags, steps = [0, 1, 2], [1, 5, 20]
    train = lag_features(to_wide(readings.filter("scenario IN ('normal', 'falling')"), TAGS), [PURITY], [PURITY], lags, steps)
    model = learn.fit_forecaster(train, [PURITY], [PURITY], lags, steps)
    alerts = forecast_detector(model, TAGS, limits(spark), seconds=seconds)(readings).orderBy("ts").collect()
    # the plain way: each 15th row with a whole lookback, half an hour of rest
    w = to_wide(readings, TAGS).orderBy("scenario", "ts").toPandas()
    want = []
    for name, d in w.groupby("scenario"):
        x, last = d[PURITY].to_numpy(), None
        for i in range(max(lags), len(x), 15):
            ahead = [np.dot(model.models[PURITY, h][0], [x[i - k] for k in lags]) + model.models[PURITY, h][1] for h in steps]
            at = d.ts.iloc[i]
            if min(ahead) < 91 and (last is None or at - last >= pd.Timedelta(minutes=30)):
                want.append((name, at, steps[[a < 91 for a in ahead].index(True)]))
                last = at
    assert want and sorted((r.scenario, r.ts, r.extra.horizon_minutes) for r in alerts) == sorted(want)
    assert all(r.detector == "LSTM.Forecast" and r.scenario != "few" for r in alerts)


def test_forced_promotion(spark):
    row = "model string, run_ts timestamp, snapshot_id string, mae double, rmse double, r2 double, n_train long, n_test long"
    make = lambda day, mae: spark.createDataFrame([("m", pd.Timestamp(f"2026-01-0{day}").to_pydatetime(), "s", mae, mae, 0.5, 10, 5)], row)
    worse, history = make(2, 2.0), make(1, 1.0)
    assert [retrain.with_promotion(worse, history, force=f).first().promoted for f in (False, True)] == [False, True]
