"""The whole run on a plant with one healthy and two faulty scenarios."""

import numpy as np
import pytest

from plantwave.model import dim_tag
from plantwave.operators import decisions as dec
from plantwave.plans.monitoring import Settings, monitor
from plantwave.sources import tables

from . import data


@pytest.fixture(scope="module")
def run(spark):
    n = 600
    hot = data.wide(n, seed=1)
    hot["cstr.T_R_C"] += np.linspace(0, 6, n)
    stuck = data.wide(n, seed=2)
    stuck.loc[200:320, "column.purity_B"] = 99.31
    r = data.readings(spark, data.long(data.wide(n), "normal"), data.long(hot, "thermal_drift"), data.long(stuck, "sensor_failure")).cache()
    cfg = Settings(baseline_scenario="normal", pca_tags=["cstr.T_R_C", "cstr.T_J_C", "column.T_bot_C", "column.T_top_C", "column.Q_reb_kW"])
    return monitor(r, dim_tag(spark).filter("profile = 'pilot'"), cfg, policy=dec.accept_all())


def test_faults_lead_to_the_right_rules(run):
    got = {(r.scenario, r.rule_id) for r in run.recommendations.select("scenario", "rule_id").distinct().collect()}
    assert ("thermal_drift", "R01_ThermalDrift") in got and ("sensor_failure", "R07_SensorFault") in got
    assert ("normal", "R01_ThermalDrift") not in got and ("normal", "R07_SensorFault") not in got


def test_detectors_and_warmup(run):
    found = {(r.scenario, r.detector) for r in run.alerts.select("scenario", "detector").distinct().collect()}
    assert {("thermal_drift", d) for d in ("SPC.Shewhart", "SPC.EWMA", "Regime.CUSUM", "Trend.Projection", "PCA.SPE")} <= found
    assert ("sensor_failure", "FrozenSensor") in found
    assert run.alerts.filter("ts < timestamp'2026-01-01 00:15:00'").count() == 0


def test_trail_is_linked(run):
    r, d, e, o = run.recommendations, run.decisions, run.executions, run.outcomes
    assert r.select("id").distinct().count() == r.count() == d.count() > 0
    assert d.join(r.withColumnRenamed("id", "recommendation_id"), "recommendation_id", "left_anti").count() == 0
    assert e.join(d.withColumnRenamed("id", "decision_id"), "decision_id", "left_anti").count() == 0
    assert 0 < o.count() <= e.count()
    assert o.filter("quality_score < 0 OR quality_score > 1").count() == 0
    rec = dec.track_record(r, d, o.join(r.selectExpr("id as recommendation_id", "rule_id"), "recommendation_id"))
    assert rec.filter("total_recs < accepted + modified + rejected").count() == 0


def test_flat_tables(run):
    assert tables.alerts_table(run.alerts).count() == run.alerts.count()
    assert tables.sessions_table(run.sessions).columns[:4] == ["detector", "tag", "start_ts", "end_ts"]
    assert tables.recommendations_table(run.recommendations).filter("action_type IS NULL").count() == 0
    assert tables.decisions_table(run.decisions).count() == run.decisions.count()
    assert tables.outcomes_table(run.outcomes).filter("n_metrics = 0").count() == 0
