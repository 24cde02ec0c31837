"""Rules on hand-made sessions, the decision cascade and outcomes."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantwave.model import ACTION_DDL, EXTRA_DDL, dim_tag
from plantwave.operators import decisions as dec
from plantwave.operators import rules
from plantwave.operators.rules import BATCH_RULES, PILOT_RULES, recommend, session_context

T0 = datetime(2026, 1, 1, 6)
EXTRA = "struct<" + EXTRA_DDL.replace(" DOUBLE", ": double").replace(" STRING", ": string") + ">"
FIELDS = [f.split(" ")[0] for f in EXTRA_DDL.split(", ")]


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def sessions(spark, *rows):
    """rows: dict(id, detector, tag, start, end, value, side, severity, count, confidence, extra)."""
    out = []
    for r in rows:
        extra = tuple(r.get("extra", {}).get(f) for f in FIELDS)
        alert = (at(r["start"]), r.get("severity", "low"), r.get("side"), r.get("value"), r.get("lim", 0.0),
                 r.get("confidence", 1.0), "", extra)
        out.append(("a", "s", r["id"], r["detector"], r.get("tag"), at(r["start"]), at(r.get("end", r["start"])),
                    r.get("count", 1), r.get("severity", "low"), alert, alert))
    alert = ("struct<ts: timestamp, severity: string, side: string, value: double, lim: double, confidence: double, "
             f"message: string, extra: {EXTRA}>")
    return spark.createDataFrame(out, "asset string, scenario string, session_id string, detector string, tag string, "
                                      "start_ts timestamp, end_ts timestamp, alert_count long, peak_severity string, "
                                      f"first_alert {alert}, peak_alert {alert}")


def readings(spark, values, minutes=range(-60, 400, 5)):
    rows = [("a", "s", at(m), t, v + (0.01 * (m % 7) if t != "cstr.T_J_C" else 0.0)) for t, v in values.items() for m in minutes]
    return spark.createDataFrame(rows, "asset string, scenario string, ts timestamp, tag string, value double")


PILOT = {"cstr.F_cool": 0.3, "cstr.T_R_C": 79.0, "cstr.C_A": 170.0, "column.purity_B": 98.0, "column.RR": 5.5, "column.Q_reb_kW": 260.0}


def run(spark, rows, values=PILOT, pack=PILOT_RULES, **kw):
    ctx = session_context(sessions(spark, *rows), readings(spark, values), **kw)
    return {(r.rule_id, r.triggering_sessions[0]): r for r in recommend(ctx, pack).collect()}


def test_thermal_drift_proposes_more_coolant(spark):
    got = run(spark, [dict(id="x", detector="SPC.EWMA", tag="cstr.T_R_C", start=0, value=82.5, side="above", count=30),
                      dict(id="low", detector="SPC.EWMA", tag="cstr.T_R_C", start=100, value=82.5, side="below"),
                      dict(id="cold", detector="SPC.EWMA", tag="cstr.T_R_C", start=300, value=79.0, side="above")])
    assert set(got) == {("R01_ThermalDrift", "x")}
    r = got["R01_ThermalDrift", "x"]
    assert (r.urgency, r.confidence) == ("high", 0.85) and r.priority == pytest.approx(78.5)
    assert r.action.proposed_value == pytest.approx(r.action.current_value * 1.15)
    assert [i.variable for i in r.expected_impact] == ["cstr.T_R_C", "cstr.F_cool"]
    assert r.expected_impact[0].predicted_value == pytest.approx(82.0)


def test_feed_composition_needs_company(spark):
    t2 = dict(id="t2", detector="PCA.T2", tag=None, start=0, value=30.0)
    ca = dict(id="ca", detector="SPC.EWMA", tag="cstr.C_A", start=60, value=180.0)
    pu = dict(id="pu", detector="SPC.Shewhart", tag="column.purity_B", start=-80, end=-75, value=98.0)
    assert ("R02_FeedComposition", "t2") not in run(spark, [t2, ca])
    got = run(spark, [t2, ca, pu])["R02_FeedComposition", "t2"]
    assert got.urgency == "medium" and got.action.target_variable == "column.RR" and len(got.expected_impact) == 2
    assert ("R02_FeedComposition", "t2") not in run(spark, [t2, ca, pu], causal=True)


def test_oscillation_counts_neighbours(spark):
    rows = [dict(id=f"c{i}", detector="Regime.CUSUM", tag="cstr.F_cool", start=25 * i, value=0.4) for i in range(4)]
    got = run(spark, rows)
    assert {k[1] for k in got if k[0].startswith("R03")} == {"c0", "c3"}  # c1 and c2 come within an hour of c0
    assert not run(spark, rows[:3])


def test_purity_rules_and_negated_company(spark):
    pu = dict(id="p", detector="SPC.EWMA", tag="column.purity_B", start=0, value=97.0)
    assert ("R04_ColumnEfficiencyLoss", "p") in run(spark, [pu])
    tr = dict(id="t", detector="SPC.Shewhart", tag="cstr.T_R_C", start=30, value=70.0)
    assert ("R04_ColumnEfficiencyLoss", "p") not in run(spark, [pu, tr])
    trend = dict(id="q", detector="Trend.Projection", tag="column.purity_B", start=0, value=98.6, confidence=0.6,
                 extra={"minutes_to_limit": 10.0})
    r = run(spark, [trend])["R06_PurityDeviation", "q"]
    assert r.urgency == "critical" and r.confidence == pytest.approx(0.7)


def test_missing_value_is_no_firing_and_frees_the_slot(spark):
    rows = [dict(id="early", detector="Trend.Projection", tag="column.purity_B", start=-70, value=1.0, extra={"minutes_to_limit": 20.0}),
            dict(id="late", detector="Trend.Projection", tag="column.purity_B", start=-40, value=1.0, extra={"minutes_to_limit": 20.0})]
    # readings start at -60, so the first session has no purity and must not block the second
    assert set(run(spark, rows)) == {("R06_PurityDeviation", "late")}


def test_repeat_window_is_inclusive(spark):
    rows = [dict(id=f"s{m}", detector="Trend.Projection", tag="column.purity_B", start=m, value=1.0) for m in (0, 59, 60, 119, 121)]
    assert {k[1] for k in run(spark, rows)} == {"s0", "s60", "s121"}


def test_sensor_fault_by_detector_and_by_still_signal(spark):
    values = dict(PILOT, **{"cstr.T_J_C": 57.0})
    got = run(spark, [dict(id="f", detector="FrozenSensor", tag="cstr.C_A", start=0, value=1.0),
                      dict(id="still", detector="SPC.EWMA", tag="cstr.T_J_C", start=0, value=1.0),
                      dict(id="rr", detector="FrozenSensor", tag="column.RR", start=0, value=1.0)],
              values, )
    assert {k for k in got if k[0] == "R07_SensorFault"} == {("R07_SensorFault", "f")}
    close = readings(spark, values, range(-60, 10))
    ctx = session_context(sessions(spark, dict(id="still", detector="SPC.EWMA", tag="cstr.T_J_C", start=0, value=1.0)), close)
    assert [r.rule_id for r in recommend(ctx, PILOT_RULES).collect()] == ["R07_SensorFault"]


def test_model_based_rules(spark):
    got = run(spark, [dict(id="d", detector="SoftSensor.Divergence", tag="column.purity_B", start=0, value=1.0,
                           extra={"actual": 99.0, "predicted": 97.5, "residual": 1.5, "duration_minutes": 12.0}),
                      dict(id="l", detector="LSTM.Forecast", tag="column.purity_B", start=0, value=99.0, lim=98.5,
                           extra={"actual": 99.0, "predicted": 98.0, "horizon_minutes": 8.0, "direction": "below", "excess": 0.5})])
    assert got["R09_SoftSensorDivergence", "d"].urgency == "medium"
    r = got["R10_PredictedExcursion", "l"]
    assert (r.urgency, r.action.target_variable, r.action.adjustment) == ("high", "column.RR", 0.3)
    assert r.action.proposed_value is None and r.affected_variables == ["column.purity_B", "column.RR"]


def test_batch_pack(spark):
    v = {"batch.F_cool": 0.9, "batch.T_R_C": 96.0, "batch.conversion": 0.5}
    got = run(spark, [dict(id="h", detector="SPC.Shewhart", tag="batch.T_R_C", start=0, severity="critical", value=97.0),
                      dict(id="m", detector="SPC.Shewhart", tag="batch.T_R_C", start=300, severity="medium", value=97.0),
                      dict(id="r", detector="SPC.EWMA", tag="batch.dHdt", start=30, severity="high", value=300.0),
                      dict(id="c", detector="SPC.EWMA", tag="batch.conversion", start=0, severity="medium", value=0.5)], v, BATCH_RULES)
    assert set(got) == {("B01_HighReactorTemp", "h"), ("B02_RunawayRisk", "r"), ("B03_LowConversion", "c")}
    assert got["B01_HighReactorTemp", "h"].action.proposed_value == 1.0
    assert got["B03_LowConversion", "c"].expected_impact == []


# --- decisions --------------------------------------------------------------------

def recs(spark, *rows):
    out = []
    for i, (kind, target, current, proposed, urgency, confidence) in enumerate(rows):
        adj = None if proposed is None else proposed - current
        out.append((f"REC-{i}", "a", "s", "R", urgency, confidence, T0, (kind, "d", target, current, proposed, adj, "u")))
    return spark.createDataFrame(out, "id string, asset string, scenario string, rule_id string, urgency string, "
                                      f"confidence double, ts timestamp, action {ACTION_DDL}")


def test_cascade_order(spark):
    r = recs(spark, ("adjust_setpoint", "column.RR", 7.9, 8.5, "critical", .9), ("adjust_setpoint", "column.RR", 5.0, 5.0005, "critical", .9),
             ("adjust_setpoint", "column.RR", 5.0, 5.3, "low", .9), ("adjust_setpoint", "column.RR", 5.0, 5.3, "low", .8),
             ("investigate", None, None, None, "critical", .9), ("adjust_setpoint", "unknown.tag", 1.0, 999.0, "critical", .9))
    d = {x.recommendation_id: x for x in dec.decide(r, dim_tag(spark), "autonomous_supervised", dec.accept_critical()).collect()}
    assert [d[f"REC-{i}"].operator_id for i in range(6)] == [
        "system_safety", "system_filter", "system_autonomous", "operator_conservative", "operator_conservative", "operator_conservative"]
    assert [d[f"REC-{i}"].status for i in range(6)] == ["rejected", "rejected", "auto_executed", "rejected", "accepted", "accepted"]
    semi = dec.decide(r, dim_tag(spark)).filter("status = 'pending'").count()
    assert semi == 4
    ids = [dec.decide(r, dim_tag(spark)).orderBy("id").first().id for _ in range(2)]
    assert ids[0] == ids[1]


def test_execution_by_mode(spark):
    r = recs(spark, ("adjust_setpoint", "column.RR", 5.0, 5.3, "low", .9), ("investigate", None, None, None, "low", .9))
    d = dec.decide(r, dim_tag(spark), policy=dec.accept_all())
    assert sorted((x.status, x.executor) for x in dec.execute(d).collect()) == [
        ("not_required", "operator_aggressive"), ("success", "system_semi_auto")]
    assert sorted(x.executor for x in dec.execute(d, "advisor").collect()) == ["operator_aggressive", "operator_manual"]


def test_dampening(spark):
    r = recs(spark, ("adjust_setpoint", "column.RR", 5.0, 6.0, "low", .9))
    a = dec.decide(r, dim_tag(spark), policy=dec.accept_reduced()).first().actual_action
    assert a.proposed_value == pytest.approx(5.7) and a.adjustment == pytest.approx(0.7) and a.description.endswith("[reduced by operator]")


def outcome(spark, impacts, hours=3, start=0):
    ddl = "array<struct<variable: string, current_value: double, predicted_value: double, time_to_effect_minutes: double, description: string>>"
    r = spark.createDataFrame([("REC-0", "a", "s", "R", "low", impacts)],
                              f"id string, asset string, scenario string, rule_id string, urgency string, expected_impact {ddl}")
    rd = spark.createDataFrame([("a", "s", at(m), "column.purity_B", 98.0 + m / 1000) for m in range(0, 60 * hours)],
                               "asset string, scenario string, ts timestamp, tag string, value double")
    e = spark.createDataFrame([("EXE-0", "DEC-0", "REC-0", "a", "s", at(start), "success", "x")],
                              "id string, decision_id string, recommendation_id string, asset string, scenario string, ts timestamp, status string, executor string")
    return dec.measure(e, r, rd), r


def test_outcome_quality(spark):
    o, r = outcome(spark, [("column.purity_B", 98.0, 99.0, 30.0, ""), ("column.purity_B", 98.0, 10.0, 60.0, ""), ("column.RR", 1.0, None, 5.0, "")])
    x = o.first()
    assert x.quality_score == 0.5 and x.measurement_delay_minutes == 60.0 and len(x.metrics) == 3
    assert x.metrics[0].actual == pytest.approx(98.03) and x.metrics[0].within is True and x.metrics[1].within is False
    assert x.metrics[2].actual is None and x.metrics[2].within is None
    assert dec.outcome_summary(o, r).count() == 1


def test_outcome_default_delay_and_missing_data(spark):
    assert outcome(spark, [("column.purity_B", 98.0, 99.0, 0.0, "")])[0].first().measurement_delay_minutes == 30.0
    assert outcome(spark, [("column.purity_B", 98.0, None, None, "")])[0].first().quality_score == 0.5
    assert outcome(spark, [("column.purity_B", 98.0, 99.0, 30.0, "")], start=170)[0].count() == 0
    assert outcome(spark, [])[0].count() == 0


def test_due_predicate(spark):
    d = spark.range(1).select(*[dec.is_due(F.lit(s), F.array(*[F.struct(F.lit(m).cast("double").alias("time_to_effect_minutes")) for m in ms]),
                                           F.lit(T0), F.lit(at(now))).alias(n)
                                for n, s, ms, now in (("a", "accepted", [30, 45], 45), ("b", "accepted", [30, 45], 44), ("c", "rejected", [30], 99),
                                                      ("d", "modified", [0], 30))]).first()
    assert (d.a, d.b, d.c, d.d) == (True, False, False, True)


def test_track_record_neutral_until_enough(spark):
    n = spark.createDataFrame([("R", 4, 2, 1, 1, 3, 3, 0), ("Q", 20, 10, 5, 5, 0, 0, 0), ("S", 20, 10, 0, 10, 10, 5, 5)],
                              "rule_id string, total_recs long, accepted long, modified long, rejected long, outcomes_measured long, successes long, failures long")
    d = {r.rule_id: r for r in dec.with_rates(n).collect()}
    assert d["R"].confidence_adj == 1.0 and d["Q"].confidence_adj == pytest.approx(0.5 + 0.375 + 0.25)
    assert d["S"].confidence_adj == pytest.approx(1.0) and d["Q"].success_rate == 0.0


def test_rule_names_are_unique():
    names = [r.name for r in PILOT_RULES + BATCH_RULES]
    assert len(names) == len(set(names)) == 13
    assert rules.NON_SENSED
