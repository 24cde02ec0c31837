"""Schemas, ordered vocabularies and the two process profiles as dimension rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = ["asset", "scenario", "tag"]
RUN = ["asset", "scenario"]

# Ordered vocabularies, lowest first.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
URGENCIES = ["low", "medium", "high", "critical"]

READINGS_DDL = "asset STRING, scenario STRING, ts TIMESTAMP, tag STRING, value DOUBLE"

EXTRA_DDL = (
    "deviation_sigma DOUBLE, slope_per_minute DOUBLE, minutes_to_limit DOUBLE, r_squared DOUBLE, "
    "direction STRING, cusum DOUBLE, actual DOUBLE, predicted DOUBLE, residual DOUBLE, "
    "duration_minutes DOUBLE, horizon_minutes DOUBLE, excess DOUBLE"
)
ALERT_DDL = (
    "asset STRING, scenario STRING, ts TIMESTAMP, detector STRING, alert_type STRING, severity STRING, "
    "tag STRING, side STRING, value DOUBLE, lim DOUBLE, confidence DOUBLE, message STRING, "
    f"contributors MAP<STRING,DOUBLE>, extra STRUCT<{EXTRA_DDL.replace(' DOUBLE', ': DOUBLE').replace(' STRING', ': STRING')}>"
)
ALERT_COLUMNS = [
    "asset", "scenario", "ts", "detector", "alert_type", "severity", "tag", "side", "value", "lim",
    "confidence", "message", "contributors", "extra",
]
ACTION_DDL = (
    "STRUCT<type: STRING, description: STRING, target_variable: STRING, current_value: DOUBLE, "
    "proposed_value: DOUBLE, adjustment: DOUBLE, units: STRING>"
)
IMPACT_DDL = (
    "STRUCT<variable: STRING, current_value: DOUBLE, predicted_value: DOUBLE, "
    "time_to_effect_minutes: DOUBLE, description: STRING>"
)
RECOMMENDATION_DDL = (
    "id STRING, asset STRING, scenario STRING, ts TIMESTAMP, rule_id STRING, urgency STRING, priority DOUBLE, "
    "confidence DOUBLE, diagnosis STRING, probable_cause STRING, status STRING, "
    f"action {ACTION_DDL}, expected_impact ARRAY<{IMPACT_DDL}>, "
    "affected_variables ARRAY<STRING>, triggering_sessions ARRAY<STRING>"
)
DECISION_DDL = (
    "id STRING, recommendation_id STRING, ts TIMESTAMP, operator_id STRING, status STRING, "
    f"justification STRING, actual_action {ACTION_DDL}"
)
EXECUTION_DDL = "id STRING, decision_id STRING, ts TIMESTAMP, status STRING, executor STRING"
METRIC_DDL = (
    "STRUCT<variable: STRING, predicted: DOUBLE, actual: DOUBLE, delay_min: DOUBLE, "
    "dev_abs: DOUBLE, dev_pct: DOUBLE, within: BOOLEAN>"
)
OUTCOME_DDL = (
    "id STRING, execution_id STRING, decision_id STRING, recommendation_id STRING, ts TIMESTAMP, "
    f"measurement_delay_minutes DOUBLE, quality_score DOUBLE, metrics ARRAY<{METRIC_DDL}>, notes STRING"
)


def rank_of(col: Column | str, vocabulary: list[str]) -> Column:
    """Position of a string in an ordered vocabulary, -1 when unknown."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(-1)
    for i, word in enumerate(vocabulary):
        out = F.when(c == word, i).otherwise(out)
    return out


def severity_rank(col: Column | str) -> Column:
    return rank_of(col, SEVERITIES)


def urgency_rank(col: Column | str) -> Column:
    return rank_of(col, URGENCIES)


# --- Fixed values: the continuous process profile -------------------------------
# tag, units, spec_min, spec_max, is_kpi, measured, min_range, max_range, writable
PILOT_TAGS = [
    ("cstr.T_R_C", "°C", None, 82.0, True, True, 0.0, 150.0, False),
    ("cstr.T_J_C", "°C", None, None, True, True, 0.0, 100.0, False),
    ("cstr.C_A", "mol/m³", None, None, True, True, 0.0, 2000.0, False),
    ("cstr.F_feed", "m³/h", None, None, True, False, 0.0, 5.0, True),
    ("cstr.F_cool", "m³/h", None, None, True, False, 0.0, 1.0, True),
    ("cstr.T_feed_C", "°C", None, None, False, True, 0.0, 150.0, False),
    ("cstr.T_cool_in_C", "°C", None, None, False, True, 0.0, 50.0, False),
    ("cstr.P_R", "bar", None, None, False, True, 0.0, 10.0, False),
    ("cstr.conversion", "", 0.70, None, True, True, 0.0, 1.0, False),
    ("column.x_D", "", None, None, False, True, 0.0, 1.0, False),
    ("column.x_B_A", "", None, None, False, True, 0.0, 1.0, False),
    ("column.purity_B", "%", 98.5, None, True, True, 0.0, 100.0, False),
    ("column.T_top_C", "°C", None, None, True, True, 0.0, 150.0, False),
    ("column.T_bot_C", "°C", None, None, True, True, 0.0, 200.0, False),
    ("column.RR", "", None, None, True, False, 2.0, 8.0, True),
    ("column.F_vap_kgh", "kg/h", None, None, False, True, 0.0, 2000.0, False),
    ("column.Q_reb_kW", "kW", None, 320.0, True, True, 0.0, 500.0, False),
    ("column.P_top_bar", "bar", None, None, False, True, 0.0, 5.0, False),
    ("column.P_bot_bar", "bar", None, None, False, True, 0.0, 5.0, False),
]
# --- Fixed values: the batch process profile ------------------------------------
BATCH_TAGS = [
    ("batch.T_R_C", "°C", None, 95.0, True, True, None, None, False),
    ("batch.T_J_C", "°C", None, None, True, True, None, None, False),
    ("batch.T_cool_in_C", "°C", None, None, False, True, None, None, False),
    ("batch.C_A", "mol/m³", None, None, True, True, None, None, False),
    ("batch.C_P", "mol/m³", None, None, True, True, None, None, False),
    ("batch.conversion", "", 0.85, None, True, True, None, None, False),
    ("batch.F_cool", "m³/h", None, None, True, False, None, None, True),
    ("batch.dHdt", "kW", None, 250.0, True, True, None, None, False),
]
# --- Fixed values: operational limits (low, high) per tag ------------------------
OPERATIONAL_LIMITS = {
    "cstr.T_R_C": (75.0, 83.0),
    "cstr.T_J_C": (50.0, 65.0),
    "cstr.conversion": (0.78, None),
    "cstr.C_A": (None, 250.0),
    "column.purity_B": (98.5, None),
    "column.T_top_C": (65.0, 78.0),
    "column.T_bot_C": (110.0, 122.0),
    "column.Q_reb_kW": (None, 320.0),
    "batch.T_R_C": (20.0, 95.0),
    "batch.dHdt": (None, 250.0),
    "batch.conversion": (0.85, None),
}
# --- Fixed values: limits that a profile sets in place of the defaults ------------
PROFILE_LIMITS = {
    "cstr.T_R_C": (76.0, 82.0),
    "column.purity_B": (98.5, None),
    "column.Q_reb_kW": (None, 320.0),
}
# --- Fixed values: hard safety limits per manipulated variable -------------------
SAFETY_LIMITS = {
    "cstr.F_cool": (0.05, 0.80),
    "cstr.F_feed": (1.5, 3.0),
    "column.RR": (2.5, 8.0),
}
# --- Fixed values: soft-sensor inputs and target ---------------------------------
PURITY_FEATURES = [
    "column.T_bot_C", "column.T_top_C", "column.RR", "column.Q_reb_kW",
    "column.F_vap_kgh", "column.P_top_bar", "cstr.C_A",
]
PURITY_TARGET = "column.purity_B"
# --- Fixed values: forecast limits (tag, limit, direction, near, far, far_offset) -
FORECAST_LIMITS = [
    ("column.purity_B", 98.5, "below", "medium", "high", 1.0),
    ("cstr.T_R_C", 82.0, "above", "medium", "high", 2.0),
    ("column.Q_reb_kW", 320.0, "above", "low", "medium", 30.0),
]
# --- Fixed values: training and holdout scenarios --------------------------------
TRAIN_SCENARIOS = [
    "normal", "thermal_drift", "feed_perturbation", "reactor_instability",
    "quality_degradation", "energy_waste", "product_grade_change",
]
HOLDOUT_SCENARIOS = ["sensor_failure"]

DIM_TAG_DDL = (
    "profile STRING, tag STRING, units STRING, spec_min DOUBLE, spec_max DOUBLE, is_kpi BOOLEAN, "
    "measured BOOLEAN, low DOUBLE, high DOUBLE, min_range DOUBLE, max_range DOUBLE, writable BOOLEAN, "
    "safe_min DOUBLE, safe_max DOUBLE, baseline_scenario STRING"
)


def dim_tag(spark: SparkSession) -> DataFrame:
    """One row per declared tag of every profile (27 rows, fixed size)."""
    rows = []
    for profile, tags, baseline in (
        ("pilot", PILOT_TAGS, "normal"),
        ("batch_reactor", BATCH_TAGS, "batch_normal"),
    ):
        for tag, units, smin, smax, kpi, measured, lo, hi, writable in tags:
            low, high = PROFILE_LIMITS.get(tag) or OPERATIONAL_LIMITS.get(tag, (None, None))
            safe_min, safe_max = SAFETY_LIMITS.get(tag, (None, None))
            rows.append((profile, tag, units, smin, smax, kpi, measured, low, high,
                         lo, hi, writable, safe_min, safe_max, baseline))
    return spark.createDataFrame(rows, DIM_TAG_DDL)


def physical_name(tag: str) -> str:
    """Column name of a dotted tag in wide tables."""
    return tag.replace(".", "_")
