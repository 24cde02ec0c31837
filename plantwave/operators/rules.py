"""Diagnostic rules as Column specifications over one session-context table.

A rule is a predicate, the values it cannot do without, and projections.  All rules
of a pack are evaluated in one pass over the context; a firing that lacks a needed
value is no firing and does not use up its repeat slot.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.ladders import priority_score, urgency_from_severity
from ..model import ACTION_DDL, IMPACT_DDL, physical_name
from ..session import ensure_checkpoint_dir
from .asof import asof_backward, trailing_moments
from .overlap import co_occurrence_counts
from .recurrences import thin

SPC = ("SPC.EWMA", "SPC.Shewhart")
# Streams whose company matters to a rule, as (flag, detectors, tag).
COMPANY = [
    ("co_C_A", SPC, "cstr.C_A"),
    ("co_purity", SPC, "column.purity_B"),
    ("co_T_R", SPC, "cstr.T_R_C"),
    ("co_F_cool_cusum", ("Regime.CUSUM",), "cstr.F_cool"),
    ("co_batch_T_R", ("SPC.Shewhart", "Trend.Projection"), "batch.T_R_C"),
]
# Tags whose value at the session start a rule may read.
CONTEXT_TAGS = [
    "cstr.F_cool", "cstr.T_R_C", "cstr.C_A", "column.purity_B", "column.RR", "column.Q_reb_kW",
    "batch.F_cool", "batch.T_R_C", "batch.conversion",
]
# Tags that may stay constant without being faulty.
NON_SENSED = [
    "cstr.F_feed", "cstr.F_cool", "cstr.T_feed_C", "cstr.T_cool_in_C",
    "column.RR", "column.F_vap_kgh", "column.P_top_bar", "column.P_bot_bar",
]


def val(tag: str) -> Column:
    return F.col("v_" + physical_name(tag))


def session_context(sessions: DataFrame, readings: DataFrame, window_minutes: float = 90.0,
                    causal: bool = False, seconds: int | None = None,
                    spec_min: float = 98.5) -> DataFrame:
    """Sessions with company counts and as-of values, one row per session."""
    spark = sessions.sparkSession
    streams = spark.createDataFrame(
        [(d, tag) for _, ds, tag in COMPANY for d in ds], "o_detector string, o_tag_key string")
    needed = list(dict.fromkeys(CONTEXT_TAGS))
    company = co_occurrence_counts(sessions, window_minutes, streams, causal=causal, seconds=seconds)
    flags = company.groupBy("session_id").agg(*[
        F.sum(F.when(F.col("o_detector").isin(*ds) & (F.col("o_tag") == tag), F.col("n"))
              .otherwise(0)).alias(name) for name, ds, tag in COMPANY])

    tag = F.col("tag")
    probes = sessions.select(
        "asset", "scenario", "session_id", F.col("start_ts").alias("ts"), tag.alias("_own"),
        F.explode(F.array_distinct(F.array_compact(F.array(*[F.lit(t) for t in needed], tag)))).alias("tag"))
    # readings of runs without sessions, or of tags no probe asks for, never join in
    wanted = probes.select("asset", "scenario", "tag").distinct()
    used = readings.join(wanted, ["asset", "scenario", "tag"], "left_semi")
    looked = asof_backward(probes, used, out="v", seconds=seconds, at="at")
    # a row per session, cut: what follows reads it twice, and the look-up over the readings runs once
    ensure_checkpoint_dir(spark)
    wide = (looked.groupBy("asset", "scenario", "session_id")
            .agg(F.max(F.when(tag == F.col("_own"), F.struct("tag", "at", "v"))).alias("_own"),
                 *[F.max(F.when(tag == t, F.col("v"))).alias("v_" + physical_name(t)) for t in needed])
            .withColumn("v_own", F.col("_own.v")).checkpoint())
    anchors = wide.filter(F.col("_own.at").isNotNull()).select(
        "session_id", "asset", "scenario", F.col("_own.tag").alias("tag"), F.col("_own.at").alias("ts"))
    still = still_signal(anchors, used, seconds=seconds)
    ctx = (sessions.join(flags, "session_id", "left")
           .join(wide.drop("asset", "scenario", "_own"), "session_id", "left")
           .join(still.select("session_id", "still"), "session_id", "left"))
    if causal:
        ctx = ctx.withColumn("peak_alert", F.col("first_alert")) \
                 .withColumn("peak_severity", F.col("first_alert.severity")) \
                 .withColumn("alert_count", F.lit(1).cast("long"))
    return (ctx.fillna(0, [name for name, _, _ in COMPANY])
            .withColumn("purity_spec", F.lit(float(spec_min))))


def still_signal(anchors: DataFrame, readings: DataFrame, minutes: float = 15.0, min_rows: int = 5,
                 min_std: float = 1e-4, seconds: int | None = None) -> DataFrame:
    """`still` = 1.0 when the last `minutes` before an anchor reading hardly vary.

    Only readings in the time buckets next to an anchor are looked at.
    """
    width = int(minutes * 60e6)
    key = ["asset", "scenario", "tag"]
    bucket = F.floor(F.unix_micros("ts") / width)
    near = anchors.select(*key, F.explode(F.array(bucket - 1, bucket)).alias("_near")).distinct()
    local = (readings.filter(F.col("value").isNotNull()).withColumn("_near", bucket)
             .join(near, [*key, "_near"], "left_semi").drop("_near"))
    rolled = trailing_moments(local, minutes, "_cnt", "_mean", "_sd")
    flat = (F.col("_cnt") >= min_rows) & (F.col("_sd") < min_std)
    at = rolled.groupBy(*key, "ts").agg(F.max(F.when(flat, 1.0).otherwise(0.0)).alias("still"))
    return anchors.join(at, [*key, "ts"]).select("session_id", "still")


def action(kind: str, text: str, target: Column | str | None = None, current: Column | None = None,
           proposed: Column | None = None, adjustment: Column | float | None = None,
           units: str | None = None) -> Column:
    def d(c):
        return (c if isinstance(c, Column) else F.lit(c)).cast("double")
    t = target if isinstance(target, Column) else F.lit(target)
    return F.struct(
        F.lit(kind).alias("type"), F.lit(text).alias("description"),
        t.cast("string").alias("target_variable"), d(current).alias("current_value"),
        d(proposed).alias("proposed_value"), d(adjustment).alias("adjustment"),
        F.lit(units).cast("string").alias("units"))


def move(text: str, target: str, current: Column, proposed: Column, units: str) -> Column:
    return action("adjust_setpoint", text, target, current, proposed, proposed - current, units)


def impact(variable: Column | str, current: Column, predicted: Column | float | None,
           minutes: float | None, text: str = "") -> Column:
    v = variable if isinstance(variable, Column) else F.lit(variable)
    p = predicted if isinstance(predicted, Column) else F.lit(predicted)
    return F.struct(
        v.alias("variable"), current.cast("double").alias("current_value"),
        p.cast("double").alias("predicted_value"),
        F.lit(minutes).cast("double").alias("time_to_effect_minutes"), F.lit(text).alias("description"))


@dataclass
class Rule:
    """One declarative rule; every field is a Column builder evaluated on the context."""

    name: str
    when: Callable[[], Column]
    needs: Callable[[], list[Column]]
    urgency: Callable[[], Column]
    confidence: Callable[[], Column]
    act: Callable[[], Column]
    diagnosis: Callable[[], Column]
    cause: str
    impacts: Callable[[], list[Column]] = field(default=lambda: [])
    affected: Callable[[], list[Column]] = field(default=lambda: [])

    def fired(self) -> Column:
        ok = self.when()
        for c in self.needs():
            ok = ok & c.isNotNull()
        urgency, confidence = self.urgency(), self.confidence().cast("double")
        empty = F.array().cast(f"array<{IMPACT_DDL}>")
        impacts = self.impacts()
        return F.when(ok, F.struct(
            F.lit(self.name).alias("rule_id"), urgency.alias("urgency"),
            priority_score(urgency, confidence).alias("priority"), confidence.alias("confidence"),
            self.diagnosis().alias("diagnosis"), F.lit(self.cause).alias("probable_cause"),
            self.act().cast(ACTION_DDL).alias("action"),
            (F.array(*impacts).cast(f"array<{IMPACT_DDL}>") if impacts else empty).alias("expected_impact"),
            (F.array(*[a.cast("string") for a in self.affected()]) if self.affected()
             else F.array().cast("array<string>")).alias("affected_variables")))


def names(*tags: str) -> Callable[[], list[Column]]:
    return lambda: [F.lit(t) for t in tags]


def _on(detectors, tag) -> Column:
    return F.col("detector").isin(*detectors) & (F.col("tag") == tag)


def _peak() -> Column:
    return F.col("peak_alert.value")


def _extra(name: str) -> Column:
    return F.col("peak_alert.extra").getField(name)


def _not_below() -> Column:
    return F.coalesce(F.col("peak_alert.side"), F.lit("")) != "below"


def _fmt(text: str, *cols: Column) -> Column:
    return F.format_string(text, *cols)


PURITY, RR, C_A = "column.purity_B", "column.RR", "cstr.C_A"
T_R, F_COOL, Q_REB = "cstr.T_R_C", "cstr.F_cool", "column.Q_reb_kW"
B_T_R, B_F_COOL, B_CONV = "batch.T_R_C", "batch.F_cool", "batch.conversion"


def _spec_urgency(otherwise: str) -> Column:
    return (F.when(val(PURITY) < F.col("purity_spec") - 1, "high")
            .when(val(PURITY) < F.col("purity_spec"), "medium").otherwise(otherwise))


def _below_spec() -> Column:
    return val(PURITY) < F.col("purity_spec")


def _r02_action() -> Column:
    raise_reflux = move("Raise reflux while the upstream cause is looked for", RR, val(RR),
                        F.least(val(RR) + 0.3, F.lit(7.0)), "dimensionless")
    look = action("investigate", "Check feed tank analysis and upstream units")
    return F.when(_below_spec(), raise_reflux.cast(ACTION_DDL)).otherwise(look.cast(ACTION_DDL))


def _r10_action() -> Column:
    purity_low = (F.col("tag") == PURITY) & (_extra("direction") == "below")
    hot = (F.col("tag") == T_R) & (_extra("direction") == "above")
    duty = (F.col("tag") == Q_REB) & (_extra("direction") == "above")
    return (F.when(purity_low, action("adjust_setpoint", "Raise reflux before purity leaves its limit",
                                      RR, adjustment=0.3).cast(ACTION_DDL))
            .when(hot, action("adjust_setpoint", "Raise coolant flow before the reactor overheats",
                              F_COOL, adjustment=0.05).cast(ACTION_DDL))
            .when(duty, action("adjust_setpoint", "Lower reflux to reduce reboiler duty",
                               RR, adjustment=-0.2).cast(ACTION_DDL))
            .otherwise(action("investigate", "Review the predicted excursion", F.col("tag")).cast(ACTION_DDL)))


def _r10_target() -> Column:
    return (F.when(F.col("tag") == T_R, F_COOL)
            .when(F.col("tag").isin(PURITY, Q_REB), RR).otherwise(F.col("tag")))


def _b01_t() -> Column:
    return F.coalesce(F.when(val(B_T_R) != 0, val(B_T_R)), _peak())


def _b03_x() -> Column:
    return F.coalesce(F.when(val(B_CONV) != 0, val(B_CONV)), _peak())


PILOT_RULES = [
    Rule("R01_ThermalDrift",
         lambda: _on(SPC, T_R) & (_peak() >= 79.8) & _not_below(),
         lambda: [_peak(), val(F_COOL)],
         lambda: F.when(_peak() > 82, "high").when(_peak() > 80.5, "medium").otherwise("low"),
         lambda: F.when(F.col("alert_count") > 20, 0.85).otherwise(0.70),
         lambda: move("Raise coolant flow by about 15 % and plan an exchanger cleaning", F_COOL,
                      val(F_COOL), F.least(val(F_COOL) * 1.15, F.lit(0.60)), "m³/h"),
         lambda: _fmt("Reactor temperature drifts up to %.2f °C at normal coolant flow", _peak()),
         "Heat transfer of the jacket is degrading",
         lambda: [impact(T_R, _peak(), F.greatest(F.lit(79.2), _peak() - 0.5), 20),
                  impact(F_COOL, val(F_COOL), F.least(val(F_COOL) * 1.15, F.lit(0.60)), 1)],
         names(T_R, "cstr.T_J_C", F_COOL)),
    Rule("R02_FeedComposition",
         lambda: (F.col("detector") == "PCA.T2") & (F.col("co_C_A") > 0) & (F.col("co_purity") > 0)
         & (val(PURITY) < 99.0),
         lambda: [val(C_A), val(PURITY), val(RR)],
         lambda: F.when(val(PURITY) < F.col("purity_spec") - 1, "high").otherwise("medium"),
         lambda: F.lit(0.80), _r02_action,
         lambda: _fmt("Reactor composition (%.0f mol/m³) and purity (%.2f %%) shift together",
                      val(C_A), val(PURITY)),
         "The composition of the fresh feed has changed",
         lambda: [F.when(_below_spec(), impact(PURITY, val(PURITY),
                                               F.least(F.lit(99.2), val(PURITY) + 0.8), 30)),
                  F.when(_below_spec(), impact(Q_REB, val(Q_REB), None, None))],
         names(C_A, PURITY, RR)),
    Rule("R03_ControllerOscillation",
         lambda: _on(["Regime.CUSUM"], F_COOL) & (F.col("co_F_cool_cusum") >= 3),
         lambda: [val(F_COOL), val(T_R)],
         lambda: F.lit("medium"), lambda: F.lit(0.80),
         lambda: action("investigate", "Put the loop in manual and watch for oscillation or valve stiction"),
         lambda: _fmt("Coolant flow oscillates (%d shifts nearby) at %.2f °C",
                      F.col("co_F_cool_cusum") + 1, val(T_R)),
         "Controller gain too high or a sticking coolant valve",
         lambda: [impact(F_COOL, val(F_COOL), None, 45), impact(T_R, val(T_R), 79.2, 45)],
         names(F_COOL, T_R)),
    Rule("R04_ColumnEfficiencyLoss",
         lambda: _on(SPC, PURITY) & (F.col("co_T_R") == 0) & (F.col("co_C_A") == 0),
         lambda: [val(PURITY), val(RR)],
         lambda: _spec_urgency("low"), lambda: F.lit(0.75),
         lambda: move("Raise reflux and check the column pressure profile", RR, val(RR),
                      F.least(val(RR) + 0.4, F.lit(7.0)), "dimensionless"),
         lambda: _fmt("Purity %.2f %% falls while the reactor is steady", val(PURITY)),
         "Separation efficiency inside the column is lower",
         lambda: [impact(PURITY, val(PURITY), F.least(F.lit(99.0), val(PURITY) + 1.0), 45)],
         names(PURITY, RR)),
    Rule("R05_ExcessReflux",
         lambda: _on(["SPC.EWMA"], Q_REB) & _not_below() & (_peak() > 290) & (val(PURITY) > 99.3),
         lambda: [val(RR), val(PURITY)],
         lambda: F.lit("low"), lambda: F.lit(0.90),
         lambda: move("Lower reflux in small steps while purity holds", RR, val(RR),
                      F.greatest(val(RR) - 0.3, F.lit(4.0)), "dimensionless"),
         lambda: _fmt("Purity %.2f %% leaves room at a duty of %.0f kW", val(PURITY), _peak()),
         "Reflux is set higher than the product needs",
         lambda: [impact(Q_REB, _peak(), _peak() * 0.92, 30),
                  impact(PURITY, val(PURITY), F.greatest(F.lit(98.8), val(PURITY) - 0.3), 30)],
         names(RR, Q_REB, PURITY)),
    Rule("R06_PurityDeviation",
         lambda: _on(["Trend.Projection"], PURITY),
         lambda: [val(PURITY), val(RR)],
         lambda: F.when(F.coalesce(_extra("minutes_to_limit"), F.lit(60.0)) < 15, "critical")
         .when(F.coalesce(_extra("minutes_to_limit"), F.lit(60.0)) < 30, "high").otherwise("medium"),
         lambda: F.least(F.lit(0.95), F.col("peak_alert.confidence") + 0.1),
         lambda: move("Raise reflux before purity crosses its limit", RR, val(RR),
                      F.least(val(RR) + 0.25, F.lit(7.0)), "dimensionless"),
         lambda: _fmt("Purity %.2f %% reaches its limit in about %.0f min", val(PURITY),
                      F.coalesce(_extra("minutes_to_limit"), F.lit(60.0))),
         "A continuing drift from an upstream disturbance",
         lambda: [impact(PURITY, val(PURITY), F.least(F.lit(99.0), val(PURITY) + 0.4), 25)],
         names(PURITY, RR)),
    Rule("R07_SensorFault",
         lambda: F.col("tag").isNotNull() & ~F.col("tag").isin(*NON_SENSED)
         & ((F.col("detector") == "FrozenSensor") | (F.coalesce(F.col("still"), F.lit(0.0)) == 1.0)),
         lambda: [F.col("v_own")],
         lambda: F.lit("high"), lambda: F.lit(0.95),
         lambda: action("verify_instrument", "Have the instrument checked and use redundant readings"),
         lambda: _fmt("%s stays at %.3f", F.col("tag"), F.col("v_own")),
         "The transmitter or its connection has failed",
         lambda: [impact(F.col("tag"), F.col("v_own"), None, None)],
         lambda: [F.col("tag")]),
    Rule("R08_ProductTransition",
         lambda: _on(["Regime.CUSUM"], RR),
         lambda: [val(RR), val(PURITY)],
         lambda: F.lit("low"), lambda: F.lit(0.85),
         lambda: action("wait_and_monitor", "Watch purity until the new grade has settled"),
         lambda: _fmt("Reflux moved %s to %.2f", F.coalesce(_extra("direction"), F.lit("unknown")), val(RR)),
         "An intended change of product grade",
         lambda: [impact(PURITY, val(PURITY), None, 30)],
         names(RR, PURITY)),
    Rule("R09_SoftSensorDivergence",
         lambda: F.col("detector") == "SoftSensor.Divergence",
         lambda: [_extra("actual"), _extra("predicted")],
         lambda: F.when(F.abs(_extra("residual")) > 1.0, "medium").otherwise("low"),
         lambda: F.lit(0.70),
         lambda: action("verify_instrument", "Re-sample the measurement and check the model inputs"),
         lambda: _fmt("%s reads %.2f where the model expects %.2f", F.col("tag"), _extra("actual"),
                      _extra("predicted")),
         "The instrument has drifted or the model extrapolates",
         lambda: [impact(F.col("tag"), _extra("actual"), None, None)],
         lambda: [F.col("tag")]),
    Rule("R10_PredictedExcursion",
         lambda: F.col("detector") == "LSTM.Forecast",
         lambda: [_extra("predicted"), _extra("actual")],
         lambda: F.when(_extra("horizon_minutes") <= 10, "high")
         .when(_extra("horizon_minutes") <= 30, "medium").otherwise("low"),
         lambda: F.lit(0.75), _r10_action,
         lambda: _fmt("%s is forecast to go %s its limit in about %.0f min", F.col("tag"),
                      _extra("direction"), _extra("horizon_minutes")),
         "The recent trajectory leads to the limit",
         lambda: [impact(F.col("tag"), _extra("actual"), F.col("peak_alert.lim"), None)],
         lambda: [F.col("tag"), _r10_target()]),
]

BATCH_RULES = [
    Rule("B01_HighReactorTemp",
         lambda: (F.col("tag") == B_T_R) & F.col("peak_severity").isin("high", "critical"),
         lambda: [_b01_t(), val(B_F_COOL)],
         lambda: urgency_from_severity(F.col("peak_severity")), lambda: F.lit(0.85),
         lambda: move("Raise coolant flow by about 30 %", B_F_COOL, val(B_F_COOL),
                      F.least(val(B_F_COOL) * 1.30, F.lit(1.0)), "m³/h"),
         lambda: _fmt("Reactor at %.1f °C is above its safe range", _b01_t()),
         "Cooling does not keep up with the reaction",
         lambda: [impact(B_T_R, _b01_t(), F.greatest(F.lit(85.0), _b01_t() - 4.0), 10),
                  impact(B_F_COOL, val(B_F_COOL), F.least(val(B_F_COOL) * 1.30, F.lit(1.0)), 1)],
         names(B_T_R, B_F_COOL)),
    Rule("B02_RunawayRisk",
         lambda: (F.col("tag") == "batch.dHdt") & F.col("peak_severity").isin("high", "critical")
         & (F.col("co_batch_T_R") > 0),
         lambda: [_peak(), val(B_F_COOL), val(B_T_R)],
         lambda: F.lit("critical"), lambda: F.lit(0.90),
         lambda: move("Open the coolant valve fully and prepare to quench", B_F_COOL, val(B_F_COOL),
                      F.lit(1.0), "m³/h"),
         lambda: _fmt("Heat release of %.0f kW at %.1f °C and rising", _peak(), val(B_T_R)),
         "Reaction rate and temperature drive each other",
         lambda: [impact(B_T_R, val(B_T_R), F.greatest(F.lit(80.0), val(B_T_R) - 8.0), 8)],
         names(B_T_R, "batch.dHdt", B_F_COOL)),
    Rule("B03_LowConversion",
         lambda: (F.col("tag") == B_CONV) & F.col("peak_severity").isin("medium", "high", "critical"),
         lambda: [_b03_x()],
         lambda: F.lit("medium"), lambda: F.lit(0.70),
         lambda: action("investigate", "Sample the batch and consider a longer reaction time",
                        current=_b03_x(), units=""),
         lambda: _fmt("Conversion %.2f is below target", _b03_x()),
         "Catalyst, feed, temperature or reaction time",
         affected=names(B_CONV)),
]


def recommend(context: DataFrame, rules: list[Rule], repeat_minutes: float = 60.0,
              seconds: int | None = None) -> DataFrame:
    """Evaluate a rule pack and keep a firing only when its rule and tag have rested."""
    fired = context.select(
        "asset", "scenario", "session_id", F.col("start_ts").alias("ts"),
        F.coalesce("tag", F.lit("multi")).alias("tag_key"),
        F.explode(F.array_compact(F.array(*[r.fired() for r in rules]))).alias("r"))
    schema = fired.schema["r"].dataType
    # the nested payload crosses the Python stage as text
    slim = fired.select("asset", "scenario", "session_id", "ts", "tag_key",
                        F.col("r.rule_id").alias("rule_id"), F.to_json("r").alias("body"))
    kept = thin(slim, ["asset", "scenario", "rule_id", "tag_key"], repeat_minutes * 60, strict=False,
                tie=["session_id"], seconds=seconds)
    out = kept.withColumn("r", F.from_json("body", schema))
    return out.select(
        stable_id("REC", F.col("asset"), F.col("scenario"), F.col("r.rule_id"), F.col("session_id")).alias("id"),
        "asset", "scenario", "ts", F.col("r.rule_id").alias("rule_id"), "r.urgency", "r.priority",
        "r.confidence", "r.diagnosis", "r.probable_cause", F.lit("pending").alias("status"),
        "r.action", F.array_compact("r.expected_impact").alias("expected_impact"),
        "r.affected_variables", F.array("session_id").alias("triggering_sessions"))


def in_report_order(recs: DataFrame) -> DataFrame:
    return recs.orderBy("ts", F.desc("priority"), "id")
