"""Decision cascade, execution records, outcome measurement and track records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.times import plus_minutes
from ..model import ACTION_DDL
from .asof import asof_nearest
from .scale import checked_broadcast

DEFAULT_DELAY = 30.0
TOLERANCE = 0.5


@dataclass(frozen=True)
class Autonomy:
    """What may be carried out without an operator."""

    urgencies: tuple[str, ...] = ("low",)
    action_types: tuple[str, ...] = ("adjust_setpoint",)
    targets: tuple[str, ...] = ("column.RR",)
    min_confidence: float = 0.85
    max_relative: float = 0.10


def is_automated(action: Column) -> Column:
    return ((action.getField("type") == "adjust_setpoint")
            & action.getField("target_variable").isNotNull()
            & action.getField("proposed_value").isNotNull())


def within_safety(recs: DataFrame, limits: DataFrame) -> DataFrame:
    """Add `safe`: the proposed value respects the hard limits of its target, if any."""
    lim = checked_broadcast(limits.select(F.col("tag").alias("_t"), "safe_min", "safe_max"))
    p = F.col("action.proposed_value")
    d = recs.join(lim, F.col("action.target_variable") == F.col("_t"), "left")
    bad = (p < F.col("safe_min")) | (p > F.col("safe_max"))
    return d.withColumn("safe", ~F.coalesce(bad, F.lit(False))).drop("_t", "safe_min", "safe_max")


def too_small(action: Column, minimum: float = 1e-3) -> Column:
    return F.coalesce(is_automated(action) & (F.abs(action.getField("adjustment")) < minimum), F.lit(False))


def qualifies(autonomy: Autonomy) -> Column:
    a = F.col("action")
    relative = F.when(F.abs(a.current_value) > 1e-9, F.abs(a.adjustment / a.current_value))
    return F.coalesce(
        F.col("urgency").isin(*autonomy.urgencies)
        & a.getField("type").isin(*autonomy.action_types)
        & a.getField("target_variable").isin(*autonomy.targets)
        & (F.col("confidence") >= autonomy.min_confidence)
        & (F.coalesce(relative, F.lit(0.0)) <= autonomy.max_relative), F.lit(False))


def dampened(action: Column, factor: float = 0.7) -> Column:
    """The same action with its adjustment scaled; untouched when not automatic."""
    adj = action.getField("adjustment") * factor
    smaller = F.struct(
        action.getField("type").alias("type"),
        F.concat(action.getField("description"), F.lit(" [reduced by operator]")).alias("description"),
        action.getField("target_variable").alias("target_variable"),
        action.getField("current_value").alias("current_value"),
        (F.coalesce(action.getField("current_value"), F.lit(0.0)) + adj).alias("proposed_value"),
        adj.alias("adjustment"), action.getField("units").alias("units"))
    usable = is_automated(action) & action.getField("adjustment").isNotNull()
    return F.when(usable, smaller.cast(ACTION_DDL)).otherwise(action)


def accept_critical() -> tuple[Column, Column, str]:
    """Accept only critical recommendations."""
    ok = F.col("urgency") == "critical"
    return (F.when(ok, "accepted").otherwise("rejected"), F.when(ok, F.col("action")), "operator_conservative")


def accept_all() -> tuple[Column, Column, str]:
    return F.lit("accepted"), F.col("action"), "operator_aggressive"


def accept_reduced(factor: float = 0.7) -> tuple[Column, Column, str]:
    """Accept with a smaller step."""
    return F.lit("modified"), dampened(F.col("action"), factor), "operator_cautious"


def decide(recs: DataFrame, limits: DataFrame, mode: str = "semi_autonomous", policy=None,
           autonomy: Autonomy = Autonomy(), minimum: float = 1e-3) -> DataFrame:
    """Safety gate, size filter, autonomy, policy, else pending: first match decides."""
    d = within_safety(recs, limits)
    auto = qualifies(autonomy) if mode == "autonomous_supervised" else F.lit(False)
    if policy is None:
        p_status, p_action, p_who = F.lit("pending"), F.lit(None).cast(ACTION_DDL), "none"
    else:
        p_status, p_action, p_who = policy
    small = too_small(F.col("action"), minimum)
    d = d.withColumn("_route", F.when(~F.col("safe"), "safety").when(small, "filter")
                     .when(auto, "auto").otherwise("policy"))
    r = F.col("_route")
    return d.select(
        stable_id("DEC", F.col("id"), F.lit(mode)).alias("id"), F.col("id").alias("recommendation_id"),
        "asset", "scenario", "rule_id", "urgency", "ts",
        F.when(r == "safety", "system_safety").when(r == "filter", "system_filter")
        .when(r == "auto", "system_autonomous").otherwise(p_who).alias("operator_id"),
        F.when(r.isin("safety", "filter"), "rejected").when(r == "auto", "auto_executed")
        .otherwise(p_status).alias("status"),
        F.when(r == "safety", "outside engineering limits").when(r == "filter", "action too small")
        .when(r == "auto", "within autonomy rules").otherwise("decided by policy").alias("justification"),
        F.when(r == "auto", F.col("action")).when(r == "policy", p_action).alias("actual_action"),
        F.lit(mode).alias("mode"))


def execute(decisions: DataFrame, mode: str = "semi_autonomous") -> DataFrame:
    """Execution records of decisions that act."""
    d = decisions.filter(F.col("status").isin("accepted", "modified", "auto_executed")
                         & F.col("actual_action").isNotNull())
    automatic = is_automated(F.col("actual_action"))
    by_hand = F.lit(mode == "advisor")
    return d.select(
        stable_id("EXE", F.col("id")).alias("id"), F.col("id").alias("decision_id"),
        "recommendation_id", "asset", "scenario", "ts",
        F.when(~automatic | by_hand, "not_required").otherwise("success").alias("status"),
        F.when(~automatic, F.col("operator_id")).when(by_hand, "operator_manual")
        .when(F.col("status") == "auto_executed", "system_autonomous")
        .otherwise("system_semi_auto").alias("executor"))


def impact_delay(minutes: Column, default: float = DEFAULT_DELAY) -> Column:
    """Missing and zero both mean the default."""
    return F.coalesce(F.when(minutes != 0, minutes), F.lit(default))


def longest_delay(impacts: Column, default: float = DEFAULT_DELAY) -> Column:
    return F.coalesce(F.array_max(F.transform(
        impacts, lambda i: impact_delay(i.getField("time_to_effect_minutes"), default))), F.lit(default))


def is_due(status: Column, impacts: Column, decided: Column, now: Column) -> Column:
    return (status.isin("accepted", "modified") & (F.size(impacts) > 0)
            & (now >= plus_minutes(decided, longest_delay(impacts))))


def deviation(predicted: Column, actual: Column) -> tuple[Column, Column]:
    gap = F.abs(actual - predicted)
    return gap, gap / F.greatest(F.abs(predicted), F.lit(1e-6))


def pending_measurements(overrides: DataFrame, recs: DataFrame, measured: DataFrame, now: Column) -> DataFrame:
    """Overrides not yet measured whose recommendation is known and due."""
    todo = overrides.join(measured.select("recommendation_id"), "recommendation_id", "left_anti")
    d = todo.join(recs.withColumnRenamed("id", "recommendation_id")
                  .select("recommendation_id", "asset", "scenario", "rule_id", "expected_impact"),
                  "recommendation_id")
    return d.filter(is_due(F.col("status"), F.col("expected_impact"), F.col("decision_ts"), now))


def override_executions(due: DataFrame) -> DataFrame:
    """Decision and execution ids for operator overrides, ready to measure."""
    dec = stable_id("DEC", F.col("recommendation_id"), F.lit("operator_ui"))
    return due.select(
        stable_id("EXE", dec).alias("id"), dec.alias("decision_id"), "recommendation_id", "asset",
        "scenario", F.col("decision_ts").alias("ts"), F.lit("success").alias("status"),
        F.lit("operator").alias("executor"))


def measure(executions: DataFrame, recs: DataFrame, readings: DataFrame, tolerance: float = TOLERANCE,
            seconds: int | None = None) -> DataFrame:
    """Predicted against actual at the measuring time of every impact."""
    ran = executions.filter(F.col("status").isin("success", "not_required"))
    imp = (ran.withColumnRenamed("id", "execution_id")
           .join(recs.select(F.col("id").alias("recommendation_id"), "expected_impact"), "recommendation_id")
           .withColumn("max_delay", longest_delay(F.col("expected_impact")))
           .select("execution_id", "decision_id", "recommendation_id", "asset", "scenario",
                   F.col("ts").alias("exec_ts"), "max_delay",
                   F.posexplode("expected_impact").alias("pos", "i")))
    imp = imp.withColumn("delay_min", impact_delay(F.col("i.time_to_effect_minutes")))
    last = readings.groupBy("asset", "scenario").agg(F.max("ts").alias("last_ts"))
    probes = (imp.withColumn("ts", plus_minutes(F.col("exec_ts"), F.col("delay_min")))
              .join(last, ["asset", "scenario"]).filter(F.col("ts") <= F.col("last_ts")).drop("last_ts")
              .withColumn("tag", F.col("i.variable")))
    used = readings.join(probes.select("asset", "scenario", "tag").distinct(),
                         ["asset", "scenario", "tag"], "left_semi")
    hit = asof_nearest(probes, used, out="actual", seconds=seconds)
    gap, pct = deviation(F.col("i.predicted_value"), F.col("actual"))
    metric = F.struct(
        F.col("tag").alias("variable"), F.col("i.predicted_value").alias("predicted"), "actual",
        "delay_min", gap.alias("dev_abs"), pct.alias("dev_pct"), (pct < tolerance).alias("within"))
    out = hit.groupBy("execution_id", "decision_id", "recommendation_id", "asset", "scenario",
                      "exec_ts", "max_delay").agg(
        F.array_sort(F.array_agg(F.struct("pos", metric.alias("m")))).alias("_m"))
    metrics = F.transform("_m", lambda x: x.getField("m"))
    scored = F.filter("metrics", lambda m: m.getField("within").isNotNull())
    good = F.filter("metrics", lambda m: F.coalesce(m.getField("within"), F.lit(False)))
    quality = F.when(F.size(scored) > 0, F.size(good) / F.size(scored)).otherwise(0.5)
    return (out.withColumn("metrics", metrics)
            .select(stable_id("OUT", F.col("execution_id")).alias("id"), "execution_id", "decision_id",
                    "recommendation_id", "asset", "scenario",
                    plus_minutes(F.col("exec_ts"), F.col("max_delay")).alias("ts"),
                    F.col("max_delay").alias("measurement_delay_minutes"),
                    quality.alias("quality_score"), "metrics",
                    F.format_string("%d/%d metrics within tolerance", F.size(good), F.size("metrics")).alias("notes")))


def outcome_summary(outcomes: DataFrame, recs: DataFrame) -> DataFrame:
    return outcomes.join(
        recs.select(F.col("id").alias("recommendation_id"), "rule_id", "urgency"), "recommendation_id"
    ).select(F.col("id").alias("outcome_id"), "recommendation_id", "rule_id", "urgency",
             F.col("ts").alias("measured_at"), "measurement_delay_minutes", "quality_score", "notes",
             "metrics")


def track_record(recs: DataFrame, decisions: DataFrame, outcomes: DataFrame,
                 by: tuple[str, ...] = ("rule_id",)) -> DataFrame:
    """Counts per rule; every input is reduced before the join."""
    key = list(by)
    total = recs.groupBy(*key).agg(F.count(F.lit(1)).alias("total_recs"))
    s = F.col("status")
    dec = decisions.groupBy(*key).agg(
        *[F.count_if(s == w).alias(n) for w, n in (
            ("accepted", "accepted"), ("modified", "modified"), ("rejected", "rejected"),
            ("auto_executed", "auto_executed"))])
    q = F.col("quality_score")
    out = outcomes.groupBy(*key).agg(
        F.count(F.lit(1)).alias("outcomes_measured"),
        F.count_if(q >= 0.5).alias("successes"), F.count_if(q < 0.5).alias("failures"))
    d = total.join(dec, key, "left").join(out, key, "left").fillna(0)
    return with_rates(d)


def with_rates(d: DataFrame) -> DataFrame:
    """Acceptance, success and the confidence multiplier from the counts."""
    acc = F.when(F.col("total_recs") > 0, (F.col("accepted") + F.col("modified")) / F.col("total_recs")).otherwise(0.0)
    suc = F.when(F.col("outcomes_measured") > 0, F.col("successes") / F.col("outcomes_measured")).otherwise(0.0)
    s = F.when(F.col("outcomes_measured") > 0, suc).otherwise(0.5)
    thin_data = (F.col("outcomes_measured") < 5) & (F.col("total_recs") < 10)
    return (d.withColumn("acceptance_rate", acc).withColumn("success_rate", suc)
            .withColumn("confidence_adj", F.when(thin_data, 1.0).otherwise(0.5 + 0.5 * acc + 0.5 * s)))


def adjust_confidence(recs: DataFrame, record: DataFrame) -> DataFrame:
    """Recommendations with their rule's multiplier applied in a separate column."""
    return recs.join(record.select("rule_id", "confidence_adj"), "rule_id", "left").withColumn(
        "adjusted_confidence", F.col("confidence") * F.coalesce("confidence_adj", F.lit(1.0)))
