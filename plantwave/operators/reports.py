"""Report aggregates; every one is a single pass with map-side combining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import hours_between, minutes_between
from .scale import checked_broadcast


def kpi_summary(readings: DataFrame, dim: DataFrame, keys: Sequence[str] = ("asset", "scenario")) -> DataFrame:
    """Mean, range, deviation and spec violation per KPI tag (`dim`: tag, spec_min, spec_max, is_kpi)."""
    d = readings.filter(F.col("value").isNotNull()).groupBy(*keys, "tag").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.stddev_samp("value").alias("std"))
    specs = checked_broadcast(dim.filter("is_kpi").select("tag", "spec_min", "spec_max"))
    low = F.coalesce(F.col("min") < F.col("spec_min"), F.lit(False))
    high = F.coalesce(F.col("max") > F.col("spec_max"), F.lit(False))
    return d.join(specs, "tag").withColumn("spec_violated", low | high)


def run_summary(df: DataFrame, keys: Sequence[str], value: Column, spec_min: float, ts: str = "ts") -> DataFrame:
    """Duration in hours, sample count and percentage of non-null values below spec."""
    return df.groupBy(*keys).agg(
        hours_between(F.max(ts), F.min(ts)).alias("duration_h"),
        F.count(F.lit(1)).alias("n_samples"),
        F.coalesce(100.0 * F.count_if(value < spec_min) / F.nullif(F.count(value), F.lit(0)),
                   F.lit(0.0)).alias("below_spec_pct"))


def recommendations_summary(recs: DataFrame) -> DataFrame:
    """Counts by urgency, by rule and in total, from one grouping-sets pass."""
    decided = F.count_if(F.col("status") != "pending")
    accepted, rejected = F.count_if(F.col("status") == "accepted"), F.count_if(F.col("status") == "rejected")
    d = recs.groupingSets([["urgency"], ["rule_id"], []], "urgency", "rule_id").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("total"), decided.alias("n_decided"),
        accepted.alias("n_accepted"), rejected.alias("n_rejected"))
    return d.select(
        F.when(F.col("_g") == 1, "urgency").when(F.col("_g") == 2, "rule").otherwise("all").alias("facet"),
        F.coalesce("urgency", F.col("rule_id").cast("string"), F.lit("")).alias("item"),
        "total", "n_decided", "n_accepted", "n_rejected",
        (F.col("n_accepted") / F.nullif(F.col("n_decided"), F.lit(0))).alias("acceptance_rate"))


def decisions_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def decision_log(decisions: DataFrame, tie: Sequence[str] = ("id",)) -> DataFrame:
    return decisions.orderBy(F.desc("ts"), *tie)


def sessions_summary(sessions: DataFrame) -> DataFrame:
    d = sessions.groupingSets([["peak_severity"], ["detector"], []], "peak_severity", "detector").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"))
    return d.select(
        F.when(F.col("_g") == 1, "severity").when(F.col("_g") == 2, "detector").otherwise("all").alias("facet"),
        F.coalesce("peak_severity", "detector", F.lit("")).alias("item"), "n")


def decision_counts(recs: DataFrame, decisions: DataFrame, executions: DataFrame, outcomes: DataFrame,
                    keys: Sequence[str]) -> DataFrame:
    """Counts of the whole decision trail per key; each table is reduced first."""
    k = list(keys)
    s = F.col("status")
    d = decisions.groupBy(*k).agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(s == "accepted").alias("accepted"),
        F.count_if(s == "modified").alias("modified"), F.count_if(s == "rejected").alias("rejected"),
        F.count_if(s == "auto_executed").alias("auto_executed"))
    out = recs.groupBy(*k).agg(F.count(F.lit(1)).alias("recommendations")).join(d, k, "full")
    for name, df in (("executions", executions), ("outcomes", outcomes)):
        out = out.join(df.groupBy(*k).agg(F.count(F.lit(1)).alias(name)), k, "full")
    return out.fillna(0)


def consensus_summary(counts: DataFrame, outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decision counts with mean quality; this acceptance includes automatic execution."""
    q = outcomes.groupBy(*keys).agg(F.avg("quality_score").alias("mean_quality"))
    rate = (F.col("accepted") + F.col("modified") + F.col("auto_executed")) / F.greatest(
        F.col("recommendations"), F.lit(1))
    return counts.join(q, list(keys), "left").withColumn("acceptance_incl_auto", rate)


def record_rollup(records: DataFrame, key: str = "rule_id") -> DataFrame:
    """Track records summed over scenarios; success is null when nothing was measured."""
    cols = ["total_recs", "accepted", "modified", "rejected", "outcomes_measured", "successes", "failures"]
    d = records.groupBy(key).agg(*[F.sum(c).alias(c) for c in cols])
    return (d.withColumn("acceptance_rate", (F.col("accepted") + F.col("modified")) / F.col("total_recs"))
            .withColumn("success_rate", F.col("successes") / F.nullif(F.col("outcomes_measured"), F.lit(0))))


def regression_metrics(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE, R² (0 without variance), bias and worst error."""
    r = F.col(actual) - F.col(predicted)
    tot = F.var_pop(actual) * F.count(actual)
    return df.filter(r.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"),
        F.when(tot > 0, 1.0 - F.sum(r * r) / tot).otherwise(0.0).alias("r2"),
        F.avg(r).alias("bias"), F.max(F.abs(r)).alias("max_error"))


def detector_counts(events: DataFrame, keys: Sequence[str], detectors: Sequence[str]) -> DataFrame:
    """One column per declared detector."""
    return events.groupBy(*keys).pivot("detector", list(detectors)).agg(F.count(F.lit(1))).fillna(0)


def time_to_first(sessions: DataFrame, known_events: DataFrame, on: Sequence[str],
                  by: Sequence[str] = ("detector",)) -> DataFrame:
    """Minutes from a known event to the first later session, per detector."""
    d = sessions.join(known_events, list(on)).filter(F.col("start_ts") >= F.col("event_ts"))
    return d.groupBy(*on, *by).agg(
        minutes_between(F.min("start_ts"), F.first("event_ts")).alias("minutes"))


def time_to_first_recommendation(recs: DataFrame, expected: DataFrame, on: Sequence[str]) -> DataFrame:
    """Per expected rule the (possibly negative) minutes from the event to its first firing.

    `expected`: keys, event_ts, expected_rules array.
    """
    first = recs.groupBy(*on, "rule_id").agg(F.min("ts").alias("first_ts"))
    want = expected.select(*on, "event_ts", F.explode("expected_rules").alias("rule_id"))
    return want.join(first, [*on, "rule_id"], "left").select(
        *on, "rule_id", minutes_between(F.col("first_ts"), F.col("event_ts")).alias("minutes"))


def detected_rules(recs: DataFrame, on: Sequence[str]) -> DataFrame:
    return recs.groupBy(*on).agg(F.array_join(F.sort_array(F.collect_set("rule_id")), ", ").alias("rules"))


def actionable(recs: DataFrame, starts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Hours to the first recommendation above low urgency, and counts."""
    d = recs.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n_recs"), F.min(F.when(F.col("urgency") != "low", F.col("ts"))).alias("_f"))
    return d.join(starts, list(on)).select(
        *on, "n_recs", hours_between(F.col("_f"), F.col("t_start")).alias("ttfr_h"))


def tag_ranges(readings: DataFrame, keys: Sequence[str], tags: Sequence[str] | None = None) -> DataFrame:
    d = readings if tags is None else readings.filter(F.col("tag").isin(list(tags)))
    return d.groupBy(*keys, "tag").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def buffer_summary(readings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Samples, tags, oldest and newest of what is held."""
    return readings.groupBy(*keys).agg(
        F.countDistinct("ts").alias("n_samples"), F.countDistinct("tag").alias("n_tags"),
        F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def counters(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
