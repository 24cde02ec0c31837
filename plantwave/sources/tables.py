"""State tables kept by upsert, append and fixed-column projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import minutes_between


def upsert_latest(stored: DataFrame, incoming: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Catalogue upsert: per key the row with the newest version, incoming first on a tie."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(version), F.col("_new")))
    return both.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")


def upsert_status(stored: DataFrame, incoming: DataFrame, key: str = "id", status: str = "status") -> DataFrame:
    """New ids are inserted, of known ids only the status changes."""
    rest = [c for c in stored.columns if c not in (key, status)]
    old = stored.select(key, F.struct(*rest).alias("_o"), F.col(status).alias("_os"), F.lit(True).alias("_have"))
    new = incoming.select(key, F.struct(*rest).alias("_n"), F.col(status).alias("_ns"))
    d = old.join(new, key, "full")
    row = F.when(F.col("_have"), F.col("_o")).otherwise(F.col("_n"))
    return d.withColumn("_r", row).withColumn(status, F.coalesce("_ns", "_os")).select(
        key, status, "_r.*").select(*stored.columns)


def set_status(stored: DataFrame, updates: DataFrame, key: str = "id", status: str = "status") -> DataFrame:
    u = updates.select(key, F.col(status).alias("_s"))
    return (stored.join(u, key, "left").withColumn(status, F.coalesce("_s", status))
            .select(*stored.columns))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest_metrics(metrics: DataFrame, keys: Sequence[str] = ("model",), version: str = "run_ts") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return metrics.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1).drop("_rk")


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def alerts_table(alerts: DataFrame) -> DataFrame:
    return alerts.select("asset", "scenario", "ts", "detector", "alert_type", "severity", "tag", "value",
                         "lim", "confidence", "message").orderBy("ts", "detector", "tag")


def sessions_table(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "detector", "tag", "start_ts", "end_ts", F.round("duration_min", 2).alias("duration_min"),
        "alert_count", "peak_severity", F.col("peak_alert.message").alias("message"),
        F.col("peak_alert.value").alias("peak_value")).orderBy("start_ts", "detector", "tag")


def recommendations_table(recs: DataFrame) -> DataFrame:
    return recs.select(
        "id", "ts", "urgency", "priority", "confidence", "diagnosis", "probable_cause",
        F.col("action.type").alias("action_type"), F.col("action.description").alias("action_description"),
        F.col("action.target_variable").alias("target_variable"),
        F.col("action.current_value").alias("current_value"),
        F.col("action.proposed_value").alias("proposed_value"), "rule_id", "status",
    ).orderBy("ts", F.desc("priority"), "id")


def decisions_table(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        "id", "recommendation_id", "ts", "operator_id", "status", "justification",
        F.col("actual_action.type").alias("action_type"),
        F.col("actual_action.target_variable").alias("target_variable"),
        F.col("actual_action.proposed_value").alias("proposed_value")).orderBy("ts", "id")


def outcomes_table(outcomes: DataFrame) -> DataFrame:
    known = F.filter("metrics", lambda m: m["dev_pct"].isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, m: a + m["dev_pct"])
    return outcomes.select(
        "id", "decision_id", "recommendation_id", "ts", "quality_score", F.size("metrics").alias("n_metrics"),
        F.when(F.size(known) > 0, total / F.size(known)).alias("mean_deviation_pct")).orderBy("ts", "id")


def empty_table(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def as_json(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("json"))


def from_json(df: DataFrame, ddl: str, column: str = "json") -> DataFrame:
    return df.select(F.from_json(column, ddl).alias("_j")).select("_j.*")


def routed(recs: DataFrame, threshold: str = "critical", chat: bool = False) -> DataFrame:
    """Recommendations at or above an urgency, once per id, as request bodies.

    Unknown urgencies never pass; rows without an id cannot be told apart and all pass.
    """
    from ..model import URGENCIES, urgency_rank
    level = URGENCIES.index(threshold) if threshold in URGENCIES else 99
    hot = recs.filter(urgency_rank(F.lower("urgency")) >= level)
    hot = hot.filter(F.col("id").isNotNull()).dropDuplicates(["id"]).unionByName(hot.filter(F.col("id").isNull()))
    return hot.select("id", payload(chat).alias("body"))


def payload(chat: bool = False) -> Column:
    action = F.col("action_text")
    if chat:
        text = F.concat(F.lit("*"), F.upper("urgency"), F.lit("*\nscenario: "), "scenario", F.lit("\nrule: "),
                        "rule_id", F.lit("\ndiagnosis: "), "diagnosis", F.lit("\naction: "), action)
        return F.to_json(F.struct(text.alias("text")))
    return F.to_json(F.struct(
        F.lit("recommendation").alias("event"), "scenario", F.col("id").alias("rec_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "urgency",
        F.col("rule_id").alias("rule"), "diagnosis", action.alias("action")))


def session_minutes() -> Column:
    return minutes_between(F.col("end_ts"), F.col("start_ts"))
