"""Filter, join, order and limit queries over the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ladders import agreement
from .quality import latest_first_window

MAX_LIMIT = 10_000


def checked_limit(limit: int, max_limit: int = MAX_LIMIT) -> int:
    """`limit`, or an error where it is beyond what a history query may return."""
    if limit > max_limit:
        raise ValueError(f"limit {limit} is above {max_limit}")
    return limit


def _filtered(df: DataFrame, ts: str, from_ts=None, to_ts=None, **equal) -> DataFrame:
    for column, wanted in equal.items():
        if wanted is None:
            continue
        df = df.filter(F.col(column).isin(list(wanted)) if isinstance(wanted, (list, tuple))
                       else F.col(column) == wanted)
    if from_ts is not None:
        df = df.filter(F.col(ts) >= F.lit(from_ts))
    if to_ts is not None:
        df = df.filter(F.col(ts) <= F.lit(to_ts))
    return df


def query_samples(samples: DataFrame, scenario: str | None = None, from_ts=None, to_ts=None,
                  tags: Sequence[str] | None = None, limit: int = 1000, default_scenario: str | None = None,
                  ts: str = "ts", tie: Sequence[str] = (), max_limit: int = MAX_LIMIT) -> DataFrame:
    """Wide samples in time order; unknown tags are ignored."""
    d = _filtered(samples, ts, from_ts, to_ts, scenario=scenario or default_scenario)
    keys = [ts, "scenario"]
    known = [c for c in samples.columns if c not in keys]
    chosen = [t for t in tags if t in known] if tags else known
    out = d.orderBy(ts, *tie).limit(checked_limit(limit, max_limit))
    return out.select(*keys, *chosen)


def query_recommendations(recs: DataFrame, scenario: str | None = None, from_ts=None, to_ts=None,
                          status: Sequence[str] | None = None, urgency: Sequence[str] | None = None,
                          limit: int = 200, ts: str = "ts", tie: Sequence[str] = ("id",),
                          max_limit: int = MAX_LIMIT) -> DataFrame:
    d = _filtered(recs, ts, from_ts, to_ts, scenario=scenario,
                  status=list(status) if status else None, urgency=list(urgency) if urgency else None)
    return d.orderBy(F.desc(ts), *tie).limit(checked_limit(limit, max_limit))


def query_decisions(decisions: DataFrame, recs: DataFrame, scenario: str | None = None, from_ts=None,
                    to_ts=None, limit: int = 200, tie: Sequence[Column | str] = ("id",),
                    max_limit: int = MAX_LIMIT) -> DataFrame:
    """Decisions with the scenario, urgency, rule and diagnosis of their recommendation."""
    d = _filtered(decisions, "decided_at", from_ts, to_ts)
    r = _filtered(recs, "ts", scenario=scenario).select(
        F.col("id").alias("recommendation_id"), "scenario", "urgency", "rule_id", "diagnosis")
    return d.join(r, "recommendation_id").orderBy(F.desc("decided_at"), *tie).limit(checked_limit(limit, max_limit))


def scenario_catalogue(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("name", "n_samples", "ingested_at").orderBy(F.desc("ingested_at"), "name")


def recent_rows(df: DataFrame, n: int, keys: Sequence[str], now: Column | None = None, ts: str = "ts",
                tie: Sequence[str] = ()) -> DataFrame:
    """The last `n` rows of every series up to a cursor (a pre-shuffle group limit applies)."""
    d = df if now is None else df.filter(F.col(ts) <= now)
    return (d.withColumn("_rk", F.row_number().over(latest_first_window(keys, ts, *tie)))
            .filter(F.col("_rk") <= n).drop("_rk"))


def visible_at(df: DataFrame, now: Column, limit: int, ts: str = "ts", tie: Sequence[str] = ("id",)) -> DataFrame:
    """Rows up to the cursor, latest first, with the total before the limit."""
    seen = df.filter(F.col(ts) <= now)
    total = seen.agg(F.count(F.lit(1)).alias("total"))
    return seen.orderBy(F.desc(ts), *tie).limit(limit).join(F.broadcast(total))


def events_in_window(streams: dict[str, tuple[DataFrame, str]], start: Column | None, end: Column) -> DataFrame:
    """(start, end] over several event tables; no start means from the beginning."""
    out = None
    for kind, (df, ts) in streams.items():
        d = df.filter(F.col(ts) <= end)
        if start is not None:
            d = d.filter(F.col(ts) > start)
        d = d.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.col(ts).alias("ts"))
        out = d if out is None else out.unionByName(d)
    return out


def point_lookup(df: DataFrame, key: Column, id_column: str = "id") -> DataFrame:
    return df.filter(F.col(id_column) == key)


def state_at(samples: DataFrame, now: Column, keys: Sequence[str], measured: str | None = None,
             predicted: str | None = None, ts: str = "ts") -> DataFrame:
    """Latest row per key at the cursor, optionally with measured/predicted agreement."""
    rest = [c for c in samples.columns if c not in keys]
    d = (samples.filter(F.col(ts) <= now).groupBy(*keys)
         .agg(F.max_by(F.struct(*rest), F.col(ts)).alias("_row")).select(*keys, "_row.*"))
    if measured and predicted:
        d = d.withColumn("agreement", agreement(F.col(measured), F.col(predicted)))
    return d


def resolved_status(recs: DataFrame, overrides: DataFrame, decisions: DataFrame) -> DataFrame:
    """Operator override, else the first decision, else pending."""
    first = decisions.groupBy("recommendation_id").agg(
        F.min_by("status", F.struct("ts", "id")).alias("_decided"))
    o = overrides.select("recommendation_id", F.col("status").alias("_override"))
    d = recs.withColumnRenamed("id", "recommendation_id")
    return (d.join(o, "recommendation_id", "left").join(first, "recommendation_id", "left")
            .withColumn("status", F.coalesce("_override", "_decided", F.lit("pending")))
            .drop("_override", "_decided").withColumnRenamed("recommendation_id", "id"))


def enriched_decisions(decisions: DataFrame, recs: DataFrame) -> DataFrame:
    """Decisions with rule and urgency; unknown recommendations give empty text."""
    r = recs.select(F.col("id").alias("recommendation_id"), "urgency", "rule_id")
    return decisions.join(r, "recommendation_id", "left").fillna("", ["urgency", "rule_id"])


def latest_first(df: DataFrame, limit: int, ts: str = "ts", tie: Sequence[str] = ("id",)) -> DataFrame:
    return df.orderBy(F.desc(ts), *tie).limit(limit)


def steady_state_means(samples: DataFrame, columns: Sequence[str], keys: Sequence[str], rows: int = 200,
                       ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    return recent_rows(samples, rows, keys, ts=ts, tie=tie).groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in columns])
