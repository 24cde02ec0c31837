"""Registered queries over the given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def us(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))


def r6(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


# --- the given tables seen as telemetry and as a decision trail --------------------

def readings(spark, sf) -> DataFrame:
    """`events` as five long series: tag = event type."""
    from ..sources.samples import normalise_events
    return normalise_events(table(spark, sf, "events"), F.lit("plant"), F.col("event_type"))


def user_readings(spark, sf) -> DataFrame:
    """`events` as one short series per (user, event type)."""
    from ..sources.samples import normalise_events
    return normalise_events(table(spark, sf, "events"), F.col("user_id"), F.col("event_type"))


READINGS_SQL = "r AS (SELECT event_type AS tag, user_id, epoch_us(ts) AS us, value FROM events)"


def recs(spark, sf) -> DataFrame:
    """`orders` as recommendations."""
    o = table(spark, sf, "orders")
    urgency = (F.when(F.col("o_orderpriority") == "1-URGENT", "critical")
               .when(F.col("o_orderpriority") == "2-HIGH", "high")
               .when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low"))
    status = (F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "P", "rejected")
              .otherwise("pending"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("S"), F.col("o_custkey") % 25).alias("scenario"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("R"), F.col("o_custkey") % 10).alias("rule_id"), urgency.alias("urgency"),
        status.alias("status"), (0.5 + (F.col("o_custkey") % 50) / 100.0).alias("confidence"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("diagnosis"))


RECS_SQL = """recs AS (SELECT o_orderkey AS id, 'S' || (o_custkey % 25) AS scenario, epoch_us(o_orderdate) AS us,
  'R' || (o_custkey % 10) AS rule_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
       ELSE 'low' END AS urgency,
  CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'rejected' ELSE 'pending' END AS status,
  0.5 + (o_custkey % 50) / 100.0::DOUBLE AS confidence, o_totalprice AS price, o_orderpriority AS diagnosis
  FROM orders)"""


def decisions(spark, sf) -> DataFrame:
    """`lineitem` as decisions on orders."""
    status = (F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rejected")
              .otherwise("modified"))
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("recommendation_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), status.alias("status"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


DEC_SQL = """dec AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS recommendation_id,
  epoch_us(l_shipdate) AS us,
  CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'modified' END AS status,
  l_partkey AS part, l_suppkey AS supp, l_quantity AS quantity, l_extendedprice AS price,
  l_discount AS discount, l_tax AS tax FROM lineitem)"""

DEC_TIE = ["id", "part", "supp", "price", "quantity", "discount", "tax", "status"]
DEC_TIE_SQL = "id, part, supp, price, quantity, discount, tax, status"
