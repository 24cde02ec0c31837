"""History filters, joins, upserts and reports over the decision trail."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import minutes_between
from ..operators import decisions as dec
from ..operators import history, quality, reports
from ..operators.charts import training_rows
from ..operators.scale import checked_broadcast
from ..operators.windows import scaler, time_split
from ..sources import samples, tables
from .registry import (DEC_SQL, DEC_TIE, DEC_TIE_SQL, READINGS_SQL, RECS_SQL, decisions, query, r6, readings, recs,
                       table, us, user_readings)


def ts_lit(text: str):
    return F.lit(text).cast("timestamp")


@query("sample_history", """
SELECT epoch_us(ts) AS ts_us, event_type AS scenario, event_id, value FROM events
WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'
ORDER BY ts LIMIT 1000""")
def _(spark, sf):
    wide = table(spark, sf, "events").select("ts", F.col("event_type").alias("scenario"), "event_id", "value")
    d = history.query_samples(wide, "click", "2024-01-05", "2024-01-25", ["event_id", "value", "not_a_tag"], 1000)
    return d.select(us("ts").alias("ts_us"), "scenario", "event_id", "value")


@query("recommendation_history", f"""WITH {RECS_SQL}
SELECT id, scenario, us AS ts_us, rule_id, urgency, status FROM recs
WHERE us >= epoch_us(TIMESTAMP '1996-01-01') AND us <= epoch_us(TIMESTAMP '1999-12-31')
  AND status IN ('accepted', 'rejected') AND urgency IN ('critical', 'high')
ORDER BY us DESC, id LIMIT 200""")
def _(spark, sf):
    d = history.query_recommendations(recs(spark, sf), None, "1996-01-01", "1999-12-31",
                                      ["accepted", "rejected"], ["critical", "high"], 200)
    return d.select("id", "scenario", us("ts").alias("ts_us"), "rule_id", "urgency", "status")


@query("scenario_catalogue", """
SELECT event_type AS name, count(*) AS n_samples, epoch_us(max(ts)) AS ingested_us FROM events GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(
        F.count(F.lit(1)).alias("n_samples"), F.max("ts").alias("ingested_at"))
    return history.scenario_catalogue(d).select("name", "n_samples", us("ingested_at").alias("ingested_us"))


@query("recent_rows", f"""WITH {READINGS_SQL}
SELECT tag, us AS ts_us, value FROM r WHERE us <= epoch_us(TIMESTAMP '2024-01-20')
QUALIFY row_number() OVER (PARTITION BY tag ORDER BY us DESC) <= 240""")
def _(spark, sf):
    d = history.recent_rows(readings(spark, sf), 240, ["tag"], ts_lit("2024-01-20"))
    return d.select("tag", us("ts").alias("ts_us"), "value")


@query("visible_at_cursor", f"""WITH {RECS_SQL}, v AS (SELECT * FROM recs WHERE us <= epoch_us(TIMESTAMP '1998-06-01'))
SELECT id, us AS ts_us, urgency, (SELECT count(*) FROM v) AS total FROM v ORDER BY us DESC, id LIMIT 100""")
def _(spark, sf):
    d = history.visible_at(recs(spark, sf), ts_lit("1998-06-01"), 100)
    return d.select("id", us("ts").alias("ts_us"), "urgency", "total")


@query("events_in_window", f"""WITH {RECS_SQL}, {DEC_SQL}
SELECT 'recommendation' AS kind, CAST(id AS VARCHAR) AS id, us AS ts_us FROM recs
 WHERE us > epoch_us(TIMESTAMP '1997-01-01') AND us <= epoch_us(TIMESTAMP '1997-03-01')
UNION ALL SELECT 'decision', CAST(id AS VARCHAR), us FROM dec
 WHERE us > epoch_us(TIMESTAMP '1997-01-01') AND us <= epoch_us(TIMESTAMP '1997-03-01')""")
def _(spark, sf):
    d = history.events_in_window({"recommendation": (recs(spark, sf), "ts"), "decision": (decisions(spark, sf), "ts")},
                                 ts_lit("1997-01-01"), ts_lit("1997-03-01"))
    return d.select("kind", "id", us("ts").alias("ts_us"))


@query("point_lookup", f"WITH {RECS_SQL} SELECT id, rule_id, urgency, status, price FROM recs WHERE id = 17")
def _(spark, sf):
    return history.point_lookup(recs(spark, sf), F.lit(17)).select("id", "rule_id", "urgency", "status", "price")


@query("state_at_cursor", f"""WITH {READINGS_SQL}
SELECT user_id, max(us) AS ts_us, arg_max(value, us) AS value, arg_max(tag, us) AS tag,
  round(greatest(0.0, 1 - abs(arg_max(value, us) - 50.0) / 5), 6) AS agreement
FROM r WHERE us <= epoch_us(TIMESTAMP '2024-01-15') GROUP BY user_id""")
def _(spark, sf):
    d = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value",
                                          F.col("event_type").alias("tag"), F.lit(50.0).alias("predicted"))
    d = history.state_at(d, ts_lit("2024-01-15"), ["user_id"], "value", "predicted")
    return d.select("user_id", us("ts").alias("ts_us"), "value", "tag", r6("agreement").alias("agreement"))


@query("warmup_cut", f"""WITH {READINGS_SQL}, s AS (SELECT *, min(us) OVER (PARTITION BY user_id) AS t0 FROM r)
SELECT user_id, us AS ts_us, tag, value FROM s WHERE us >= t0 + 3 * 86400000000 AND value > 150""")
def _(spark, sf):
    from ..operators.alerts import after_warmup, run_starts
    r = user_readings(spark, sf)
    d = after_warmup(r.filter(F.col("value") > 150), run_starts(r), 3 * 1440)
    return d.select(F.col("asset").cast("long").alias("user_id"), us("ts").alias("ts_us"), "tag", "value")


@query("training_split", f"""WITH {READINGS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY us) AS rn,
 count(*) OVER (PARTITION BY tag) AS n FROM r)
SELECT tag, us AS ts_us, value, rn FROM x WHERE rn <= floor(n * 0.25)""")
def _(spark, sf):
    from ..operators.scale import chunk_seconds_for
    r = readings(spark, sf)
    d = training_rows(r, 0.25, ["tag"], seconds=chunk_seconds_for(r, ["tag"]))
    return d.select("tag", us("ts").alias("ts_us"), "value", "rn")


@query("complete_rows", """
SELECT l_returnflag, count(*) AS n, round(sum(l_discount), 4) AS s_discount FROM lineitem
WHERE nullif(l_discount, 0) IS NOT NULL AND nullif(l_tax, 0) IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_returnflag", F.nullif("l_discount", F.lit(0)).alias("a"),
                                            F.nullif("l_tax", F.lit(0)).alias("b")).dropna(subset=["a", "b"])
    return d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("a"), 4).alias("s_discount"))


@query("time_split", """WITH x AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn,
 count(*) OVER () AS n FROM events)
SELECT event_id, rn > n - greatest(1, CAST(floor(n * 0.2) AS BIGINT)) AS is_val FROM x""")
def _(spark, sf):
    d = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return time_split(d, 0.2, "ts", ["event_id"]).select("event_id", "is_val")


@query("scenario_split", """
SELECT event_type IN ('error') AS is_holdout, event_type, count(*) AS n FROM events
WHERE event_type IN ('error', 'click', 'view') GROUP BY 1, 2""")
def _(spark, sf):
    d = table(spark, sf, "events").filter(F.col("event_type").isin("error", "click", "view"))
    return d.groupBy(F.col("event_type").isin("error").alias("is_holdout"), "event_type").agg(
        F.count(F.lit(1)).alias("n"))


@query("decision_history", f"""WITH {RECS_SQL}, {DEC_SQL}
SELECT d.id, d.recommendation_id, d.status, d.us AS ts_us, r.scenario, r.urgency, r.rule_id, r.diagnosis
FROM dec d JOIN recs r ON d.recommendation_id = r.id
WHERE r.scenario = 'S7' AND d.us >= epoch_us(TIMESTAMP '1996-01-01')
ORDER BY d.us DESC, {', '.join('d.' + c.strip() for c in DEC_TIE_SQL.split(','))} LIMIT 200""")
def _(spark, sf):
    d = decisions(spark, sf).withColumnRenamed("ts", "decided_at")
    out = history.query_decisions(d, recs(spark, sf), "S7", "1996-01-01", None, 200, tie=DEC_TIE)
    return out.select("id", "recommendation_id", "status", us("decided_at").alias("ts_us"), "scenario", "urgency",
                      "rule_id", "diagnosis")


@query("status_resolution", f"""WITH {RECS_SQL}, {DEC_SQL},
o AS (SELECT id AS recommendation_id, 'modified' AS status FROM recs WHERE rule_id = 'R3'),
f AS (SELECT recommendation_id, arg_min(status, (us, id, status)) AS status FROM dec GROUP BY 1)
SELECT recs.id, coalesce(o.status, f.status, 'pending') AS status FROM recs
LEFT JOIN o ON recs.id = o.recommendation_id LEFT JOIN f ON recs.id = f.recommendation_id""")
def _(spark, sf):
    r = recs(spark, sf)
    over = r.filter(F.col("rule_id") == "R3").select(F.col("id").alias("recommendation_id"),
                                                     F.lit("modified").alias("status"))
    d = decisions(spark, sf).withColumn("id", F.struct("id", "status"))
    return history.resolved_status(r, over, d).select("id", "status")


@query("decision_enrichment", f"""WITH {RECS_SQL}, {DEC_SQL}
SELECT d.status, coalesce(r.urgency, '') AS urgency, coalesce(r.rule_id, '') AS rule_id, count(*) AS n
FROM dec d LEFT JOIN (SELECT * FROM recs WHERE price > 200000) r ON d.recommendation_id = r.id GROUP BY ALL""")
def _(spark, sf):
    r = recs(spark, sf).filter(F.col("price") > 200000)
    d = history.enriched_decisions(decisions(spark, sf), r)
    return d.groupBy("status", "urgency", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("pending_measurements", f"""WITH {RECS_SQL}, {DEC_SQL},
o AS (SELECT recommendation_id, status, us FROM dec), m AS (SELECT id FROM recs WHERE rule_id = 'R1')
SELECT o.recommendation_id, o.status, o.us AS ts_us, r.rule_id FROM o JOIN recs r ON o.recommendation_id = r.id
WHERE o.recommendation_id NOT IN (SELECT id FROM m) AND o.status IN ('accepted', 'modified')
 AND epoch_us(TIMESTAMP '1999-01-01') >= o.us + CAST(round(CASE WHEN r.id % 50 = 0 THEN 30.0 ELSE r.id % 50 END * 60000000)
 AS BIGINT)""")
def _(spark, sf):
    from ..model import IMPACT_DDL
    r = recs(spark, sf).withColumn("asset", F.lit("plant")).withColumn("expected_impact", F.array(F.struct(
        F.lit("x").alias("variable"), F.lit(0.0).alias("current_value"), F.lit(1.0).alias("predicted_value"),
        (F.col("id") % 50).cast("double").alias("time_to_effect_minutes"), F.lit("").alias("description")))
        .cast(f"array<{IMPACT_DDL}>"))
    over = decisions(spark, sf).select("recommendation_id", "status", F.col("ts").alias("decision_ts"))
    done = r.filter(F.col("rule_id") == "R1").select(F.col("id").alias("recommendation_id"))
    d = dec.pending_measurements(over, r, done, ts_lit("1999-01-01"))
    return d.select("recommendation_id", "status", us("decision_ts").alias("ts_us"), "rule_id")


# --- upserts ----------------------------------------------------------------------

@query("append_new_samples", """WITH stored AS (SELECT * FROM events WHERE value < 40),
inc AS (SELECT user_id, event_type, date_trunc('hour', ts) AS h, event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10')
SELECT user_id, event_type, epoch_us(h) AS ts_us, event_id, value FROM inc
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.user_id = inc.user_id AND s.event_type = inc.event_type
  AND date_trunc('hour', s.ts) = inc.h)
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, h ORDER BY event_id) = 1""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "h", F.date_trunc("hour", "ts"))
    key = ["user_id", "event_type", "h"]
    out = samples.new_samples(e.filter(F.col("ts") >= "2024-01-10"), e.filter("value < 40"), key, ["event_id"])
    return out.select("user_id", "event_type", us("h").alias("ts_us"), "event_id", "value")


@query("reingest_scenarios", """WITH stored AS (SELECT event_type AS scenario, event_id, value FROM events
 WHERE event_type IN ('click', 'view')),
inc AS (SELECT event_type AS scenario, event_id + 1000000000 AS event_id, value FROM events WHERE event_type IN ('view', 'error'))
SELECT scenario, count(*) AS n, sum(event_id) AS ids FROM (
 SELECT * FROM stored WHERE scenario NOT IN (SELECT DISTINCT scenario FROM inc) UNION ALL SELECT * FROM inc) GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("scenario"), "event_id", "value")
    inc = e.filter(F.col("scenario").isin("view", "error")).withColumn("event_id", F.col("event_id") + 1000000000)
    d = samples.reingest(e.filter(F.col("scenario").isin("click", "view")), inc, force=True)
    return d.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("catalogue_upsert", """WITH s AS (SELECT event_type AS name, count(*) AS n_samples, max(ts) AS seen FROM events
 WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
i AS (SELECT event_type AS name, count(*) AS n_samples, max(ts) AS seen FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT name, arg_max(n_samples, (seen, k)) AS n_samples, epoch_us(max(seen)) AS ingested_us
FROM (SELECT *, 0 AS k FROM s UNION ALL SELECT *, 1 FROM i) GROUP BY name""")
def _(spark, sf):
    e = table(spark, sf, "events")
    def cat(d):
        return d.groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n_samples"),
                                                                F.max("ts").alias("ingested_at"))
    d = tables.upsert_latest(cat(e.filter("ts < timestamp_ntz'2024-01-15'")), cat(e.filter("event_type <> 'view'")),
                             ["name"], "ingested_at")
    return d.select("name", "n_samples", us("ingested_at").alias("ingested_us"))


@query("recommendation_upsert", f"""WITH {RECS_SQL}, s AS (SELECT * FROM recs WHERE price > 150000),
n AS (SELECT * REPLACE ('executed' AS status, 0.0::DOUBLE AS price) FROM recs WHERE urgency IN ('critical', 'low'))
SELECT coalesce(s.id, n.id) AS id, CASE WHEN s.id IS NULL THEN n.price ELSE s.price END AS price,
 coalesce(s.rule_id, n.rule_id) AS rule_id, coalesce(n.status, s.status) AS status FROM s FULL JOIN n ON s.id = n.id""")
def _(spark, sf):
    r = recs(spark, sf)
    new = r.filter("urgency IN ('critical', 'low')").withColumn("status", F.lit("executed")).withColumn("price", F.lit(0.0))
    return tables.upsert_status(r.filter("price > 150000"), new).select("id", "price", "rule_id", "status")


@query("status_update", f"""WITH {RECS_SQL}
SELECT id, CASE WHEN urgency = 'critical' THEN 'executed' ELSE status END AS status FROM recs""")
def _(spark, sf):
    r = recs(spark, sf)
    return tables.set_status(r, r.filter("urgency = 'critical'").withColumn("status", F.lit("executed"))).select("id", "status")


@query("decision_append", f"""WITH {DEC_SQL} SELECT status, count(*) AS n FROM (
SELECT status FROM dec WHERE quantity < 10 UNION ALL SELECT status FROM dec WHERE quantity > 40) GROUP BY 1""")
def _(spark, sf):
    import uuid
    from ..session import shared_dir
    path = f"{shared_dir(spark)}/decisions-{uuid.uuid4().hex}"
    d = decisions(spark, sf)
    tables.append(d.filter("quantity < 10").select("id", "status"), path)
    tables.append(d.filter("quantity > 40").select("id", "status"), path)
    return spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("latest_metrics", """WITH m AS (SELECT l_returnflag AS model, date_trunc('month', l_shipdate) AS run_ts,
 avg(l_extendedprice) AS mae FROM lineitem GROUP BY ALL)
SELECT model, epoch_us(max(run_ts)) AS run_us, round(arg_max(mae, run_ts), 4) AS mae FROM m GROUP BY model""")
def _(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"), F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("run_ts")
    ).agg(F.avg("l_extendedprice").alias("mae"))
    return tables.latest_metrics(m).select("model", us("run_ts").alias("run_us"), F.round("mae", 4).alias("mae"))


@query("alert_routing", f"""WITH {RECS_SQL}
SELECT id, '{{"text":"*' || upper(urgency) || '*\\nscenario: ' || scenario || '\\nrule: ' || rule_id || '\\ndiagnosis: '
 || diagnosis || '\\naction: check"}}' AS body FROM recs WHERE urgency IN ('high', 'critical')""")
def _(spark, sf):
    r = recs(spark, sf).withColumn("action_text", F.lit("check"))
    return tables.routed(r.unionByName(r.filter("price > 200000")), "high", chat=True)


@query("json_round_trip", f"""WITH {RECS_SQL} SELECT rule_id, count(*) AS n, round(sum(price), 2) AS price FROM recs GROUP BY 1""")
def _(spark, sf):
    r = recs(spark, sf).select("id", "rule_id", "price", "ts")
    d = tables.from_json(tables.as_json(r), "id LONG, rule_id STRING, price DOUBLE, ts TIMESTAMP")
    return d.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("price"))


# --- data quality -----------------------------------------------------------------

DIM_ROWS = [("click", 0.0, 150.0, True), ("view", 5.0, 200.0, True), ("purchase", 0.0, 300.0, False),
            ("error", 1.0, 100.0, True)]
DIM_SQL = ("dim AS (SELECT * FROM (VALUES ('click', 0.0, 150.0, true), ('view', 5.0, 200.0, true), "
           "('purchase', 0.0, 300.0, false), ('error', 1.0, 100.0, true)) t(tag, min_range, max_range, writable))")


def dim(spark):
    return spark.createDataFrame(DIM_ROWS, "tag string, min_range double, max_range double, writable boolean")


@query("missing_tags", """WITH t(tag) AS (VALUES ('click'), ('view'), ('purchase'), ('error'), ('heartbeat')),
u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, tag FROM u CROSS JOIN t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.tag)""")
def _(spark, sf):
    wanted = spark.createDataFrame([(t,) for t in ("click", "view", "purchase", "error", "heartbeat")], "tag string")
    d = quality.missing_tags(user_readings(spark, sf), wanted)
    return d.select(F.col("asset").cast("long").alias("user_id"), "tag")


@query("row_count_check", """SELECT user_id, count(*) AS n_rows, CASE WHEN count(*) < 60 THEN 'too_few'
 WHEN count(*) > 100000 THEN 'too_many' ELSE 'ok' END AS verdict FROM events GROUP BY 1""")
def _(spark, sf):
    return quality.row_count_check(table(spark, sf, "events"), ["user_id"])


@query("numeric_check", """WITH c AS (SELECT count(*) AS n_rows, count(*) FILTER (try_cast(o_orderpriority AS DOUBLE) IS NULL) AS p,
 count(*) FILTER (try_cast(o_totalprice AS DOUBLE) IS NULL) AS t, count(*) FILTER (try_cast(substr(o_orderpriority, 1,
 CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 1 END) AS DOUBLE) IS NULL) AS m FROM orders)
SELECT "column", n_rows, n_bad, round(n_bad / n_rows, 6) AS bad_ratio, CASE WHEN n_bad / n_rows >= 1 THEN 'error'
 WHEN n_bad / n_rows > 0.1 THEN 'warning' ELSE 'ok' END AS verdict FROM (
 SELECT 'priority' AS "column", n_rows, p AS n_bad FROM c UNION ALL SELECT 'total', n_rows, t FROM c
 UNION ALL SELECT 'mixed', n_rows, m FROM c)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("string").alias("total"),
        F.expr("substr(o_orderpriority, 1, CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 1 END)").alias("mixed"))
    return quality.numeric_check(o, ["priority", "total", "mixed"]).withColumn("bad_ratio", r6("bad_ratio"))


@query("timestamp_check", """SELECT lang, count(*) AS n_rows, count(*) FILTER (doc_id % 4 = 0) AS n_bad FROM documents GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.expr(
        "CASE WHEN doc_id % 4 = 0 THEN concat('x', doc_id) ELSE '2024-01-02 03:04:05' END").alias("stamp"))
    return quality.timestamp_check(d, "stamp", ["lang"])


@query("name_check", """SELECT p_brand AS name, regexp_full_match(p_brand, '[a-z0-9_]{2,40}') AS raw_ok,
 regexp_full_match(replace(lower(p_brand), '#', '_'), '[a-z0-9_]{2,40}') AS slug_ok FROM part GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct()
    return d.select("name", quality.valid_name(F.col("name")).alias("raw_ok"),
                    quality.valid_name(F.replace(F.lower("name"), F.lit("#"), F.lit("_"))).alias("slug_ok"))


QUALITY_SQL = f"""WITH {DIM_SQL}, e AS (SELECT event_id, event_type AS tag, epoch_us(ts) AS us, ts,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE round(value / 50) * 50 END AS v FROM events JOIN dim ON event_type = dim.tag),
g AS (SELECT e.*, lag(v) OVER (PARTITION BY tag ORDER BY us) AS prev FROM e WHERE v IS NOT NULL),
c AS (SELECT *, max(CASE WHEN prev IS NULL OR abs(v - prev) >= 1e-9 THEN us END) OVER (PARTITION BY tag ORDER BY us) AS changed FROM g),
q AS (SELECT event_id, c.tag, CASE WHEN v < min_range OR v > max_range THEN 1 WHEN prev IS NOT NULL AND abs(v - prev) < 1e-9
 AND us - changed > 3600000000 THEN 2 ELSE 0 END AS quality FROM c JOIN dim ON c.tag = dim.tag
 UNION ALL SELECT event_id, tag, 3 FROM e WHERE v IS NULL)"""


def flagged(spark, sf):
    from ..operators.scale import chunk_seconds_for
    raw = table(spark, sf, "events").select(
        "event_id", F.lit("plant").alias("asset"), F.col("event_type").alias("tag"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 11 == 0, "bad").otherwise((F.round(F.col("value") / 50) * 50).cast("string")).alias("value"))
    return quality.quality_flags(raw, dim(spark), stale_s=3600, seconds=chunk_seconds_for(raw, ["asset", "tag"]))


@query("quality_flags", QUALITY_SQL + " SELECT event_id, tag, quality FROM q")
def _(spark, sf):
    return flagged(spark, sf).select("event_id", "tag", "quality")


@query("bad_readings_per_sample", QUALITY_SQL + """ SELECT epoch_us(date_trunc('day', e.ts)) AS day_us, count(*) AS n_values,
 count(*) FILTER (quality <> 0) AS n_bad FROM q JOIN events e USING (event_id) GROUP BY 1""")
def _(spark, sf):
    d = flagged(spark, sf).withColumn("day_us", us(F.date_trunc("day", "ts")))
    return quality.bad_per_sample(d, ["day_us"])


@query("setpoint_gate", f"""WITH {DIM_SQL}, q AS (SELECT event_id, event_type AS tag, value,
 value * CASE WHEN event_id % 3 = 0 THEN 1.05 ELSE 1.001 END AS readback FROM events)
SELECT event_id, CASE WHEN dim.tag IS NULL THEN 'tag_not_found' WHEN NOT writable THEN 'blocked_not_writable'
 WHEN value < min_range THEN 'blocked_below_range' WHEN value > max_range THEN 'blocked_above_range'
 WHEN abs(readback - value) / greatest(abs(value), 1e-9) > 0.02 THEN 'readback_mismatch' ELSE 'success' END AS status
FROM q LEFT JOIN dim ON q.tag = dim.tag""")
def _(spark, sf):
    d = table(spark, sf, "events").select("event_id", F.col("event_type").alias("tag"), "value", (
        F.col("value") * F.when(F.col("event_id") % 3 == 0, 1.05).otherwise(1.001)).alias("readback"))
    return quality.setpoint_gate(d, dim(spark)).select("event_id", "status")


@query("tag_dimension_lookup", f"""WITH {DIM_SQL} SELECT event_type AS tag, count(*) AS n,
 count(*) FILTER (value > max_range) AS n_high, bool_and(writable) AS writable
FROM events LEFT JOIN dim ON event_type = dim.tag GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "events").withColumnRenamed("event_type", "tag").join(checked_broadcast(dim(spark)), "tag", "left")
    return d.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > F.col("max_range")).alias("n_high"),
                                F.bool_and("writable").alias("writable"))


@query("wide_long_round_trip", """SELECT user_id, count(DISTINCT ts) AS n_ts, round(sum(value) FILTER (event_type = 'click'), 4) AS click,
 round(sum(value) FILTER (event_type = 'view'), 4) AS view, round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase,
 round(sum(value) FILTER (event_type = 'signup'), 4) AS signup, round(sum(value) FILTER (event_type = 'error'), 4) AS error
 FROM events GROUP BY 1""")
def _(spark, sf):
    tags = ["click", "view", "purchase", "signup", "error"]
    long = user_readings(spark, sf)
    back = samples.to_long(samples.to_wide(long, tags), tags)
    w = samples.to_wide(back, tags)
    return w.groupBy(F.col("asset").cast("long").alias("user_id")).agg(
        F.count(F.lit(1)).alias("n_ts"), *[F.round(F.sum(t), 4).alias(t) for t in tags])


# --- reports ----------------------------------------------------------------------

@query("kpi_summary", """WITH d AS (SELECT * FROM (VALUES ('click', 0.5, NULL), ('view', NULL, 300.0), ('error', NULL, NULL)) t(tag, lo, hi))
SELECT event_type AS tag, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS std,
 coalesce(min(value) < any_value(lo), false) OR coalesce(max(value) > any_value(hi), false) AS spec_violated
FROM events JOIN d ON event_type = d.tag GROUP BY 1""")
def _(spark, sf):
    d = spark.createDataFrame([("click", 0.5, None, True), ("view", None, 300.0, True), ("error", None, None, True),
                               ("signup", None, None, False)], "tag string, spec_min double, spec_max double, is_kpi boolean")
    k = reports.kpi_summary(readings(spark, sf), d)
    return k.select("tag", r6("mean").alias("mean"), "min", "max", r6("std").alias("std"), "spec_violated")


@query("run_summary", """SELECT event_type AS tag, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6, 6) AS duration_h,
 count(*) AS n_samples, round(100.0 * count(*) FILTER (value < 20) / count(value), 6) AS below_spec_pct FROM events GROUP BY 1""")
def _(spark, sf):
    d = reports.run_summary(readings(spark, sf), ["tag"], F.col("value"), 20.0)
    return d.select("tag", r6("duration_h").alias("duration_h"), "n_samples", r6("below_spec_pct").alias("below_spec_pct"))


@query("recommendations_summary", f"""WITH {RECS_SQL}
SELECT CASE grouping(urgency, rule_id) WHEN 1 THEN 'urgency' WHEN 2 THEN 'rule' ELSE 'all' END AS facet,
 coalesce(urgency, rule_id, '') AS item, count(*) AS total, count(*) FILTER (status <> 'pending') AS n_decided,
 count(*) FILTER (status = 'accepted') AS n_accepted, count(*) FILTER (status = 'rejected') AS n_rejected,
 round(count(*) FILTER (status = 'accepted') / nullif(count(*) FILTER (status <> 'pending'), 0), 6) AS acceptance_rate
FROM recs GROUP BY GROUPING SETS ((urgency), (rule_id), ())""")
def _(spark, sf):
    return reports.recommendations_summary(recs(spark, sf)).withColumn("acceptance_rate", r6("acceptance_rate"))


@query("decisions_summary", f"WITH {DEC_SQL} SELECT status, count(*) AS n FROM dec GROUP BY 1")
def _(spark, sf):
    return reports.decisions_summary(decisions(spark, sf))


@query("decision_log_latest", f"""WITH {DEC_SQL} SELECT id, us AS ts_us, status FROM dec ORDER BY us DESC, {DEC_TIE_SQL} LIMIT 500""")
def _(spark, sf):
    return history.latest_first(decisions(spark, sf), 500, tie=DEC_TIE).select("id", us("ts").alias("ts_us"), "status")


@query("decision_counts", f"""WITH {RECS_SQL}, {DEC_SQL}, d AS (SELECT dec.*, scenario FROM dec JOIN recs ON recommendation_id = recs.id),
a AS (SELECT scenario, count(*) AS recommendations FROM recs GROUP BY 1),
b AS (SELECT scenario, count(*) AS decisions, count(*) FILTER (d.status = 'accepted') AS accepted,
 count(*) FILTER (d.status = 'modified') AS modified, count(*) FILTER (d.status = 'rejected') AS rejected,
 count(*) FILTER (d.status = 'auto_executed') AS auto_executed, count(*) FILTER (d.status <> 'rejected') AS executions,
 count(*) FILTER (d.status = 'accepted' AND quantity > 25) AS outcomes FROM d GROUP BY 1)
SELECT scenario, recommendations, decisions, accepted, modified, rejected, auto_executed, executions, outcomes FROM a JOIN b USING (scenario)""")
def _(spark, sf):
    r = recs(spark, sf)
    d = decisions(spark, sf).join(r.select(F.col("id").alias("recommendation_id"), "scenario"), "recommendation_id")
    return reports.decision_counts(r, d, d.filter("status <> 'rejected'"), d.filter("status = 'accepted' AND quantity > 25"),
                                   ["scenario"])


TRACK_SQL = f"""{RECS_SQL}, {DEC_SQL}, d AS (SELECT dec.*, rule_id, scenario FROM dec JOIN recs ON recommendation_id = recs.id),
o AS (SELECT rule_id, scenario, discount * 10 AS q FROM d WHERE status = 'accepted' AND quantity > 25)"""


def trail(spark, sf):
    r = recs(spark, sf)
    d = decisions(spark, sf).join(r.select(F.col("id").alias("recommendation_id"), "rule_id", "scenario"), "recommendation_id")
    o = d.filter("status = 'accepted' AND quantity > 25").withColumn("quality_score", F.col("discount") * 10)
    return r, d, o


@query("rule_track_record", f"""WITH {TRACK_SQL}, a AS (SELECT rule_id, count(*) AS total_recs FROM recs GROUP BY 1),
b AS (SELECT rule_id, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'modified') AS modified,
 count(*) FILTER (status = 'rejected') AS rejected FROM d GROUP BY 1),
c AS (SELECT rule_id, count(*) AS outcomes_measured, count(*) FILTER (q >= 0.5) AS successes, count(*) FILTER (q < 0.5) AS failures FROM o GROUP BY 1)
SELECT rule_id, total_recs, accepted, modified, rejected, outcomes_measured, successes, failures,
 round((accepted + modified) / total_recs, 6) AS acceptance_rate, round(successes / outcomes_measured, 6) AS success_rate,
 round(0.5 + 0.5 * (accepted + modified) / total_recs + 0.5 * successes / outcomes_measured, 6) AS confidence_adj
FROM a JOIN b USING (rule_id) JOIN c USING (rule_id)""")
def _(spark, sf):
    d = dec.track_record(*trail(spark, sf))
    return d.select("rule_id", "total_recs", "accepted", "modified", "rejected", "outcomes_measured", "successes", "failures",
                    *[r6(c).alias(c) for c in ("acceptance_rate", "success_rate", "confidence_adj")])


@query("track_record_rollup", f"""WITH {TRACK_SQL}, a AS (SELECT rule_id, count(*) AS total_recs FROM recs GROUP BY 1),
b AS (SELECT rule_id, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'modified') AS modified,
 count(*) FILTER (status = 'rejected') AS rejected FROM d GROUP BY 1),
c AS (SELECT rule_id, count(*) AS outcomes_measured, count(*) FILTER (q >= 0.5) AS successes FROM o GROUP BY 1)
SELECT rule_id, total_recs, accepted, modified, rejected, outcomes_measured, successes,
 round((accepted + modified) / total_recs, 6) AS acceptance_rate, round(successes / outcomes_measured, 6) AS success_rate
FROM a JOIN b USING (rule_id) JOIN c USING (rule_id)""")
def _(spark, sf):
    d = reports.record_rollup(dec.track_record(*trail(spark, sf), by=("rule_id", "scenario")))
    return d.select("rule_id", "total_recs", "accepted", "modified", "rejected", "outcomes_measured", "successes",
                    r6("acceptance_rate").alias("acceptance_rate"), r6("success_rate").alias("success_rate"))


@query("confidence_feedback", f"""WITH {TRACK_SQL}, a AS (SELECT rule_id, count(*) AS n FROM recs GROUP BY 1),
b AS (SELECT rule_id, count(*) FILTER (status <> 'rejected') AS am FROM d GROUP BY 1),
c AS (SELECT rule_id, count(*) AS m, count(*) FILTER (q >= 0.5) AS s FROM o GROUP BY 1)
SELECT recs.id, round(confidence * (0.5 + 0.5 * am / n + 0.5 * s / m), 6) AS adjusted_confidence
FROM recs JOIN a USING (rule_id) JOIN b USING (rule_id) JOIN c USING (rule_id)""")
def _(spark, sf):
    r, d, o = trail(spark, sf)
    out = dec.adjust_confidence(r, dec.track_record(r, d, o))
    return out.select("id", r6("adjusted_confidence").alias("adjusted_confidence"))


@query("consensus_summary", f"""WITH {TRACK_SQL}, a AS (SELECT scenario, count(*) AS n FROM recs GROUP BY 1),
b AS (SELECT scenario, count(*) FILTER (status <> 'rejected') AS am FROM d GROUP BY 1),
c AS (SELECT scenario, avg(q) AS mq FROM o GROUP BY 1)
SELECT scenario, n AS recommendations, round(am / n, 6) AS acceptance_incl_auto, round(mq, 6) AS mean_quality
FROM a JOIN b USING (scenario) JOIN c USING (scenario)""")
def _(spark, sf):
    r, d, o = trail(spark, sf)
    counts = reports.decision_counts(r, d, d, o, ["scenario"])
    s = reports.consensus_summary(counts, o, ["scenario"])
    return s.select("scenario", "recommendations", r6("acceptance_incl_auto").alias("acceptance_incl_auto"),
                    r6("mean_quality").alias("mean_quality"))


METRIC_SQL = """round(avg(abs(a - p)), 6) AS mae, round(sqrt(avg((a - p) * (a - p))), 6) AS rmse,
 round(CASE WHEN var_pop(a) * count(a) > 0 THEN 1 - sum((a - p) * (a - p)) / (var_pop(a) * count(a)) ELSE 0 END, 6) AS r2,
 round(avg(a - p), 6) AS bias, round(max(abs(a - p)), 6) AS max_error"""
METRIC_COLS = ["mae", "rmse", "r2", "bias", "max_error"]


@query("regression_metrics", f"""WITH x AS (SELECT l_returnflag AS k, l_extendedprice AS a, l_quantity * 1500.0 AS p FROM lineitem)
SELECT k, count(*) AS n, {METRIC_SQL} FROM x GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("a"),
                                            (F.col("l_quantity") * 1500.0).alias("p"))
    return reports.regression_metrics(d, ["k"], "a", "p").select("k", "n", *[r6(c).alias(c) for c in METRIC_COLS])


@query("metrics_per_scenario", f"""WITH x AS (SELECT l_linestatus AS scenario, l_extendedprice AS a, l_quantity * 1500.0 AS p,
 l_discount AS s FROM lineitem)
SELECT scenario, count(*) AS n, {METRIC_SQL}, round(avg(s), 6) AS mean_std, round(quantile_cont(s, 0.95), 6) AS p95_std FROM x GROUP BY 1""")
def _(spark, sf):
    from ..operators.quantiles import exact_quantiles
    d = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("scenario"), F.col("l_extendedprice").alias("a"),
                                            (F.col("l_quantity") * 1500.0).alias("p"), F.col("l_discount").alias("s"))
    m = reports.regression_metrics(d, ["scenario"], "a", "p")
    q = exact_quantiles(d, ["scenario"], "s", [0.95]).join(
        d.groupBy("scenario").agg(F.avg("s").alias("mean_std")), "scenario")
    return m.join(q, "scenario").select("scenario", "n", *[r6(c).alias(c) for c in METRIC_COLS],
                                        r6("mean_std").alias("mean_std"), r6(F.col("quantiles")[0]).alias("p95_std"))


@query("metric_collapse", """WITH x AS (SELECT l_returnflag AS k, l_linestatus AS t, avg(abs(l_extendedprice - l_quantity * 1500.0)) AS mae
 FROM lineitem GROUP BY ALL) SELECT round(avg(mae), 6) AS mae_overall, round(max(mae), 6) AS mae_worst FROM x""")
def _(spark, sf):
    from ..operators.learn import collapse_metrics
    d = table(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1500.0)
    m = reports.regression_metrics(d, ["l_returnflag", "l_linestatus"], "l_extendedprice", "p")
    return collapse_metrics(m).select(r6("mae_overall").alias("mae_overall"), r6("mae_worst").alias("mae_worst"))


@query("promotion_rule", """WITH m AS (SELECT l_suppkey AS model, avg(abs(l_extendedprice - 1500 * l_quantity)) FILTER (l_linestatus = 'F') AS base,
 avg(abs(l_extendedprice - 1500 * l_quantity)) FILTER (l_linestatus = 'O') AS new FROM lineitem GROUP BY 1)
SELECT model, new IS NULL OR base IS NULL OR new < base * (1 - 0.02) AS promoted FROM m""")
def _(spark, sf):
    from ..operators.learn import should_promote
    e = F.abs(F.col("l_extendedprice") - 1500 * F.col("l_quantity"))
    d = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(
        F.avg(F.when(F.col("l_linestatus") == "F", e)).alias("base"), F.avg(F.when(F.col("l_linestatus") == "O", e)).alias("new"))
    return d.select("model", should_promote(F.col("new"), F.col("base"), 0.02).alias("promoted"))


@query("counters", f"""WITH {RECS_SQL} SELECT rule_id, urgency, scenario, count(*) AS n FROM recs GROUP BY ALL""")
def _(spark, sf):
    return reports.counters(recs(spark, sf), ["rule_id", "urgency", "scenario"])


@query("buffer_summary", """SELECT user_id, count(DISTINCT ts) AS n_samples, count(DISTINCT event_type) AS n_tags,
 epoch_us(min(ts)) AS oldest_us, epoch_us(max(ts)) AS newest_us FROM events GROUP BY 1""")
def _(spark, sf):
    d = reports.buffer_summary(user_readings(spark, sf), ["asset"])
    return d.select(F.col("asset").cast("long").alias("user_id"), "n_samples", "n_tags", us("oldest").alias("oldest_us"),
                    us("newest").alias("newest_us"))


@query("steady_state_means", f"""WITH {READINGS_SQL}, x AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY tag ORDER BY us DESC) <= 200)
SELECT tag, round(avg(value), 6) AS value FROM x GROUP BY 1""")
def _(spark, sf):
    d = history.steady_state_means(readings(spark, sf), ["value"], ["tag"])
    return d.select("tag", r6("value").alias("value"))


@query("tag_ranges", """SELECT user_id, event_type AS tag, min(value) AS min, max(value) AS max FROM events
WHERE event_type IN ('click', 'error') GROUP BY ALL""")
def _(spark, sf):
    d = reports.tag_ranges(user_readings(spark, sf), ["asset"], ["click", "error"])
    return d.select(F.col("asset").cast("long").alias("user_id"), "tag", "min", "max")


@query("expected_rule_latency", f"""WITH {RECS_SQL}, g AS (SELECT scenario, TIMESTAMP '1995-02-01' AS ev, unnest(['R0', 'R3', 'R9']) AS rule_id
 FROM (SELECT DISTINCT scenario FROM recs)), f AS (SELECT scenario, rule_id, min(us) AS first FROM recs GROUP BY ALL)
SELECT g.scenario, g.rule_id, round((first - epoch_us(ev)) / 60e6, 6) AS minutes FROM g LEFT JOIN f USING (scenario, rule_id)""")
def _(spark, sf):
    r = recs(spark, sf)
    known = r.select("scenario").distinct().select("scenario", ts_lit("1995-02-01").alias("event_ts"), F.array(
        *[F.lit(x) for x in ("R0", "R3", "R9")]).alias("expected_rules"))
    d = reports.time_to_first_recommendation(r, known, ["scenario"])
    return d.select("scenario", "rule_id", r6("minutes").alias("minutes"))


@query("detected_rules", f"""WITH {RECS_SQL} SELECT scenario, string_agg(rule_id, ', ' ORDER BY rule_id) AS rules
FROM (SELECT DISTINCT scenario, rule_id FROM recs) GROUP BY 1""")
def _(spark, sf):
    return reports.detected_rules(recs(spark, sf), ["scenario"])


@query("first_actionable", f"""WITH {RECS_SQL} SELECT rule_id, count(*) AS n_recs,
 round((min(us) FILTER (urgency <> 'low') - epoch_us(TIMESTAMP '1995-01-01')) / 3600e6, 6) AS ttfr_h FROM recs GROUP BY 1""")
def _(spark, sf):
    r = recs(spark, sf)
    starts = r.select("rule_id").distinct().withColumn("t_start", ts_lit("1995-01-01"))
    d = reports.actionable(r, starts, ["rule_id"])
    return d.select("rule_id", "n_recs", r6("ttfr_h").alias("ttfr_h"))


@query("scaler", """SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity__mean, round(stddev_pop(l_quantity), 6) AS l_quantity__std,
 round(avg(l_tax * 0), 6) AS flat__mean, 1.0::DOUBLE AS flat__std FROM lineitem GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("flat", F.col("l_tax") * 0)
    s = scaler(d, ["l_quantity", "flat"], ["l_returnflag"])
    return s.select("l_returnflag", *[r6(c).alias(c) for c in s.columns if c != "l_returnflag"])


@query("first_per_rule", f"""WITH {RECS_SQL} SELECT scenario, rule_id, arg_min(id, (us, id)) AS id, min(us) AS ts_us FROM recs GROUP BY ALL""")
def _(spark, sf):
    from ..operators.sessions import first_per_rule
    return first_per_rule(recs(spark, sf)).select("scenario", "rule_id", "id", us("ts").alias("ts_us"))


def numbered(ordered):
    """Rows of a globally sorted frame with their place: offsets of partitions plus the place inside."""
    from pyspark.sql import Window

    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(ordered.sparkSession)
    d = ordered.withColumn("_part", F.spark_partition_id()).withColumn(
        "_in", F.monotonically_increasing_id() % F.lit(1 << 33)).checkpoint()
    sizes = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(sizes.select("_part", start.alias("_start")), "_part").withColumn(
        "place", F.col("_start") + F.col("_in") + 1).drop("_part", "_in", "_start")


@query("recommendation_order", f"""WITH {RECS_SQL}, p AS (SELECT id, us AS ts_us, round(CASE urgency WHEN 'critical' THEN 90.0 WHEN 'high' THEN 70.0
 WHEN 'medium' THEN 50.0 ELSE 25.0 END + 10 * confidence, 6) AS priority FROM recs), n AS (SELECT *, row_number() OVER (ORDER BY ts_us, priority DESC, id) AS place FROM p)
SELECT id, ts_us, priority, place FROM n""")
def _(spark, sf):
    from ..functions.ladders import priority_score
    from ..operators.rules import in_report_order
    d = recs(spark, sf).withColumn("priority", F.round(priority_score(F.col("urgency"), F.col("confidence")), 6))
    return numbered(in_report_order(d)).select("id", us("ts").alias("ts_us"), "priority", "place")


@query("set_operations", """SELECT 'both' AS kind, count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT
 SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT 'only_a', count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT
 SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    a, b = l.filter("l_returnflag = 'A'").select("l_orderkey"), l.filter("l_returnflag = 'R'").select("l_orderkey")
    n = F.count(F.lit(1)).alias("n")
    return a.intersect(b).agg(n).select(F.lit("both").alias("kind"), "n").unionByName(
        a.distinct().join(b, "l_orderkey", "left_anti").agg(n).select(F.lit("only_a").alias("kind"), "n"))


@query("time_text", """SELECT o_orderkey AS id, strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%S') AS iso,
 round((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01')) / 60e6, 6) AS minutes FROM orders""")
def _(spark, sf):
    from ..functions.times import plus_minutes
    r = recs(spark, sf)
    return r.select("id", F.date_format(plus_minutes(F.col("ts"), F.lit(90.0)), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
                    r6(minutes_between(F.col("ts"), ts_lit("1995-01-01"))).alias("minutes"))
