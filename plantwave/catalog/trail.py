"""Rules, decisions, outcomes, physics and operating points over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import faults, objectives, physics
from ..functions.times import hours_between
from ..model import ACTION_DDL, IMPACT_DDL, dim_tag, physical_name
from ..operators import decisions as dec
from ..operators import pareto, rules
from ..operators.scale import checked_broadcast, chunk_seconds_for
from .registry import DEC_TIE, READINGS_SQL, decisions, query, r6, readings, table, us, user_readings

# --- decision cascade -------------------------------------------------------------

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
KEY_SQL = ", ".join(KEY)


def action_recs(spark, sf):
    """`lineitem` rows as setpoint recommendations."""
    n = F.col("l_linenumber") % 4
    target = F.when(n == 0, "column.RR").when(n == 1, "cstr.F_cool").when(n == 2, "cstr.F_feed")
    current = F.when(n == 0, F.col("l_quantity") / 6).when(n == 1, F.col("l_quantity") / 60).otherwise(F.col("l_quantity") / 16)
    adj = F.round((F.col("l_discount") - 0.05) * current, 6)
    kind = F.when(F.col("l_returnflag") == "N", "investigate").otherwise("adjust_setpoint")
    act = F.struct(kind.alias("type"), F.lit("").alias("description"), target.alias("target_variable"),
                   current.alias("current_value"), F.when(target.isNotNull(), current + adj).alias("proposed_value"),
                   adj.alias("adjustment"), F.lit("").alias("units")).cast(ACTION_DDL)
    return table(spark, sf, "lineitem").select(
        *KEY, F.concat_ws("|", *KEY).alias("id"), F.lit("plant").alias("asset"), F.lit("live").alias("scenario"),
        F.lit("R").alias("rule_id"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when(F.col("l_linestatus") == "F", "low").when(F.col("l_tax") > 0.06, "critical").otherwise("medium").alias("urgency"),
        (0.8 + F.col("l_tax")).alias("confidence"), act.alias("action"))


ACTIONS_SQL = f"""x AS (SELECT {KEY_SQL}, l_linenumber % 4 AS n, CASE l_linenumber % 4 WHEN 0 THEN l_quantity / 6 WHEN 1 THEN l_quantity / 60
  ELSE l_quantity / 16 END AS cur, CASE WHEN l_returnflag = 'N' THEN 'investigate' ELSE 'adjust_setpoint' END AS kind,
 CASE WHEN l_linestatus = 'F' THEN 'low' WHEN l_tax > 0.06 THEN 'critical' ELSE 'medium' END AS urgency, 0.8 + l_tax AS confidence, l_discount FROM lineitem),
a AS (SELECT *, round((l_discount - 0.05) * cur, 6) AS adj, CASE WHEN n < 3 THEN cur + round((l_discount - 0.05) * cur, 6) END AS prop FROM x),
g AS (SELECT *, NOT coalesce(CASE n WHEN 0 THEN prop < 2.5 OR prop > 8 WHEN 1 THEN prop < 0.05 OR prop > 0.8 WHEN 2 THEN prop < 1.5 OR prop > 3 END, false) AS safe,
 kind = 'adjust_setpoint' AND n < 3 AS automated,
 urgency = 'low' AND kind = 'adjust_setpoint' AND n = 0 AND confidence >= 0.85 AND coalesce(abs(adj / nullif(cur, 0)) <= 0.1, true) AS auto FROM a)"""


@query("safety_gate", f"WITH {ACTIONS_SQL} SELECT {KEY_SQL}, safe FROM g")
def _(spark, sf):
    return dec.within_safety(action_recs(spark, sf), dim_tag(spark)).select(*KEY, "safe")


@query("decision_cascade", f"""WITH {ACTIONS_SQL} SELECT {KEY_SQL}, CASE WHEN NOT safe THEN 'rejected' WHEN automated AND abs(adj) < 1e-3 THEN 'rejected'
 WHEN auto THEN 'auto_executed' WHEN urgency = 'critical' THEN 'accepted' ELSE 'rejected' END AS status,
 CASE WHEN NOT safe THEN 'system_safety' WHEN automated AND abs(adj) < 1e-3 THEN 'system_filter' WHEN auto THEN 'system_autonomous'
 ELSE 'operator_conservative' END AS operator_id FROM g""")
def _(spark, sf):
    r = action_recs(spark, sf)
    d = dec.decide(r, dim_tag(spark), "autonomous_supervised", dec.accept_critical())
    parts = F.split("recommendation_id", r"\|")
    return d.select(*[parts[i].cast("double" if k == "l_extendedprice" else "int" if k == "l_linenumber" else "long").alias(k)
                      for i, k in enumerate(KEY)], "status", "operator_id")


@query("dampened_policy", f"""WITH {ACTIONS_SQL} SELECT {KEY_SQL}, CASE WHEN NOT safe OR (automated AND abs(adj) < 1e-3) THEN 'rejected' ELSE 'modified' END AS status,
 round(CASE WHEN NOT safe OR (automated AND abs(adj) < 1e-3) THEN NULL WHEN automated THEN cur + adj * 0.7 ELSE prop END, 6) AS proposed FROM g""")
def _(spark, sf):
    d = dec.decide(action_recs(spark, sf), dim_tag(spark), "semi_autonomous", dec.accept_reduced())
    parts = F.split("recommendation_id", r"\|")
    return d.select(*[parts[i].cast("double" if k == "l_extendedprice" else "int" if k == "l_linenumber" else "long").alias(k)
                      for i, k in enumerate(KEY)], "status", r6("actual_action.proposed_value").alias("proposed"))


@query("execution_records", f"""WITH {ACTIONS_SQL}, d AS (SELECT *, CASE WHEN NOT safe OR (automated AND abs(adj) < 1e-3) THEN 'rejected' WHEN auto THEN 'auto_executed' ELSE 'accepted' END AS status FROM g)
SELECT CASE WHEN automated THEN 'success' ELSE 'not_required' END AS status, CASE WHEN NOT automated THEN 'operator_aggressive'
 WHEN status = 'auto_executed' THEN 'system_autonomous' ELSE 'system_semi_auto' END AS executor, count(*) AS n FROM d WHERE status <> 'rejected' GROUP BY ALL""")
def _(spark, sf):
    d = dec.decide(action_recs(spark, sf), dim_tag(spark), "autonomous_supervised", dec.accept_all())
    return dec.execute(d, "autonomous_supervised").groupBy("status", "executor").agg(F.count(F.lit(1)).alias("n"))


# --- outcomes ---------------------------------------------------------------------

def impacts():
    def one(var, pred, minutes):
        return F.struct(F.lit(var).alias("variable"), F.lit(None).cast("double").alias("current_value"),
                        F.lit(pred).cast("double").alias("predicted_value"),
                        F.lit(minutes).cast("double").alias("time_to_effect_minutes"), F.lit("").alias("description"))
    return F.array(one("purchase", 50.0, 600.0), one("click", None, 0.0), one("view", 40.0, 2880.0)).cast(f"array<{IMPACT_DDL}>")


def error_recs(spark, sf):
    """Every error event as an executed recommendation with three predicted impacts."""
    e = user_readings(spark, sf).filter("tag = 'error'")
    return e.select(F.concat_ws("|", "asset", F.unix_micros("ts")).alias("id"), "asset", "scenario", "ts",
                    F.lit("R").alias("rule_id"), F.lit("high").alias("urgency"), "value", impacts().alias("expected_impact"))


OUTCOME_SQL = f"""{READINGS_SQL}, i(tag, pred, d) AS (VALUES ('purchase', 50.0, 600), ('click', NULL, 30), ('view', 40.0, 2880)),
l AS (SELECT user_id, max(us) AS last FROM r GROUP BY 1),
p AS (SELECT e.user_id, e.us AS exec_us, e.value AS ev, i.tag, i.pred, e.us + i.d * 60000000::BIGINT AS us FROM r e JOIN l USING (user_id), i
 WHERE e.tag = 'error' AND e.us + i.d * 60000000::BIGINT <= l.last),
lo AS (SELECT p.*, q.us AS lus, q.value AS lv FROM p ASOF LEFT JOIN r q ON p.user_id = q.user_id AND p.tag = q.tag AND p.us >= q.us),
hi AS (SELECT lo.*, q.us AS hus, q.value AS hv FROM lo ASOF LEFT JOIN r q ON lo.user_id = q.user_id AND lo.tag = q.tag AND lo.us <= q.us),
m AS (SELECT user_id, exec_us, ev, tag, CASE WHEN hus IS NULL OR us - lus <= hus - us THEN lv ELSE hv END AS actual, pred FROM hi),
w AS (SELECT *, abs(actual - pred) / greatest(abs(pred), 1e-6) AS pct FROM m)"""
OUT_SQL = """SELECT user_id, exec_us AS ts_us, count(*) AS n_metrics, round(coalesce(count(*) FILTER (pct < 0.5) / nullif(count(pct), 0), 0.5), 6) AS quality,
 round(avg(pct), 6) AS mean_deviation_pct FROM w GROUP BY ALL"""


def outcome_rows(out):
    from ..sources.tables import outcomes_table
    parts = F.split("recommendation_id", r"\|")
    return outcomes_table(out).select(parts[0].cast("long").alias("user_id"), parts[1].cast("long").alias("ts_us"),
                                      F.col("n_metrics").cast("long").alias("n_metrics"), r6("quality_score").alias("quality"),
                                      r6("mean_deviation_pct").alias("mean_deviation_pct"))


@query("outcome_measurement", f"WITH {OUTCOME_SQL} {OUT_SQL}")
def _(spark, sf):
    r = error_recs(spark, sf)
    exe = r.select(F.col("id"), F.col("id").alias("decision_id"), F.col("id").alias("recommendation_id"), "asset", "scenario", "ts",
                   F.lit("success").alias("status"), F.lit("x").alias("executor"))
    rd = user_readings(spark, sf)
    return outcome_rows(dec.measure(exe, r, rd, seconds=chunk_seconds_for(rd, ["asset", "scenario", "tag"])))


@query("outcome_summary", f"""WITH {OUTCOME_SQL} SELECT user_id, exec_us AS ts_us, 'R' AS rule_id, 'high' AS urgency, exec_us + 2880 * 60000000::BIGINT AS measured_us,
 2880.0::DOUBLE AS delay, count(*) FILTER (pct < 0.5) || '/' || count(*) || ' metrics within tolerance' AS notes FROM w GROUP BY ALL""")
def _(spark, sf):
    r = error_recs(spark, sf)
    exe = r.select(F.col("id"), F.col("id").alias("decision_id"), F.col("id").alias("recommendation_id"), "asset", "scenario", "ts",
                   F.lit("success").alias("status"), F.lit("x").alias("executor"))
    rd = user_readings(spark, sf)
    d = dec.outcome_summary(dec.measure(exe, r, rd, seconds=chunk_seconds_for(rd, ["asset", "scenario", "tag"])), r)
    parts = F.split("recommendation_id", r"\|")
    return d.select(parts[0].cast("long").alias("user_id"), parts[1].cast("long").alias("ts_us"), "rule_id", "urgency",
                    us("measured_at").alias("measured_us"), F.col("measurement_delay_minutes").alias("delay"), "notes")


@query("override_outcomes", f"""WITH {OUTCOME_SQL}, w2 AS (SELECT * FROM w WHERE ev > 30 AND exec_us + 2880 * 60000000::BIGINT <= epoch_us(TIMESTAMP '2024-01-25'))
{OUT_SQL.replace('FROM w ', 'FROM w2 ')}""")
def _(spark, sf):
    r = error_recs(spark, sf)
    over = r.select(F.col("id").alias("recommendation_id"), F.col("ts").alias("decision_ts"),
                    F.when(F.col("value") > 30, "accepted").otherwise("rejected").alias("status"))
    none = r.select(F.col("id").alias("recommendation_id")).limit(0)
    due = dec.pending_measurements(over, r, none, F.lit("2024-01-25").cast("timestamp"))
    rd = user_readings(spark, sf)
    return outcome_rows(dec.measure(dec.override_executions(due), r, rd, seconds=chunk_seconds_for(rd, ["asset", "scenario", "tag"])))


@query("decision_ids", """SELECT count(*) AS n_decisions, count(*) AS n_ids FROM lineitem""")
def _(spark, sf):
    """As many ids as decisions, over all of them."""
    from ..functions.ids import stable_id
    d = decisions(spark, sf).select(stable_id("DEC", *[F.col(c) for c in DEC_TIE]).alias("id"))
    return d.agg(F.count(F.lit(1)).alias("n_decisions"), F.countDistinct("id").alias("n_ids"))


# --- rules ------------------------------------------------------------------------

def rule_context(spark, sf):
    """`orders` as session contexts: every column a rule can read is derived from the order."""
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    det = F.element_at(F.array(*[F.lit(d) for d in DETECTORS]), (c % 8 + 1).cast("int"))
    tag = F.when(c % 8 == 2, None).when(c % 7 == 3, "batch.conversion").otherwise(F.element_at(F.array(*[F.lit(t) for t in TAGS]), (k % 8 + 1).cast("int")))
    share = p / 500000.0
    value = F.when(k % 8 == 0, 78 + share * 6).when(k % 8 == 4, 250 + share * 80).otherwise(share * 10)
    sev = F.when(c % 4 == 0, "critical").when(c % 4 == 1, "high").when(c % 4 == 2, "medium").otherwise("low")
    extra = F.struct((c % 60).cast("double").alias("minutes_to_limit"), F.when(c % 2 == 0, "below").otherwise("above").alias("direction"),
                     (share * 3 - 1.5).alias("residual"), F.when(c % 9 != 0, share).alias("actual"), share.alias("predicted"),
                     (c % 45).cast("double").alias("horizon_minutes"))
    peak = F.struct(value.alias("value"), F.when(F.col("o_orderstatus") == "F", "below").otherwise("above").alias("side"),
                    F.lit(98.5).alias("lim"), (0.5 + (c % 50) / 100.0).alias("confidence"), extra.alias("extra"))
    cols = {"cstr.F_cool": 0.2 + (c % 40) / 100.0, "cstr.T_R_C": 78 + (c % 50) / 10.0, "cstr.C_A": 150.0 + c % 100,
            "column.purity_B": F.when(c % 29 != 0, 97 + (c % 31) / 10.0), "column.RR": 4 + (c % 35) / 10.0,
            "column.Q_reb_kW": 250.0 + c % 70, "batch.F_cool": F.when(c % 11 != 0, 0.5 + (c % 40) / 100.0),
            "batch.T_R_C": 80.0 + c % 30, "batch.conversion": (c % 100) / 100.0}
    return table(spark, sf, "orders").select(
        F.lit("plant").alias("asset"), F.concat(F.lit("S"), c % 25).alias("scenario"), F.lpad(k.cast("string"), 12, "0").alias("session_id"),
        F.col("o_orderdate").cast("timestamp").alias("start_ts"), det.alias("detector"), tag.alias("tag"), sev.alias("peak_severity"),
        (c % 40).alias("alert_count"), peak.alias("peak_alert"), (c % 3).alias("co_C_A"), (F.floor(k / 32) % 2).alias("co_purity"), (F.floor(k / 16) % 2).alias("co_T_R"),
        (c % 5).alias("co_F_cool_cusum"), (k % 3).alias("co_batch_T_R"), F.when(c % 10 == 0, 1.0).otherwise(0.0).alias("still"),
        (p / 1000).alias("v_own"), F.lit(98.5).alias("purity_spec"), *[v.alias("v_" + physical_name(t)) for t, v in cols.items()])


DETECTORS = ["SPC.EWMA", "SPC.Shewhart", "PCA.T2", "Regime.CUSUM", "Trend.Projection", "FrozenSensor", "SoftSensor.Divergence", "LSTM.Forecast"]
TAGS = ["cstr.T_R_C", "column.purity_B", "column.RR", "cstr.F_cool", "column.Q_reb_kW", "cstr.C_A", "batch.T_R_C", "batch.dHdt"]
CONTEXT_SQL = f"""x AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice / 500000.0 AS share, o_orderstatus AS st, epoch_us(o_orderdate) AS us,
 {DETECTORS!r}[o_custkey % 8 + 1] AS det, CASE WHEN o_custkey % 8 = 2 THEN NULL WHEN o_custkey % 7 = 3 THEN 'batch.conversion' ELSE {TAGS!r}[o_orderkey % 8 + 1] END AS tag FROM orders),
y AS (SELECT *, CASE k % 8 WHEN 0 THEN 78 + share * 6 WHEN 4 THEN 250 + share * 80 ELSE share * 10 END AS peak, CASE WHEN st = 'F' THEN 'below' ELSE 'above' END AS side,
 ['critical', 'high', 'medium', 'low'][c % 4 + 1] AS sev, CASE WHEN c % 2 = 0 THEN 'below' ELSE 'above' END AS dir, 0.2 + (c % 40) / 100.0::DOUBLE AS fc, 78 + (c % 50) / 10.0::DOUBLE AS tr,
 CASE WHEN c % 29 <> 0 THEN 97 + (c % 31) / 10.0::DOUBLE END AS pu, 4 + (c % 35) / 10.0::DOUBLE AS rr, CASE WHEN c % 11 <> 0 THEN 0.5 + (c % 40) / 100.0::DOUBLE END AS bf,
 80.0 + c % 30 AS bt, (c % 100) / 100.0::DOUBLE AS bx, det IN ('SPC.EWMA', 'SPC.Shewhart') AS spc FROM x)"""
PILOT_SQL = f"""{CONTEXT_SQL}, f AS (
SELECT *, 'R01_ThermalDrift' AS rule_id, CASE WHEN peak > 82 THEN 'high' WHEN peak > 80.5 THEN 'medium' ELSE 'low' END AS urgency, CASE WHEN c % 40 > 20 THEN 0.85 ELSE 0.7 END AS conf,
 least(fc * 1.15, 0.6) AS prop, 2 AS n_imp FROM y WHERE spc AND tag = 'cstr.T_R_C' AND peak >= 79.8 AND side <> 'below'
UNION ALL SELECT *, 'R02_FeedComposition', CASE WHEN pu < 97.5 THEN 'high' ELSE 'medium' END, 0.8, CASE WHEN pu < 98.5 THEN least(rr + 0.3, 7.0) END, CASE WHEN pu < 98.5 THEN 2 ELSE 0 END
 FROM y WHERE det = 'PCA.T2' AND c % 3 > 0 AND (k // 32) % 2 > 0 AND pu < 99.0
UNION ALL SELECT *, 'R03_ControllerOscillation', 'medium', 0.8, NULL, 2 FROM y WHERE det = 'Regime.CUSUM' AND tag = 'cstr.F_cool' AND c % 5 >= 3
UNION ALL SELECT *, 'R04_ColumnEfficiencyLoss', CASE WHEN pu < 97.5 THEN 'high' WHEN pu < 98.5 THEN 'medium' ELSE 'low' END, 0.75, least(rr + 0.4, 7.0), 1
 FROM y WHERE spc AND tag = 'column.purity_B' AND (k // 16) % 2 = 0 AND c % 3 = 0 AND pu IS NOT NULL
UNION ALL SELECT *, 'R05_ExcessReflux', 'low', 0.9, greatest(rr - 0.3, 4.0), 2 FROM y WHERE det = 'SPC.EWMA' AND tag = 'column.Q_reb_kW' AND side <> 'below' AND peak > 290 AND pu > 99.3
UNION ALL SELECT *, 'R06_PurityDeviation', CASE WHEN c % 60 < 15 THEN 'critical' WHEN c % 60 < 30 THEN 'high' ELSE 'medium' END, least(0.95, 0.5 + (c % 50) / 100.0::DOUBLE + 0.1), least(rr + 0.25, 7.0), 1
 FROM y WHERE det = 'Trend.Projection' AND tag = 'column.purity_B' AND pu IS NOT NULL
UNION ALL SELECT *, 'R07_SensorFault', 'high', 0.95, NULL, 1 FROM y WHERE tag IS NOT NULL AND tag NOT IN ('column.RR', 'cstr.F_cool') AND (det = 'FrozenSensor' OR c % 10 = 0)
UNION ALL SELECT *, 'R08_ProductTransition', 'low', 0.85, NULL, 1 FROM y WHERE det = 'Regime.CUSUM' AND tag = 'column.RR' AND pu IS NOT NULL
UNION ALL SELECT *, 'R09_SoftSensorDivergence', CASE WHEN abs(share * 3 - 1.5) > 1 THEN 'medium' ELSE 'low' END, 0.7, NULL, 1 FROM y WHERE det = 'SoftSensor.Divergence' AND c % 9 <> 0
UNION ALL SELECT *, 'R10_PredictedExcursion', CASE WHEN c % 45 <= 10 THEN 'high' WHEN c % 45 <= 30 THEN 'medium' ELSE 'low' END, 0.75, NULL, 1 FROM y WHERE det = 'LSTM.Forecast' AND c % 9 <> 0)"""
BATCH_SQL = f"""{CONTEXT_SQL}, f AS (
SELECT *, 'B01_HighReactorTemp' AS rule_id, sev AS urgency, 0.85 AS conf, least(bf * 1.3, 1.0) AS prop, 2 AS n_imp FROM y WHERE tag = 'batch.T_R_C' AND sev IN ('high', 'critical') AND bf IS NOT NULL
UNION ALL SELECT *, 'B02_RunawayRisk', 'critical', 0.9, 1.0, 1 FROM y WHERE tag = 'batch.dHdt' AND sev IN ('high', 'critical') AND k % 3 > 0 AND bf IS NOT NULL
UNION ALL SELECT *, 'B03_LowConversion', 'medium', 0.7, NULL, 0 FROM y WHERE tag = 'batch.conversion' AND sev IN ('medium', 'high', 'critical'))"""
FIRED_SQL = """ SELECT k AS id, rule_id, urgency, round(conf, 6) AS confidence, round(CASE urgency WHEN 'critical' THEN 90 WHEN 'high' THEN 70 WHEN 'medium' THEN 50 ELSE 25 END + 10 * conf, 6) AS priority,
 round(prop, 6) AS proposed, n_imp AS n_impacts FROM f QUALIFY row_number() OVER (PARTITION BY c % 25, rule_id, coalesce(tag, 'multi'), us ORDER BY k) = 1"""


def fired(spark, sf, pack):
    ctx = rule_context(spark, sf)
    sec = chunk_seconds_for(ctx, ["asset", "scenario", "detector"], "start_ts", at_least=7200)
    d = rules.recommend(ctx, pack, seconds=sec)
    return d.select(F.col("triggering_sessions")[0].cast("long").alias("id"), "rule_id", "urgency", r6("confidence").alias("confidence"),
                    r6("priority").alias("priority"), r6("action.proposed_value").alias("proposed"),
                    F.size("expected_impact").cast("long").alias("n_impacts"))


@query("rules_pilot", f"WITH {PILOT_SQL}{FIRED_SQL}")
def _(spark, sf):
    return fired(spark, sf, rules.PILOT_RULES)


@query("rules_batch", f"WITH {BATCH_SQL}{FIRED_SQL}")
def _(spark, sf):
    return fired(spark, sf, rules.BATCH_RULES)


# --- the whole run ----------------------------------------------------------------

def plant_readings(spark, sf):
    """`events` scaled into the ranges of five process tags, ten assets."""
    v = F.col("value")
    tag = {"click": ("cstr.T_R_C", 78 + v / 40), "view": ("column.purity_B", 100 - v / 40), "purchase": ("column.RR", 5 + v / 100),
           "error": ("cstr.F_cool", 0.2 + v / 1000), "signup": ("column.Q_reb_kW", 240 + v)}
    name, val = F.lit(None).cast("string"), F.lit(None).cast("double")
    for t, (n, e) in tag.items():
        name, val = F.when(F.col("event_type") == t, n).otherwise(name), F.when(F.col("event_type") == t, e).otherwise(val)
    return table(spark, sf, "events").select((F.col("user_id") % 10).cast("string").alias("asset"), F.lit("live").alias("scenario"),
                                             F.col("ts").cast("timestamp").alias("ts"), name.alias("tag"), val.alias("value"))


@query("monitoring_run")
def _(spark, sf):
    from ..plans.monitoring import Settings, monitor
    run = monitor(plant_readings(spark, sf), dim_tag(spark), Settings(period_s=600.0, gap_minutes=720.0), policy=dec.accept_all())
    n = F.count(F.lit(1)).alias("n")
    return (run.alerts.groupBy(F.lit("alert").alias("kind"), F.col("detector").alias("item")).agg(n)
            .unionByName(run.sessions.groupBy(F.lit("session").alias("kind"), F.col("detector").alias("item")).agg(n))
            .unionByName(run.recommendations.groupBy(F.lit("recommendation").alias("kind"), F.col("rule_id").alias("item")).agg(n))
            .unionByName(run.decisions.groupBy(F.lit("decision").alias("kind"), F.col("status").alias("item")).agg(n))
            .unionByName(run.outcomes.groupBy(F.lit("outcome").alias("kind"), F.round("quality_score", 2).cast("string").alias("item")).agg(n)))


# --- physics and what-if ----------------------------------------------------------

@query("physics_columns", """WITH s AS (SELECT l_suppkey, 340 + avg(l_quantity) AS t, 330 + avg(l_quantity) AS tj, 100 + avg(l_extendedprice) / 1000 AS ca, 2 + avg(l_tax) AS f,
 0.9 + avg(l_discount) AS xd, 0.01 + avg(l_tax) AS xb FROM lineitem GROUP BY 1),
d AS (SELECT *, 7.2e10 * exp(-8750 / t) * (10.0 / (f / 60.0)) AS da, 2000.0 * 7.2e10 * exp(-8750 / t) * ca * 10.0 AS made FROM s)
SELECT l_suppkey, round(da / 1e3, 6) AS da, round(da / (1 + da), 6) AS conversion, round(2000.0 * ca / (800.0 * 2.0), 6) AS rise,
 round((made - (f / 60.0 * 800.0 * 2.0 * (t - 343.0) + 5e4 * (t - tj))) / made, 6) AS residual, round(exp(-8750 * (1 / (t + 10) - 1 / t)), 6) AS arrhenius,
 round(2.2 * xb / (1 + 1.2 * xb), 6) AS vapour, round(CASE WHEN xd < 1 THEN ln(xd / (1 - xd) * ((1 - xb) / xb)) / ln(2.2) END, 6) AS stages,
 round(least(greatest((0.2 - xb) / (xd - xb), 0.05), 0.95), 6) AS d_over_f, round(abs(0.2 - (0.2 * xd + 0.8 * xb)), 6) AS balance FROM d""")
def _(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        (340 + F.avg("l_quantity")).alias("t"), (330 + F.avg("l_quantity")).alias("tj"), (100 + F.avg("l_extendedprice") / 1000).alias("ca"),
        (2 + F.avg("l_tax")).alias("f"), (0.9 + F.avg("l_discount")).alias("xd"), (0.01 + F.avg("l_tax")).alias("xb"))
    t, tj, ca, f, xd, xb = (F.col(c) for c in ("t", "tj", "ca", "f", "xd", "xb"))
    da = physics.damkohler(7.2e10, 8750.0, t, 10.0, f)
    return s.select(
        "l_suppkey", r6(da / 1e3).alias("da"), r6(physics.conversion_from_damkohler(da)).alias("conversion"),
        r6(physics.adiabatic_rise(-2000.0, ca, 800.0, 2.0)).alias("rise"),
        r6(physics.energy_residual(ca, t, tj, f, k0=7.2e10, ea_over_r=8750.0, heat=-2000.0, volume=10.0, density=800.0,
                                   heat_capacity=2.0, t_feed=343.0, ua=5e4)).alias("residual"),
        r6(physics.arrhenius_ratio(8750.0, t, t + 10)).alias("arrhenius"), r6(physics.vapour_fraction(xb, 2.2)).alias("vapour"),
        r6(physics.fenske_stages(xd, xb, 2.2)).alias("stages"), r6(physics.distillate_fraction(F.lit(0.2), xd, xb)).alias("d_over_f"),
        r6(physics.balance_error(F.lit(0.2), xd, xb, F.lit(0.2))).alias("balance"))


POINTS_SQL = """pt AS (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, 3 + l_quantity / 12 AS rr, 1.7 + l_tax * 5 AS feed, 0.6 + l_discount * 3 AS x, 77 + l_tax * 50 AS t FROM lineitem),
e AS (SELECT *, greatest(least(x, 0.99), 0.01) AS zb FROM pt),
e2 AS (SELECT *, greatest((1 / 1.2) * (0.95 / zb - 2.2 * 0.05 / greatest(1 - zb, 0.01)), 0.5) AS rmin FROM e),
e3 AS (SELECT *, greatest(0.75 - 0.75 * pow(greatest((rr - rmin) / (rr + 1), 0), 0.5668), 0.001) AS yy FROM e2),
e4 AS (SELECT *, greatest(10 * (1 - yy) - yy, 1) AS nmin FROM e3),
o AS (SELECT *, greatest(least((1 - least((0.95 / (1 - 0.95)) / pow(2.2, nmin), 0.5)) * 100, 99.95), 50.0) AS pur, (rr + 1) * (feed * 8000 * (1 - zb) / 0.95) * 35000 / 3600 / 1000 AS q FROM e4)"""


@query("operating_point_objectives", f"""WITH {POINTS_SQL} SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice,
 round(CASE WHEN pur < 98.5 THEN pur - 10 * (98.5 - pur) ELSE pur END, 4) AS purity, round(q, 4) AS energy, round(feed * x * 8, 6) AS production, round(abs(t - 79.2), 6) AS stability FROM o""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice",
                                            (3 + F.col("l_quantity") / 12).alias("rr"), (1.7 + F.col("l_tax") * 5).alias("feed"),
                                            (0.6 + F.col("l_discount") * 3).alias("x"), (77 + F.col("l_tax") * 50).alias("t"))
    pur, q = physics.column_estimate(F.col("rr"), F.col("feed"), F.col("x"))
    o = objectives.with_objectives(d, pur, q, F.col("feed"), F.col("x"), F.col("t"))
    return o.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", F.round("purity", 4).alias("purity"),
                    F.round("energy", 4).alias("energy"), r6("production").alias("production"), r6("stability").alias("stability"))


@query("fault_injection", f"""WITH {READINGS_SQL}, x AS (SELECT tag, us, value, (us - min(us) OVER (PARTITION BY tag)) / 3600e6 AS h, first_value(value) OVER (PARTITION BY tag ORDER BY us) AS v0 FROM r)
SELECT tag, us AS ts_us, CASE WHEN h >= 100 THEN 42.0 ELSE value END AS frozen, round(least(CASE WHEN h >= 100 THEN value + 0.15 * (h - 100) ELSE value END, 300), 6) AS drifted,
 round(CASE WHEN h >= 100 THEN value + 0.05 * v0 ELSE value END, 6) AS biased, round(CASE WHEN h >= 100 THEN value * (1 + 0.01 * (h - 100)) ELSE value END, 6) AS scaled FROM x""")
def _(spark, sf):
    r = readings(spark, sf)
    first = r.groupBy("tag").agg(F.min("ts").alias("t0"), F.min_by("value", "ts").alias("v0"))
    d = r.join(checked_broadcast(first), "tag")
    h, v = hours_between(F.col("ts"), F.col("t0")), F.col("value")
    return d.select("tag", us("ts").alias("ts_us"), faults.freeze(v, h, 100, 42.0).alias("frozen"), r6(faults.drift(v, h, 100, 0.15, 300)).alias("drifted"),
                    r6(faults.bias(v, h, 100, F.col("v0"))).alias("biased"), r6(faults.relative_drift(v, h, 100)).alias("scaled"))


@query("noise_injection")
def _(spark, sf):
    r = readings(spark, sf)
    return r.select("tag", us("ts").alias("ts_us"), faults.noise(F.col("value"), F.lit(1.0), 0.0, F.concat_ws("|", "tag", "ts")).alias("noisy"))


# --- operating points -------------------------------------------------------------

OBJ = [("spend", "maximize"), ("n_orders", "minimize"), ("urgent", "minimize")]
OBJ_W = [("spend", "maximize", 1.0, 0.0, 3_000_000.0), ("n_orders", "minimize", 1.0, 0.0, 20.0), ("urgent", "minimize", 0.5, 0.0, 5.0)]
CUST_SQL = """c AS MATERIALIZED (SELECT o_custkey AS id, sum(o_totalprice) AS spend, count(*)::DOUBLE AS n_orders, (count(*) FILTER (o_orderpriority = '1-URGENT'))::DOUBLE AS urgent FROM orders GROUP BY 1)"""
DOM = "b.spend >= a.spend AND b.n_orders <= a.n_orders AND b.urgent <= a.urgent AND (b.spend > a.spend OR b.n_orders < a.n_orders OR b.urgent < a.urgent)"


def customers(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"))


@query("pareto_front", f"WITH {CUST_SQL} SELECT id, n_orders, urgent FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE {DOM})")
def _(spark, sf):
    return pareto.pareto_front(customers(spark, sf), OBJ).select("id", "n_orders", "urgent")


RANK_SQL = f"""{CUST_SQL}, lv AS (SELECT 0 AS rank, * FROM c
 UNION ALL SELECT a.rank + 1, a.id, a.spend, a.n_orders, a.urgent FROM lv a WHERE EXISTS (SELECT 1 FROM lv b WHERE {DOM})),
rk AS (SELECT max(rank) AS rank, id, spend, n_orders, urgent FROM lv GROUP BY ALL)"""


@query("pareto_ranks", f"WITH RECURSIVE {RANK_SQL} SELECT id, rank FROM rk")
def _(spark, sf):
    return pareto.pareto_ranks(customers(spark, sf), OBJ, "id").select("id", "rank")


@query("pareto_ranks_all", f"WITH RECURSIVE {RANK_SQL} SELECT id, rank FROM rk")
def _(spark, sf):
    """The same ranks in many small slices, each behind the staircases of those before it."""
    return pareto.pareto_ranks(customers(spark, sf), OBJ, "id", slice_rows=300).select("id", "rank")


def _axis(col):
    return f"""SELECT rank, id, CASE WHEN lag({col}) OVER w IS NULL OR lead({col}) OVER w IS NULL THEN 1e300 WHEN max({col}) OVER p > min({col}) OVER p
 THEN (lead({col}) OVER w - lag({col}) OVER w) / (max({col}) OVER p - min({col}) OVER p) ELSE 0 END AS d FROM sg WINDOW w AS (PARTITION BY rank ORDER BY {col}, id), p AS (PARTITION BY rank)"""


def _crowding(ranks, most=pareto.TARGET_ROWS):
    c = pareto.crowding(ranks.filter("rank IS NOT NULL"), OBJ, "id", max_group_rows=most)
    return c.select("rank", "id", F.when(F.col("crowding") == float("inf"), -1.0).otherwise(r6("crowding")).alias("crowding"))


@query("crowding_distance", f"""WITH RECURSIVE {RANK_SQL}, sg AS (SELECT rank, id, -spend AS s, n_orders, urgent FROM rk), ax AS ({_axis('s')} UNION ALL {_axis('n_orders')} UNION ALL {_axis('urgent')})
SELECT rank, id, round(CASE WHEN max(d) > 1e299 THEN -1 ELSE sum(d) END, 6) AS crowding FROM ax GROUP BY ALL""")
def _(spark, sf):
    return _crowding(pareto.pareto_ranks(customers(spark, sf), OBJ, "id"))


@query("crowding_distance_all", f"""WITH RECURSIVE {RANK_SQL}, sg AS (SELECT rank, id, -spend AS s, n_orders, urgent FROM rk), ax AS ({_axis('s')} UNION ALL {_axis('n_orders')} UNION ALL {_axis('urgent')})
SELECT rank, id, round(CASE WHEN max(d) > 1e299 THEN -1 ELSE sum(d) END, 6) AS crowding FROM ax GROUP BY ALL""")
def _(spark, sf):
    """The same distances with every front cut into value chunks that pass their border values on."""
    return _crowding(pareto.pareto_ranks(customers(spark, sf), OBJ, "id"), 20)


@query("select_by_rank", f"""WITH RECURSIVE {RANK_SQL}, sg AS (SELECT rank, id, -spend AS s, n_orders, urgent FROM rk), ax AS ({_axis('s')} UNION ALL {_axis('n_orders')} UNION ALL {_axis('urgent')}),
z AS (SELECT rank, id, CASE WHEN max(d) > 1e299 THEN 1e300 ELSE round(sum(d), 9) END AS crowding FROM ax GROUP BY ALL) SELECT rank, id FROM z ORDER BY rank, crowding DESC, id LIMIT 10""")
def _(spark, sf):
    d = pareto.pareto_ranks(customers(spark, sf), OBJ, "id", at_least=10).filter("rank IS NOT NULL")
    c = pareto.crowding(d, OBJ, "id").withColumn("crowding", F.when(F.col("crowding") == float("inf"), F.col("crowding")).otherwise(F.round("crowding", 9)))
    return pareto.select_best(c, 10, "id").select("rank", "id")


@query("improvement_gap", f"""WITH {CUST_SQL}, f AS MATERIALIZED (SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE {DOM})),
s AS (SELECT a.id, b.id AS best_id, greatest(b.spend - a.spend, 0) / 3e6 + greatest(a.n_orders - b.n_orders, 0) / 20 + 0.5 * greatest(a.urgent - b.urgent, 0) / 5 AS g,
 b.spend - a.spend AS gs, a.n_orders - b.n_orders AS gn FROM c a JOIN f b ON {DOM})
SELECT id, round(max(g), 6) AS distance FROM s GROUP BY id HAVING max(g) >= 0.05""")
def _(spark, sf):
    c = customers(spark, sf)
    d = pareto.improvement_gap(c, pareto.pareto_front(c, OBJ), OBJ_W, "id", "id")
    return d.select("id", r6("distance").alias("distance"))


@query("operating_point_comparison", f"""WITH {CUST_SQL}, f AS (SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE {DOM}))
SELECT 'front' AS kind, id, n_orders, urgent FROM f UNION ALL SELECT 'nominal', -1, round(avg(n_orders), 6), round(avg(urgent), 6) FROM c
UNION ALL SELECT 'current', id, n_orders, urgent FROM c WHERE id = (SELECT arg_max(o_custkey, (o_orderdate, o_orderkey)) FROM orders)""")
def _(spark, sf):
    c = customers(spark, sf)
    nominal = c.agg(F.lit(-1).cast("long").alias("id"), r6(F.avg("n_orders")).alias("n_orders"), r6(F.avg("urgent")).alias("urgent"))
    last = table(spark, sf, "orders").agg(F.max_by("o_custkey", F.struct("o_orderdate", "o_orderkey")).alias("id"))
    return pareto.compare_points(pareto.pareto_front(c, OBJ), nominal, c.join(F.broadcast(last), "id")).select("kind", "id", "n_orders", "urgent")


@query("what_if_inputs", """WITH cur AS (SELECT l_quantity AS q, l_discount AS d FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_partkey, l_extendedprice LIMIT 1)
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, coalesce(nullif(l_tax, 0.0), d) AS tax, coalesce(CASE WHEN l_quantity > 10 THEN l_quantity END, q) AS quantity FROM lineitem, cur""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    cur = l.select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("tax"), "l_shipdate", *[
        (-F.col(c)).alias(f"_{c}") for c in ("l_orderkey", "l_partkey", "l_extendedprice")])
    ask = l.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", F.nullif("l_tax", F.lit(0.0)).alias("tax"),
                   F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("quantity"))
    return pareto.fill_from_current(ask, cur, ["tax", "quantity"], ["l_shipdate", "_l_orderkey", "_l_partkey", "_l_extendedprice"])


@query("operating_envelope", """SELECT l_returnflag, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return pareto.envelope(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"])


@query("candidate_points")
def _(spark, sf):
    """As many candidates as there are parts, uniform in the envelope seen in the data."""
    e = pareto.envelope(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]).first()
    n = table(spark, sf, "part").count()
    p = pareto.uniform_points(spark, n, {"reflux": (e.l_quantity_min / 12 + 3, e.l_quantity_max / 12 + 3), "feed": (1.7, 2.3)}, {"conversion": 0.83})
    pur, q = physics.column_estimate(F.col("reflux"), F.col("feed"), F.col("conversion"))
    return p.withColumn("purity", pur).withColumn("energy", q)


