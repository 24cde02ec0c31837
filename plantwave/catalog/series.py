"""Detectors, sessions, as-of and overlap queries over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ladders import severity_from_shift, severity_from_sigma
from ..model import SERIES, severity_rank
from ..operators import asof, charts, drift, overlap, rolling, sessions, windows
from ..operators.alerts import as_alerts, union_alerts
from ..operators.recurrences import thin
from ..operators.scale import chunk_seconds_for
from ..session import ensure_checkpoint_dir
from .registry import READINGS_SQL, query, r6, readings, table, us, user_readings
from .sqlparts import BASELINE, CUSUM, EWMA, INDEXED, SHEWHART, SIGMA_RANK, sessions_sql, thin_sql

HALF_DAY = 43_200
GAP_MIN = 2160.0


def sized(spark, sf, source=readings):
    r = source(spark, sf)
    return r, chunk_seconds_for(r, SERIES)


def baselined(spark, sf):
    r, sec = sized(spark, sf)
    return r, charts.fit_baseline(r, SERIES, 0.25, seconds=sec), sec


@query("control_limits", f"""WITH {BASELINE} SELECT tag, n_fit, round(mean, 6) AS mean, round(sigma, 6) AS sigma, round(mean + 3 * sigma, 6) AS ucl,
 round(mean - 3 * sigma, 6) AS lcl, round(mean + 3 * sigma * sqrt(0.2 / 1.8), 6) AS ewma_ucl,
 round(mean - 3 * sigma * sqrt(0.2 / 1.8), 6) AS ewma_lcl FROM b""")
def _(spark, sf):
    _, b, _ = baselined(spark, sf)
    return b.select("tag", "n_fit", *[r6(c).alias(c) for c in ("mean", "sigma", "ucl", "lcl", "ewma_ucl", "ewma_lcl")])


@query("shewhart_violations", f"""WITH {SHEWHART} SELECT tag, us AS ts_us, value, side, round(lim, 6) AS lim, round(dev, 6) AS deviation,
 round(least(1.0, dev / 3), 6) AS confidence, {SIGMA_RANK} AS severity_rank FROM v""")
def _(spark, sf):
    r, b, sec = baselined(spark, sf)
    v = charts.shewhart_violations(r, b, seconds=sec)
    dev = F.col("deviation")
    return v.select("tag", us("ts").alias("ts_us"), "value", "side", r6("lim").alias("lim"), r6(dev).alias("deviation"),
                    r6(F.least(F.lit(1.0), dev / 3)).alias("confidence"),
                    severity_rank(severity_from_sigma(dev)).alias("severity_rank"))


@query("shewhart_cooldown", f"""WITH RECURSIVE {SHEWHART}{thin_sql('v', 'tag', HALF_DAY * 1_000_000)} SELECT tag, us AS ts_us, value FROM t""")
def _(spark, sf):
    r, b, sec = baselined(spark, sf)
    v = thin(charts.shewhart_violations(r, b, seconds=sec), SERIES, HALF_DAY, seconds=sec)
    return v.select("tag", us("ts").alias("ts_us"), "value")


@query("alert_messages", f"""WITH RECURSIVE {SHEWHART}{thin_sql('v', 'tag', HALF_DAY * 1_000_000)} SELECT t.tag, us AS ts_us,
 format('{{}} at {{:.3f}} is {{}} its three-sigma limit {{:.3f}}', t.tag, value, CASE WHEN value > mean THEN 'above' ELSE 'below' END,
  CASE WHEN value > mean THEN mean + 3 * sigma ELSE mean - 3 * sigma END) AS message FROM t JOIN b ON t.tag = b.tag""")
def _(spark, sf):
    r, b, sec = baselined(spark, sf)
    return charts.shewhart_alerts(r, b, HALF_DAY, seconds=sec).select("tag", us("ts").alias("ts_us"), "message")


@query("shewhart_sessions", f"""WITH RECURSIVE {SHEWHART}{thin_sql('(SELECT *, ' + SIGMA_RANK + ' AS rank FROM v)', 'tag', HALF_DAY * 1_000_000)}
{sessions_sql('t', 'tag', int(GAP_MIN * 60e6))}
SELECT tag, start_us, end_us, alert_count, peak_rank, peak_value, peak_us FROM s""")
def _(spark, sf):
    r, b, sec = baselined(spark, sf)
    s = sessions.sessionise(charts.shewhart_alerts(r, b, HALF_DAY, seconds=sec), GAP_MIN, seconds=sec)
    return s.select("tag", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"), "alert_count", "peak_rank",
                    F.col("peak_alert.value").alias("peak_value"), us("peak_alert.ts").alias("peak_us"))


@query("ewma_chart", f"""WITH RECURSIVE {EWMA} SELECT tag, us AS ts_us, round(ewma, 6) AS ewma FROM e""")
def _(spark, sf):
    r, b, sec = baselined(spark, sf)
    return charts.ewma_series(r, b, seconds=sec).select("tag", us("ts").alias("ts_us"), r6("ewma").alias("ewma"))


@query("ewma_alerts", f"""WITH RECURSIVE {EWMA}, w AS (SELECT e.*, abs(ewma - mean) / (sigma / 3) AS dev,
 CASE WHEN ewma > mean + sigma THEN 'above' ELSE 'below' END AS side FROM e JOIN b USING (tag)
 WHERE ewma > mean + sigma OR ewma < mean - sigma){thin_sql('w', 'tag', 3_600_000_000)}
SELECT tag, us AS ts_us, round(ewma, 6) AS value, side, round(dev, 6) AS deviation FROM t""")
def _(spark, sf):
    # sqrt(0.2 / 1.8) = 1/3, so the limits are mean ± sigma
    r, b, sec = baselined(spark, sf)
    a = charts.ewma_alerts(r, b, 3600, seconds=sec)
    return a.select("tag", us("ts").alias("ts_us"), r6("value").alias("value"), "side",
                    r6("extra.deviation_sigma").alias("deviation"))


@query("cusum_triggers", f"""WITH RECURSIVE {CUSUM} SELECT tag, us AS ts_us, value, direction, round(s, 6) AS cusum,
 CASE WHEN abs(value - mean) / sigma > 6 THEN 4 WHEN abs(value - mean) / sigma > 3 THEN 3 WHEN abs(value - mean) / sigma > 1.5 THEN 2 ELSE 1 END
 AS severity_rank, round(least(1.0, s / (10 * sigma)), 6) AS confidence FROM c WHERE direction IS NOT NULL""")
def _(spark, sf):
    r, b, sec = baselined(spark, sf)
    c = charts.cusum_triggers(r, b, seconds=sec)
    return c.select("tag", us("ts").alias("ts_us"), "value", "direction", r6("cusum").alias("cusum"),
                    severity_rank(severity_from_shift(F.abs("shift"))).alias("severity_rank"), r6("confidence").alias("confidence"))


@query("cusum_alerts", f"""WITH RECURSIVE {CUSUM}, w AS (SELECT * FROM c WHERE direction IS NOT NULL){thin_sql('w', 'tag', 10 * 3_600_000_000)}
SELECT tag, us AS ts_us, value, direction FROM t""")
def _(spark, sf):
    r, b, sec = baselined(spark, sf)
    a = charts.cusum_alerts(r, b, 36_000, seconds=sec)
    return a.select("tag", us("ts").alias("ts_us"), "value", "extra.direction")


@query("frozen_sensor", """WITH x AS (SELECT event_type AS tag, epoch_us(ts) AS us, floor(value / 60) AS v,
 row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events),
w AS (SELECT tag, us, rn, stddev_pop(v) OVER p AS sd, count(v) OVER p AS n, lag(v) OVER (PARTITION BY tag ORDER BY us) AS stuck FROM x
 WINDOW p AS (PARTITION BY tag ORDER BY us ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT tag, us AS ts_us, rn, stuck AS stuck_value FROM w WHERE n = 5 AND sd < 1e-4""")
def _(spark, sf):
    r, sec = sized(spark, sf)
    d = rolling.frozen_windows(r.withColumn("value", F.floor(F.col("value") / 60).cast("double")), 5, seconds=sec)
    return d.select("tag", us("ts").alias("ts_us"), "rn", "stuck_value")


TREND = INDEXED + """,
sm AS (SELECT *, avg(value) OVER (PARTITION BY tag ORDER BY rn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS y,
 (us - min(us) OVER (PARTITION BY tag)) / 60e6 AS x FROM ix),
f AS (SELECT tag, us, rn, y, regr_slope(y, x) OVER w AS slope, regr_r2(y, x) OVER w AS r2 FROM sm
 WINDOW w AS (PARTITION BY tag ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
g AS (SELECT * FROM f WHERE rn >= 20 AND (rn - 20) % 2 = 0)"""


@query("trend_fits", f"""WITH {TREND} SELECT tag, us AS ts_us, round(y, 6) AS smooth, round(slope, 6) AS slope, round(r2, 6) AS r2 FROM g""")
def _(spark, sf):
    r, sec = sized(spark, sf)
    d = rolling.trend_fits(r, 20, 3, 2, seconds=sec)
    return d.select("tag", us("ts").alias("ts_us"), r6("smooth").alias("smooth"), r6("slope").alias("slope"), r6("r2").alias("r2"))


@query("trend_projection", f"""WITH RECURSIVE {TREND}, l AS (SELECT * FROM (VALUES ('click', 20.0, 90.0), ('view', NULL, 100.0), ('error', 25.0, NULL)) t(tag, lo, hi)),
p AS (SELECT g.*, CASE WHEN slope > 1e-9 AND hi IS NOT NULL AND y < hi THEN hi WHEN slope < -1e-9 AND lo IS NOT NULL AND y > lo THEN lo END AS breach FROM g JOIN l USING (tag)),
w AS (SELECT *, (breach - y) / slope AS m FROM p WHERE breach IS NOT NULL AND r2 >= 0.25 AND (breach - y) / slope BETWEEN 0 AND 600)
{thin_sql('w', 'tag', 6 * 3_600_000_000)}
SELECT tag, us AS ts_us, breach AS lim, round(m, 6) AS minutes_to_limit,
 CASE WHEN m < 5 THEN 4 WHEN m < 15 THEN 3 WHEN m < 30 THEN 2 ELSE 1 END AS severity_rank FROM t""")
def _(spark, sf):
    r, sec = sized(spark, sf)
    lim = spark.createDataFrame([("click", 20.0, 90.0), ("view", None, 100.0), ("error", 25.0, None)],
                                "tag string, low double, high double")
    a = rolling.trend_alerts(r, lim, 20, 3, 2, horizon_minutes=600, cooldown_s=21600, seconds=sec)
    return a.select("tag", us("ts").alias("ts_us"), "lim", r6("extra.minutes_to_limit").alias("minutes_to_limit"),
                    severity_rank("severity").alias("severity_rank"))


@query("sampling_period", f"""WITH {READINGS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id, tag ORDER BY us) AS rn,
 lead(us) OVER (PARTITION BY user_id, tag ORDER BY us) AS nx FROM r)
SELECT user_id, tag, round(CASE WHEN nx > us THEN (nx - us) / 1e6 ELSE 60.0 END, 6) AS period_s FROM x WHERE rn = 1""")
def _(spark, sf):
    d = rolling.sampling_period(user_readings(spark, sf))
    return d.select(F.col("asset").cast("long").alias("user_id"), "tag", r6("period_s").alias("period_s"))


@query("rolling_mean", f"""WITH {INDEXED} SELECT tag, us AS ts_us, round(avg(value) OVER (PARTITION BY tag ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS smooth FROM ix""")
def _(spark, sf):
    from ..operators.ordered import index_rows, row_frame, with_halo
    from ..operators.scale import TARGET_ROWS
    r, sec = sized(spark, sf)
    d, parts, own = with_halo(index_rows(r, ["tag"], ["ts"], seconds=sec), ["tag"], 10, block_rows=TARGET_ROWS if sec else None)
    d = d.withColumn("smooth", F.avg("value").over(row_frame(parts, "rn", -9, 0))).filter(own)
    return d.select("tag", us("ts").alias("ts_us"), r6("smooth").alias("smooth"))


@query("downsample_last_mean", f"""WITH {READINGS_SQL} SELECT tag, us // 3600000000 * 3600000000 AS ts_us, arg_max(value, us) AS last, round(avg(value), 6) AS mean
FROM r GROUP BY ALL""")
def _(spark, sf):
    from ..streaming.live import downsample_stream
    r = readings(spark, sf)
    a = downsample_stream(r, "1 hour", "last", keys=["tag"]).withColumnRenamed("value", "last")
    b = downsample_stream(r, "1 hour", "mean", keys=["tag"]).withColumnRenamed("value", "mean")
    return a.join(b, ["tag", "ts"]).select("tag", us("ts").alias("ts_us"), "last", r6("mean").alias("mean"))


# --- sessions of raw alerts -------------------------------------------------------

def raw_alerts(spark, sf):
    """Every user event above 90 as an alert; `signup` alerts carry no tag."""
    d = user_readings(spark, sf).filter(F.col("value") > 90)
    dev = F.col("value") / 50.0
    return as_alerts(d.withColumn("detector", F.lit("x")), detector="Level", alert_type="level",
                     severity=severity_from_sigma(dev), value=F.col("value"), lim=F.lit(90.0),
                     confidence=F.lit(1.0), message=F.lit(""), tag=F.when(F.col("tag") != "signup", F.col("tag")),
                     contributors=F.create_map(F.col("tag"), F.col("value")))


ALERTS_SQL = f"""{READINGS_SQL}, a AS (SELECT user_id, tag, us, value, 90.0 AS lim, value / 50 AS dev,
 CASE WHEN value / 50 > 8 THEN 4 WHEN value / 50 > 5 THEN 3 WHEN value / 50 > 3.5 THEN 2 ELSE 1 END AS rank FROM r WHERE value > 90)
{sessions_sql('a', 'user_id, tag', 86_400_000_000)}"""


def raw_sessions(spark, sf):
    a = raw_alerts(spark, sf)
    sec = chunk_seconds_for(a, ["asset", "scenario", "detector", "tag"])
    ensure_checkpoint_dir(spark)
    return sessions.sessionise(a, 1440.0, seconds=sec).checkpoint(), sec  # several steps read the sessions


@query("alert_sessions", f"""WITH {ALERTS_SQL} SELECT user_id, CASE WHEN tag <> 'signup' THEN tag END AS tag, start_us, end_us,
 round((end_us - start_us) / 60e6, 6) AS duration_min, alert_count, peak_rank, peak_value FROM s""")
def _(spark, sf):
    s, _ = raw_sessions(spark, sf)
    return s.select(F.col("asset").cast("long").alias("user_id"), "tag", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"),
                    r6("duration_min").alias("duration_min"), "alert_count", "peak_rank", F.col("peak_alert.value").alias("peak_value"))


@query("session_contributors", f"""WITH {READINGS_SQL}, a AS (SELECT user_id, tag, us, value, 90.0 AS lim, 1 AS rank FROM r WHERE value > 90)
{sessions_sql('a', 'user_id, tag', 86_400_000_000)}
SELECT user_id, tag AS contributor, start_us, max(value) AS weight FROM s_i GROUP BY ALL""")
def _(spark, sf):
    s, _ = raw_sessions(spark, sf)
    return s.select(F.col("asset").cast("long").alias("user_id"), us("start_ts").alias("start_us"),
                    F.explode("contributors").alias("contributor", "weight"))


@query("longest_sessions", f"""WITH {ALERTS_SQL} SELECT user_id, start_us, end_us, alert_count FROM s ORDER BY end_us - start_us DESC, start_us LIMIT 5""")
def _(spark, sf):
    d = sessions.longest_sessions(raw_sessions(spark, sf)[0], 5)
    return d.select(F.col("asset").cast("long").alias("user_id"), us("start_ts").alias("start_us"), us("end_ts").alias("end_us"), "alert_count")


@query("worst_sessions", f"""WITH {ALERTS_SQL} SELECT user_id, start_us, peak_rank, alert_count FROM s ORDER BY peak_rank DESC, alert_count DESC, start_us LIMIT 8""")
def _(spark, sf):
    d = sessions.worst_sessions(raw_sessions(spark, sf)[0], 8)
    return d.select(F.col("asset").cast("long").alias("user_id"), us("start_ts").alias("start_us"), "peak_rank", "alert_count")


@query("sessions_summary", f"""WITH {ALERTS_SQL}, x AS (SELECT CASE peak_rank WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS sev FROM s)
SELECT CASE WHEN sev IS NULL THEN 'all' ELSE 'severity' END AS facet, coalesce(sev, '') AS item, count(*) AS n FROM x GROUP BY GROUPING SETS ((sev), ())
UNION ALL SELECT 'detector', 'Level', count(*) FROM x""")
def _(spark, sf):
    from ..operators.reports import sessions_summary
    return sessions_summary(raw_sessions(spark, sf)[0])


@query("detector_counts", f"""WITH {SHEWHART} SELECT tag AS scenario, count(*) AS total, count(*) FILTER (side = 'above') AS above, count(*) FILTER (side = 'below') AS below
FROM v GROUP BY 1""")
def _(spark, sf):
    from ..operators.reports import detector_counts
    r, b, sec = baselined(spark, sf)
    v = charts.shewhart_violations(r, b, seconds=sec).select(F.col("tag").alias("scenario"), F.col("side").alias("detector"))
    d = detector_counts(v, ["scenario"], ["above", "below"])
    return d.select("scenario", (F.col("above") + F.col("below")).alias("total"), "above", "below")


@query("time_to_first_session", f"""WITH {ALERTS_SQL}, k AS (SELECT user_id, epoch_us(TIMESTAMP '2024-01-08') + user_id * 60000000 AS ev FROM (SELECT DISTINCT user_id FROM events))
SELECT s.user_id, round((min(start_us) - any_value(ev)) / 60e6, 6) AS minutes FROM s JOIN k ON s.user_id = k.user_id AND start_us >= ev GROUP BY 1""")
def _(spark, sf):
    from ..operators.reports import time_to_first
    s, _ = raw_sessions(spark, sf)
    known = table(spark, sf, "events").select("user_id").distinct().select(
        F.col("user_id").cast("string").alias("asset"),
        F.timestamp_micros(F.unix_micros(F.lit("2024-01-08").cast("timestamp")) + F.col("user_id") * 60000000).alias("event_ts"))
    d = time_to_first(s, known, ["asset"], ["detector"])
    return d.select(F.col("asset").cast("long").alias("user_id"), r6("minutes").alias("minutes"))


@query("alert_union", f"""WITH {BASELINE} SELECT 'high' AS detector, count(*) AS n, min(us) AS first_us FROM ix JOIN b USING (tag) WHERE value > mean + 3 * sigma
UNION ALL SELECT 'level', count(*), min(us) FROM r WHERE value > 90""")
def _(spark, sf):
    r, b, sec = baselined(spark, sf)
    v = charts.shewhart_violations(r, b, seconds=sec)
    def al(d, name):
        return as_alerts(d, detector=name, alert_type=name, severity=F.lit("low"), value=F.col("value"), lim=F.lit(0.0),
                         confidence=F.lit(1.0), message=F.lit(""))
    d = union_alerts(al(v.filter("side = 'above'"), "high"), al(r.filter(F.col("value") > 90), "level"))
    return d.groupBy("detector").agg(F.count(F.lit(1)).alias("n"), us(F.min("ts")).alias("first_us"))


@query("co_occurrence", f"""WITH {ALERTS_SQL}
SELECT x.user_id, x.tag, x.start_us, y.tag AS o_tag, count(*) AS n FROM s x JOIN s y ON x.user_id = y.user_id
 AND NOT (x.tag = y.tag AND x.start_us = y.start_us)
 AND (abs(x.start_us - y.start_us) <= 36000000000 OR (y.start_us <= x.end_us AND y.end_us >= x.start_us)) GROUP BY ALL""")
def _(spark, sf):
    s, sec = raw_sessions(spark, sf)
    s = s.withColumn("tag", F.coalesce("tag", F.lit("signup")))
    c = overlap.co_occurrence_counts(s, 600.0, seconds=sec)
    return c.join(s.select("session_id", "asset", "tag", "start_ts"), "session_id").select(
        F.col("asset").cast("long").alias("user_id"), "tag", us("start_ts").alias("start_us"), "o_tag", "n")


@query("co_occurrence_flags", f"""WITH {ALERTS_SQL}, p AS (SELECT x.user_id, x.tag, x.start_us, y.tag AS o_tag FROM s x JOIN s y ON x.user_id = y.user_id
 AND NOT (x.tag = y.tag AND x.start_us = y.start_us) AND y.start_us <= x.start_us
 AND (abs(x.start_us - y.start_us) <= 36000000000 OR y.end_us >= x.start_us))
SELECT s.user_id, s.tag, s.start_us, count(*) FILTER (o_tag = 'error') > 0 AS with_error, count(*) FILTER (o_tag = 'click') AS n_click
FROM s LEFT JOIN p USING (user_id, tag, start_us) GROUP BY ALL""")
def _(spark, sf):
    s, sec = raw_sessions(spark, sf)
    s = s.withColumn("tag", F.coalesce("tag", F.lit("signup")))
    streams = spark.createDataFrame([("Level", "error"), ("Level", "click")], "o_detector string, o_tag_key string")
    c = overlap.co_occurrence_counts(s, 600.0, streams, causal=True, seconds=sec)
    flags = c.groupBy("session_id").agg(F.bool_or(F.col("o_tag") == "error").alias("e"),
                                        F.sum(F.when(F.col("o_tag") == "click", F.col("n"))).alias("c"))
    d = s.join(flags, "session_id", "left")
    return d.select(F.col("asset").cast("long").alias("user_id"), "tag", us("start_ts").alias("start_us"),
                    F.coalesce("e", F.lit(False)).alias("with_error"), F.coalesce("c", F.lit(0)).alias("n_click"))


# --- as-of ------------------------------------------------------------------------

PROBE_SQL = f"""{READINGS_SQL}, e AS (SELECT user_id, us FROM r WHERE tag = 'error'), p AS (SELECT user_id, us, value FROM r WHERE tag = 'purchase')"""


def probes_and_readings(spark, sf):
    r = user_readings(spark, sf)
    probes = r.filter("tag = 'error'").select("asset", "ts")
    target = r.filter("tag = 'purchase'").select("asset", "ts", "value")
    return probes, target, chunk_seconds_for(r, ["asset"])


@query("asof_backward", f"""WITH {PROBE_SQL} SELECT e.user_id, e.us AS ts_us, p.value, p.us AS at_us FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.us >= p.us""")
def _(spark, sf):
    probes, target, sec = probes_and_readings(spark, sf)
    d = asof.asof_backward(probes, target, ["asset"], out="value", seconds=sec, at="at_ts")
    return d.select(F.col("asset").cast("long").alias("user_id"), us("ts").alias("ts_us"), "value", us("at_ts").alias("at_us"))


@query("asof_nearest", f"""WITH {PROBE_SQL}, lo AS (SELECT e.user_id, e.us, p.us AS lus, p.value AS lv FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.us >= p.us),
hi AS (SELECT e.user_id, e.us, p.us AS hus, p.value AS hv FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.us <= p.us)
SELECT user_id, us AS ts_us, CASE WHEN hus IS NULL OR us - lus <= hus - us THEN lv ELSE hv END AS value FROM lo JOIN hi USING (user_id, us)""")
def _(spark, sf):
    probes, target, sec = probes_and_readings(spark, sf)
    d = asof.asof_nearest(probes, target, ["asset"], out="value", seconds=sec)
    return d.select(F.col("asset").cast("long").alias("user_id"), us("ts").alias("ts_us"), "value")


@query("recent_mean", f"""WITH {PROBE_SQL}, q AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW) AS m FROM p)
SELECT e.user_id, e.us AS ts_us, round(q.m, 6) AS recent_mean FROM e ASOF LEFT JOIN q ON e.user_id = q.user_id AND e.us >= q.us""")
def _(spark, sf):
    probes, target, sec = probes_and_readings(spark, sf)
    d = asof.recent_mean(probes, target, 2880, ["asset"], seconds=sec)
    return d.select(F.col("asset").cast("long").alias("user_id"), us("ts").alias("ts_us"), r6("recent_mean").alias("recent_mean"))


@query("still_signal", """WITH x AS (SELECT event_type AS tag, epoch_us(ts) AS us, floor(value / 60) AS v FROM events),
w AS (SELECT *, stddev_samp(v) OVER p AS sd, count(v) OVER p AS n FROM x WINDOW p AS (PARTITION BY tag ORDER BY us RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW))
SELECT tag, us AS ts_us, n, n >= 5 AND sd < 1e-4 AS still FROM w""")
def _(spark, sf):
    r = readings(spark, sf).withColumn("value", F.floor(F.col("value") / 60).cast("double"))
    d = asof.trailing_moments(r, 120, "n", "mean", "sd")
    return d.select("tag", us("ts").alias("ts_us"), "n", F.coalesce((F.col("n") >= 5) & (F.col("sd") < 1e-4), F.lit(False)).alias("still"))


@query("fill_both_ways", """WITH x AS (SELECT event_type AS tag, epoch_us(ts) AS us, CASE WHEN value > 60 THEN value END AS v FROM events)
SELECT tag, us AS ts_us, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY tag ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(v IGNORE NULLS) OVER (PARTITION BY tag ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM x""")
def _(spark, sf):
    r, sec = sized(spark, sf)
    r = r.withColumn("value", F.when(F.col("value") > 60, F.col("value")))
    d = windows.fill_both_ways(r, ["value"], SERIES, seconds=sec)
    return d.select("tag", us("ts").alias("ts_us"), "value")


# --- drift ------------------------------------------------------------------------

EDGES_SQL = """ref AS (SELECT event_type AS tag, value AS v FROM events WHERE ts < TIMESTAMP '2024-01-16'),
liv AS (SELECT event_type AS tag, value * CASE event_type WHEN 'click' THEN 1.4 WHEN 'view' THEN 1.9 ELSE 1 END AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
q AS (SELECT tag, quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS edges, count(*) AS n_ref FROM ref GROUP BY tag)"""


def halves(spark, sf):
    r = readings(spark, sf)
    grow = F.when(F.col("tag") == "click", 1.4).when(F.col("tag") == "view", 1.9).otherwise(1.0)
    return r.filter(F.col("ts") < "2024-01-16"), r.filter(F.col("ts") >= "2024-01-16").withColumn("value", F.col("value") * grow)


@query("drift_bin_edges", f"""WITH {EDGES_SQL} SELECT tag, n_ref, unnest(range(0, 11)) AS i, round(unnest(edges), 6) AS edge FROM q""")
def _(spark, sf):
    e = drift.bin_edges(halves(spark, sf)[0])
    return e.select("tag", "n_ref", F.posexplode("edges").alias("i", "edge")).select(
        "tag", "n_ref", F.col("i").cast("long").alias("i"), r6("edge").alias("edge"))


PSI_SQL = f"""{EDGES_SQL}, bins AS (SELECT tag, unnest(range(0, 10)) AS bin, n_ref FROM q),
rc AS (SELECT ref.tag, len(list_filter(edges[2:10], lambda e: e <= v)) AS bin, count(*) AS c FROM ref JOIN q USING (tag) GROUP BY ALL),
lc AS (SELECT liv.tag, len(list_filter(edges[2:10], lambda e: e <= v)) AS bin, count(*) AS c FROM liv JOIN q USING (tag) GROUP BY ALL),
nl AS (SELECT tag, count(*) AS n_live FROM liv GROUP BY 1),
x AS (SELECT bins.tag, n_ref, n_live, greatest(coalesce(rc.c, 0) / n_ref, 1e-6) AS p, greatest(coalesce(lc.c, 0) / n_live, 1e-6) AS l
 FROM bins JOIN nl USING (tag) LEFT JOIN rc USING (tag, bin) LEFT JOIN lc USING (tag, bin)),
psi AS (SELECT tag, n_ref, n_live, greatest(sum((l - p) * ln(l / p)), 0.0) AS psi FROM x GROUP BY ALL)"""


@query("drift_psi", f"""WITH {PSI_SQL} SELECT tag, n_ref, n_live, round(psi, 6) AS psi,
 CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'none' END AS status FROM psi""")
def _(spark, sf):
    return drift.psi_report(*halves(spark, sf)).withColumn("psi", r6("psi"))


@query("drift_overall", f"""WITH {PSI_SQL} SELECT first(tag ORDER BY psi DESC, tag) AS worst_feature, round(max(psi), 6) AS max_psi,
 CASE WHEN max(psi) >= 0.25 THEN 'significant' WHEN max(psi) >= 0.1 THEN 'moderate' ELSE 'none' END AS overall_status FROM psi""")
def _(spark, sf):
    return drift.overall(drift.psi_report(*halves(spark, sf))).withColumn("max_psi", r6("max_psi"))


@query("drift_live_window", """WITH e AS (SELECT *, event_type || CASE WHEN value > 220 THEN '_high' ELSE '' END AS tag FROM events),
x AS (SELECT tag, value FROM e QUALIFY row_number() OVER (PARTITION BY tag ORDER BY ts DESC) <= 500)
SELECT tag, count(*) AS n, round(sum(value), 4) AS s FROM x GROUP BY 1 HAVING count(*) >= 30""")
def _(spark, sf):
    tag = F.concat("tag", F.when(F.col("value") > 220, "_high").otherwise(""))
    d = drift.live_window(readings(spark, sf).withColumn("tag", tag), 500)
    return d.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("s"))


# --- windows ----------------------------------------------------------------------

@query("forecast_windows", """WITH x AS (SELECT event_type AS scenario, ts, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type) AS n,
 list(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS x,
 list(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS y FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT scenario, epoch_us(ts) AS now_us, rn, round(list_sum(x), 4) AS x_sum, x[1] AS x_first, round(list_sum(y), 4) AS y_sum, y[6] AS y_last
FROM x WHERE rn >= 12 AND rn + 6 <= n""")
def _(spark, sf):
    r, sec = sized(spark, sf)
    wide = r.select("asset", F.col("tag").alias("scenario"), "ts", "value")
    d = windows.forecast_windows(wide, ["value"], ["value"], 12, 6, seconds=sec)
    def total(c):
        return F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v["value"]), 4)
    return d.select("scenario", us("now_ts").alias("now_us"), "rn", total("x").alias("x_sum"), F.col("x")[0]["value"].alias("x_first"),
                    total("y").alias("y_sum"), F.col("y")[5]["value"].alias("y_last"))


@query("point_horizons", """WITH x AS (SELECT event_type AS scenario, epoch_us(ts) AS now_us, value, lead(value, 2) OVER w AS h2, lead(value, 5) OVER w AS h5,
 row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT scenario, now_us, h2 AS at_2min, h5 AS at_5min FROM x WHERE rn >= 3 AND rn + 6 <= n AND (rn - 3) % 5 = 0""")
def _(spark, sf):
    r, sec = sized(spark, sf)
    wide = r.select("asset", F.col("tag").alias("scenario"), "ts", "value")
    d = windows.forecast_windows(wide, ["value"], ["value"], 3, 6, every=5, seconds=sec)
    d = d.withColumn("trajectory", F.transform("y", lambda v: v["value"]))
    d = windows.point_horizons(d, "trajectory", [2, 5])
    return d.select("scenario", us("now_ts").alias("now_us"), "at_2min", "at_5min")


@query("lag_features", """WITH x AS (SELECT event_type AS scenario, epoch_us(ts) AS now_us, value AS value__lag0, lag(value, 3) OVER w AS value__lag3,
 lead(value, 2) OVER w AS value__h2, row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT scenario, now_us, value__lag0, value__lag3, value__h2 FROM x WHERE rn > 3 AND rn + 2 <= n""")
def _(spark, sf):
    r, sec = sized(spark, sf)
    wide = r.select("asset", F.col("tag").alias("scenario"), "ts", "value")
    d = windows.lag_features(wide, ["value"], ["value"], [0, 3], [2], seconds=sec)
    return d.select("scenario", us("now_ts").alias("now_us"), "value__lag0", "value__lag3", "value__h2")


@query("rolling_origin_forecasts", """WITH x AS (SELECT event_type AS scenario, ts, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type) AS n,
 avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS p FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT o.scenario, epoch_us(o.ts) AS origin_us, t.rn - o.rn - 1 AS pos, round(o.p, 6) AS predicted, t.value AS actual
FROM x o JOIN x t ON o.scenario = t.scenario AND t.rn BETWEEN o.rn + 1 AND o.rn + 6 WHERE o.rn >= 10 AND o.rn + 6 <= o.n AND (o.rn - 10) % 30 = 0""")
def _(spark, sf):
    # one microsecond per row stands for the sampling period, so forecasts land on readings
    from ..operators.ordered import index_rows
    r, sec = sized(spark, sf)
    idx = index_rows(r.select("asset", F.col("tag").alias("scenario"), "ts", "value"), ["asset", "scenario"], ["ts"], seconds=sec)
    grid = idx.select("asset", "scenario", F.timestamp_micros("rn").alias("ts"), "value", F.unix_micros("ts").alias("real_us"))
    w = windows.forecast_windows(grid, ["value", "real_us"], ["value"], 10, 6, every=30)
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v["value"]) / 10
    f = w.select("asset", "scenario", F.col("now_ts").alias("ts"), F.array_repeat(mean, 6).alias("trajectory"))
    d = windows.aligned_forecasts(f, grid, ["asset", "scenario"], 1)
    back = grid.select("asset", "scenario", F.col("ts").alias("origin_ts"), F.col("real_us").alias("origin_us"))
    return d.join(back, ["asset", "scenario", "origin_ts"]).select(
        "scenario", "origin_us", F.col("pos").cast("long").alias("pos"), r6("predicted").alias("predicted"), "actual")


@query("latest_forecasts", """WITH x AS (SELECT user_id, event_type, ts, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) AS back
 FROM events), n AS (SELECT user_id, event_type, max(ts) AS now, count(*) AS have, avg(value) AS p FROM x WHERE back <= 5 GROUP BY 1, 2)
SELECT user_id::VARCHAR AS asset, event_type AS scenario, have, 5 AS needs, have < 5 AS warming_up, epoch_us(now) AS now_us, CASE WHEN have = 5 THEN k END AS pos,
 CASE WHEN have = 5 THEN epoch_us(now) + (k + 1) * 60000000 END AS target_us, CASE WHEN have = 5 THEN round(p, 6) END AS predicted
FROM n, range(0, 3) s(k) WHERE have = 5 OR k = 0""")
def _(spark, sf):
    """Points ahead of the last reading of every (user, event type), or how much of the lookback is there."""
    r = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("asset"), F.col("event_type").alias("scenario"),
                                          F.col("ts").cast("timestamp").alias("ts"), "value")
    now = windows.latest_windows(r, ["value"], 5, tie=["value"], seconds=chunk_seconds_for(r, ["asset", "scenario"]))
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v["value"]) / 5
    made = now.filter(~F.col("warming_up")).withColumn("trajectory", F.array_repeat(mean, 3))
    points = windows.aligned_forecasts(made, r.limit(0), ["asset", "scenario"], 60_000_000, future=True)
    state = now.select("asset", "scenario", "have", "needs", "warming_up", us("ts").alias("now_us"))
    return state.join(points.select("asset", "scenario", F.col("pos").cast("long").alias("pos"), us("ts").alias("target_us"),
                                    r6("predicted").alias("predicted")), ["asset", "scenario"], "left")
