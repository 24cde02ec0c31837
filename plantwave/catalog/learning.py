"""Multivariate monitoring, models and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ladders import agreement
from ..operators import charts, divergence, learn, pca, reports, windows
from ..operators.scale import chunk_seconds_for
from ..plans import retrain
from ..streaming import detectors, live
from .history import dim
from .registry import READINGS_SQL, query, r6, readings, table, us, user_readings
from .series import PSI_SQL
from .sqlparts import BASELINE, CUSUM, EWMA, INDEXED, SHEWHART, thin_sql

FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_table", """SELECT a, b, round(r, 6) AS r FROM (SELECT unnest([
 {a: 'l_quantity', b: 'l_quantity', r: corr(l_quantity, l_quantity)}, {a: 'l_quantity', b: 'l_extendedprice', r: corr(l_quantity, l_extendedprice)},
 {a: 'l_quantity', b: 'l_discount', r: corr(l_quantity, l_discount)}, {a: 'l_quantity', b: 'l_tax', r: corr(l_quantity, l_tax)},
 {a: 'l_extendedprice', b: 'l_extendedprice', r: corr(l_extendedprice, l_extendedprice)}, {a: 'l_extendedprice', b: 'l_discount', r: corr(l_extendedprice, l_discount)},
 {a: 'l_extendedprice', b: 'l_tax', r: corr(l_extendedprice, l_tax)}, {a: 'l_discount', b: 'l_discount', r: corr(l_discount, l_discount)},
 {a: 'l_discount', b: 'l_tax', r: corr(l_discount, l_tax)}, {a: 'l_tax', b: 'l_tax', r: corr(l_tax, l_tax)}], recursive := true) FROM lineitem)""")
def _(spark, sf):
    return pca.correlation_table(table(spark, sf, "lineitem"), FOUR).withColumn("r", r6("r"))


@query("pca_scores", """WITH m AS (SELECT avg(l_quantity) AS m1, stddev_samp(l_quantity) AS s1, avg(l_extendedprice) AS m2, stddev_samp(l_extendedprice) AS s2, corr(l_quantity, l_extendedprice) AS r FROM lineitem),
z AS (SELECT l_orderkey, l_partkey, l_linenumber, (l_quantity - m1) / s1 AS a, (l_extendedprice - m2) / s2 AS b, r FROM lineitem, m)
SELECT l_orderkey, l_partkey, l_linenumber, round(pow(a + sign(r) * b, 2) / 2 / (1 + abs(r)), 6) AS t2, round(pow(a - sign(r) * b, 2) / 2, 6) AS spe FROM z""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    cols = ["l_quantity", "l_extendedprice"]
    return pca.score_pca(l, pca.fit_pca(l, cols)).select("l_orderkey", "l_partkey", "l_linenumber", r6("t2").alias("t2"), r6("spe").alias("spe"))


@query("pca_model")
def _(spark, sf):
    return pca.fit_pca(table(spark, sf, "lineitem"), FOUR).to_table(spark)


BY_SUPPLIER = """m AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS m1, stddev_samp(l_quantity) AS s1, avg(l_extendedprice) AS m2,
 stddev_samp(l_extendedprice) AS s2, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1 HAVING count(*) >= 30)"""


@query("pca_models_by_supplier", f"""WITH {BY_SUPPLIER} SELECT l_suppkey, n AS n_train, 1 AS n_components, round(m1, 6) AS mean_1, round(m2, 4) AS mean_2,
 round(s1, 6) AS std_1, round(s2, 4) AS std_2, round(1 + abs(r), 6) AS eigenvalue, round((1 + abs(r)) / 2, 6) AS variance_explained FROM m""")
def _(spark, sf):
    m = pca.fit_pca_by(table(spark, sf, "lineitem"), FOUR[:2], ["l_suppkey"])
    return m.select("l_suppkey", "n_train", "n_components", r6(F.col("means")[0]).alias("mean_1"), r6(F.col("means")[1], 4).alias("mean_2"),
                    r6(F.col("stds")[0]).alias("std_1"), r6(F.col("stds")[1], 4).alias("std_2"), r6(F.col("eigenvalues")[0]).alias("eigenvalue"),
                    r6("variance_explained").alias("variance_explained"))


@query("pca_scores_by_supplier", f"""WITH {BY_SUPPLIER}, z AS (SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, (l_quantity - m1) / s1 AS a,
 (l_extendedprice - m2) / s2 AS b, r FROM lineitem JOIN m USING (l_suppkey))
SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, round(pow(a + sign(r) * b, 2) / 2 / (1 + abs(r)), 6) AS t2, round(pow(a - sign(r) * b, 2) / 2, 6) AS spe FROM z""")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", *FOUR[:2])
    s = pca.score_pca_by(l, pca.fit_pca_by(l, FOUR[:2], ["l_suppkey"]), FOUR[:2], ["l_suppkey"])
    return s.select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", r6("t2").alias("t2"), r6("spe").alias("spe"))


@query("pca_alerts_by_asset")
def _(spark, sf):
    """Daily means of the tags of each asset, against the asset's own model."""
    from ..sources.samples import to_wide
    from .trail import plant_readings
    tags = ["cstr.T_R_C", "column.purity_B", "column.RR", "cstr.F_cool", "column.Q_reb_kW"]
    daily = plant_readings(spark, sf).groupBy("asset", "scenario", F.date_trunc("day", "ts").alias("ts"), "tag").agg(F.avg("value").alias("value"))
    wide = to_wide(daily, tags)
    cols = [c for c in wide.columns if c not in ("asset", "scenario", "ts")]
    return pca.pca_alerts_by(wide, pca.fit_pca_by(wide, cols), cols, cooldown_s=86_400 * 2).drop("extra")


@query("pca_high_dimension")
def _(spark, sf):
    """64 embedding dimensions as tags."""
    e = table(spark, sf, "embeddings")
    wide = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(64)])
    m = pca.fit_pca(wide, [f"d{i}" for i in range(64)])
    s = pca.score_pca(wide, m)
    return s.select("vec_id", r6("t2").alias("t2"), r6("spe").alias("spe"), (F.col("t2") > m.t2_limit).alias("t2_alarm"),
                    (F.col("spe") > m.spe_limit).alias("spe_alarm"), "contributors")


@query("pca_alerts")
def _(spark, sf):
    """Daily means of shipped lines per flag."""
    l = table(spark, sf, "lineitem").groupBy(F.lit("plant").alias("asset"), F.col("l_returnflag").alias("scenario"),
                                             F.col("l_shipdate").cast("timestamp").alias("ts")).agg(*[F.avg(c).alias(c) for c in FOUR])
    return pca.pca_alerts(l, pca.fit_pca(l, FOUR), 86_400 * 7).drop("contributors", "extra")


@query("divergence_runs", f"""WITH RECURSIVE {INDEXED}, f AS (SELECT *, abs(value - 50) > greatest(0.5, 0.01 * abs(value), 30.0) AS off FROM ix),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY tag, off ORDER BY rn) AS grp FROM f),
w AS (SELECT tag, min(rn) AS us, count(*) AS run_rows, first(value ORDER BY abs(value - 50) DESC, rn) AS actual FROM g WHERE off GROUP BY tag, grp HAVING count(*) >= 3)
{thin_sql('w', 'tag', 60)}
SELECT tag, us AS run_start, run_rows, actual, CASE WHEN abs(actual - 50) / greatest(0.5, 0.01 * abs(actual), 30) > 4 THEN 'high'
 WHEN abs(actual - 50) / greatest(0.5, 0.01 * abs(actual), 30) > 2 THEN 'medium' ELSE 'low' END AS severity FROM t""")
def _(spark, sf):
    r = readings(spark, sf)
    d = r.select("tag", "ts", F.col("value").alias("actual"), F.lit(50.0).alias("predicted"), F.lit(10.0).alias("std"))
    out = divergence.divergence_runs(d, ["tag"], 3, 60, seconds=chunk_seconds_for(r, ["tag"]))
    return out.select("tag", "run_start", "run_rows", "actual", "severity")


@query("forecast_violations", f"""WITH RECURSIVE {INDEXED}, h AS (SELECT *, list(value) OVER (PARTITION BY tag ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS y FROM ix),
l AS (SELECT * FROM (VALUES ('click', 150.0, 'above', 60.0), ('view', 1.0, 'below', 0.5), ('error', 120.0, 'above', 100.0)) t(tag, lim, dir, far)),
v AS (SELECT h.tag, us, lim, dir, far, list_position(list_transform(y, lambda q: CASE WHEN dir = 'below' THEN q < lim ELSE q > lim END), true) AS step, y FROM h JOIN l USING (tag)
 WHERE rn >= 12 AND rn + 6 <= n AND (rn - 12) % 3 = 0),
w AS (SELECT tag, us, step, y[step] AS predicted, CASE WHEN (CASE WHEN dir = 'below' THEN lim - y[step] ELSE y[step] - lim END) >= far THEN 'high' ELSE 'medium' END AS severity FROM v WHERE step > 0)
{thin_sql('w', 'tag', 6 * 3_600_000_000, strict=False)} SELECT tag, us AS ts_us, step, predicted, severity FROM t""")
def _(spark, sf):
    from ..operators.windows import forecast_windows
    r = readings(spark, sf)
    sec = chunk_seconds_for(r, ["asset", "tag"])
    w = forecast_windows(r.select("asset", F.col("tag").alias("scenario"), "ts", "value"), ["value"], ["value"], 12, 6, every=3, seconds=sec)
    f = w.select("asset", "scenario", F.col("now_ts").alias("ts"), F.col("scenario").alias("tag"),
                 F.element_at("x", -1)["value"].alias("current"), F.transform("y", lambda v: v["value"]).alias("trajectory"))
    lim = spark.createDataFrame([("click", 150.0, "above", "medium", "high", 60.0), ("view", 1.0, "below", "medium", "high", 0.5),
                                 ("error", 120.0, "above", "medium", "high", 100.0)],
                                "tag string, limit double, direction string, near string, far string, far_offset double")
    v = divergence.forecast_violations(f, lim, cooldown_minutes=360, seconds=sec)
    return v.select("tag", us("ts").alias("ts_us"), F.col("step").cast("long").alias("step"), "predicted", "severity")


@query("agreement", """SELECT l_orderkey, l_partkey, l_linenumber, round(greatest(0.0, 1 - abs(l_extendedprice / 1000 - l_quantity) / 5), 6) AS agreement FROM lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", r6(
        agreement(F.col("l_extendedprice") / 1000, F.col("l_quantity"))).alias("agreement"))


# --- models (no SQL twin) ---------------------------------------------------------

def row_key():
    return F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


SOFT = dict(n_models=3, trees=8, depth=4, step=0.3)


@query("soft_sensor_metrics")
def _(spark, sf):
    train, test = learn.holdout(table(spark, sf, "lineitem"), row_key())
    m = learn.fit_soft_sensor(train, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", row_key(), **SOFT)
    return reports.regression_metrics(m.predict(test), ["l_returnflag"], "l_extendedprice", "predicted")


@query("soft_sensor_band")
def _(spark, sf):
    """Measured, predicted and spread of the last 50 lines per flag."""
    from ..operators.history import recent_rows
    l = table(spark, sf, "lineitem")
    m = learn.fit_soft_sensor(l, ["l_quantity", "l_tax"], "l_extendedprice", row_key(), n_models=2, trees=5, depth=3, step=0.3)
    last = recent_rows(l, 50, ["l_returnflag"], ts="l_shipdate", tie=["l_orderkey", "l_partkey", "l_extendedprice"])
    return m.predict(last).select("l_returnflag", us("l_shipdate").alias("ts_us"), F.col("l_extendedprice").alias("measured"),
                                  "predicted", "std")


@query("soft_sensor_importances")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    m = learn.fit_soft_sensor(l, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", row_key(), n_models=2, trees=5, depth=3, step=0.3)
    return m.importances(spark)


@query("holdout_split")
def _(spark, sf):
    train, test = learn.holdout(table(spark, sf, "lineitem"), row_key())
    n = F.count(F.lit(1)).alias("n")
    return train.groupBy(F.lit("train").alias("part")).agg(n).unionByName(test.groupBy(F.lit("test").alias("part")).agg(n))


def wide_events(spark, sf):
    r = readings(spark, sf)
    return r.select("asset", F.col("tag").alias("scenario"), "ts", "value", F.hour("ts").cast("double").alias("hour"))


@query("forecaster_metrics")
def _(spark, sf):
    w = wide_events(spark, sf)
    _, m = learn.evaluate_forecaster(w, ["value", "hour"], ["value"], [0, 1, 2, 5], [1, 3, 6], seconds=chunk_seconds_for(w, ["asset", "scenario"]))
    return m


@query("model_detectors")
def _(spark, sf):
    """Daily means of the tags of each asset against a soft sensor of the purity and a forecast of the reactor temperature."""
    from ..model import physical_name
    from ..plans.model_detectors import forecast_detector, soft_sensor_detector
    from ..sources.samples import to_wide
    from .trail import plant_readings
    tags = ["cstr.T_R_C", "column.purity_B", "column.RR"]
    day = 86_400.0
    daily = plant_readings(spark, sf).filter(F.col("tag").isin(tags)).groupBy(
        "asset", "scenario", F.date_trunc("day", "ts").alias("ts"), "tag").agg(F.avg("value").alias("value"))
    wide = to_wide(daily, tags).dropna()
    cols = [physical_name(t) for t in tags]
    key = F.concat_ws("|", "asset", F.unix_seconds("ts"))
    sensor = learn.fit_soft_sensor(wide, [cols[0], cols[2]], cols[1], key, n_models=2, trees=4, depth=2, step=0.3)
    model = learn.fit_forecaster(windows.lag_features(wide, cols[:1], cols[:1], [0, 1, 2], [1, 3]), cols[:1], cols[:1], [0, 1, 2], [1, 3])
    limits = spark.createDataFrame([("cstr.T_R_C", 79.2, "above", "medium", "high", 0.5)],
                                   "tag string, limit double, direction string, near string, far string, far_offset double")
    found = soft_sensor_detector(sensor, tags, tags[1], day, 2 * 1440, 5 * 1440, abs_tol=0.1, rel_tol=0.0)(daily).unionByName(
        forecast_detector(model, tags, limits, day, 2 * 1440, 5 * 1440)(daily))
    return found.select("asset", "detector", "tag", "side", "severity", us("ts").alias("ts_us"), r6("value").alias("value"))


@query("retrain_and_promote")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    history = l.groupBy().agg(F.avg(F.abs(F.col("l_extendedprice") - 1500 * F.col("l_quantity"))).alias("mae")).select(
        F.lit("soft_sensor").alias("model"), F.lit("2024-01-01").cast("timestamp").alias("run_ts"), "mae")
    _, out = retrain.retrain_soft_sensor(l, ["l_quantity", "l_discount"], "l_extendedprice", row_key(), history, "from-tables",
                                         F.lit("2024-02-01").cast("timestamp"), n_models=2, trees=5, depth=3, step=0.3)
    return out


# --- streams: a file stream over `events` -----------------------------------------

def event_stream(spark, sf):
    from ..sources.samples import normalise_events
    static = table(spark, sf, "events")
    raw = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return normalise_events(raw, F.col("user_id"), F.col("event_type"))


@query("stream_sessions", f"""WITH {READINGS_SQL}, a AS (SELECT * FROM r WHERE value > 60), g AS (SELECT *, coalesce(us - lag(us) OVER w > 43200000000, true) AS o FROM a WINDOW w AS (PARTITION BY user_id, tag ORDER BY us)),
i AS (SELECT *, max(CASE WHEN o THEN us END) OVER (PARTITION BY user_id, tag ORDER BY us) AS s FROM g)
SELECT user_id, tag, s AS start_us, max(us) AS end_us, count(*) AS alert_count FROM i GROUP BY ALL""")
def _(spark, sf):
    a = event_stream(spark, sf).filter(F.col("value") > 60).withColumn("detector", F.lit("Level")).withColumn("severity", F.lit("low"))
    out = live.run_to_parquet(live.session_stream(a, "12 hours"), "sessions")
    return out.select(F.col("asset").cast("long").alias("user_id"), F.col("tag_key").alias("tag"), us("start_ts").alias("start_us"),
                      us("end_ts").alias("end_us"), "alert_count")


@query("stream_downsample", f"""WITH {READINGS_SQL} SELECT user_id, tag, us // 86400000000 * 86400000000 AS ts_us, round(avg(value), 6) AS value FROM r GROUP BY ALL""")
def _(spark, sf):
    out = live.run_to_parquet(live.downsample_stream(event_stream(spark, sf), "1 day", "mean"), "downsample")
    return out.select(F.col("asset").cast("long").alias("user_id"), "tag", us("ts").alias("ts_us"), r6("value").alias("value"))


@query("stream_unseen", "SELECT user_id AS id, count(DISTINCT event_type) AS n_tags FROM events GROUP BY 1")
def _(spark, sf):
    d = event_stream(spark, sf).withColumn("id", F.concat_ws("|", "asset", "tag"))
    out = live.run_to_parquet(live.unseen(d, "60 days"), "unseen")
    return out.groupBy(F.col("asset").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n_tags"))


KEYED = """r AS (SELECT user_id || '|' || event_type AS tag, epoch_us(ts) AS us, value FROM events),
ix AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY us) AS rn FROM r),
b AS MATERIALIZED (SELECT tag, avg(value) AS mean, greatest(stddev_samp(value), 1e-9) AS sigma FROM r GROUP BY tag)"""
CHARTS_SQL = KEYED + SHEWHART.removeprefix(BASELINE) + EWMA.removeprefix(BASELINE) + CUSUM.removeprefix(BASELINE) + """,
ev AS (SELECT e.tag, us, ewma AS value FROM e JOIN b USING (tag) WHERE ewma > mean + sigma OR ewma < mean - sigma),
cv AS (SELECT tag, us, value FROM c WHERE direction IS NOT NULL)""" + thin_sql("v", "tag", 600_000_000, name="tv") + thin_sql(
    "ev", "tag", 600_000_000, name="te") + thin_sql("cv", "tag", 1_800_000_000, name="tc")


@query("stream_charts", f"""WITH RECURSIVE {CHARTS_SQL}, u AS (SELECT tag, us, value, 'SPC.Shewhart' AS detector FROM tv
 UNION ALL SELECT tag, us, value, 'SPC.EWMA' FROM te UNION ALL SELECT tag, us, value, 'Regime.CUSUM' FROM tc)
SELECT tag AS series, us AS ts_us, detector, round(value, 6) AS value FROM u""")
def _(spark, sf):
    base = charts.fit_baseline(user_readings(spark, sf), ["asset", "tag"])
    out = live.run_to_parquet(detectors.chart_stream(event_stream(spark, sf), base, 10), "charts")
    return out.select(F.concat_ws("|", "asset", "tag").alias("series"), us("ts").alias("ts_us"), "detector", r6("value").alias("value"))


@query("stream_quality", """WITH d AS (SELECT * FROM (VALUES ('click', 0.0, 150.0), ('view', 5.0, 200.0), ('purchase', 0.0, 300.0), ('error', 1.0, 100.0)) t(tag, lo, hi)),
e AS (SELECT user_id, event_type AS tag, epoch_us(ts) AS us, round(value / 50) * 50 AS v, lo, hi FROM events JOIN d ON event_type = d.tag),
g AS (SELECT *, lag(v) OVER (PARTITION BY user_id, tag ORDER BY us) AS prev FROM e),
c AS (SELECT *, max(CASE WHEN prev IS NULL OR abs(v - prev) >= 1e-9 THEN us END) OVER (PARTITION BY user_id, tag ORDER BY us) AS changed FROM g)
SELECT tag, CASE WHEN v < lo OR v > hi THEN 1 WHEN prev IS NOT NULL AND abs(v - prev) < 1e-9 AND us - changed > 86400000000 THEN 2 ELSE 0 END AS quality, count(*) AS n FROM c GROUP BY ALL""")
def _(spark, sf):
    s = event_stream(spark, sf).withColumn("value", F.round(F.col("value") / 50) * 50)
    out = live.run_to_parquet(detectors.quality_stream(s, dim(spark), 86_400), "quality")
    return out.groupBy("tag", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("stream_deferred_outcomes")
def _(spark, sf):
    """Every error is a decision due a day later, measured on the user's purchases."""
    e = event_stream(spark, sf)
    due = e.filter("tag = 'error'").select(
        F.concat_ws("|", "asset", F.unix_micros("ts")).alias("id"), "asset", F.lit("purchase").alias("tag"),
        (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("due_ts"), F.lit(50.0).alias("predicted"))
    out = live.deferred_outcomes(due, event_stream(spark, sf).filter("tag = 'purchase'"), "1 day", "1 hour")
    return live.run_to_parquet(out, "outcomes")


STREAM_PSI_SQL = PSI_SQL.replace(
    PSI_SQL[PSI_SQL.index("liv AS ("):PSI_SQL.index("q AS (")], "liv AS (SELECT event_type AS tag, value AS v FROM events),\n")


@query("stream_drift", f"""WITH {STREAM_PSI_SQL} SELECT tag, n_ref, n_live, round(psi, 6) AS psi,
 CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'none' END AS status FROM psi""")
def _(spark, sf):
    import uuid
    from ..operators.drift import bin_edges, histogram
    from ..session import ensure_checkpoint_dir, shared_dir
    ensure_checkpoint_dir(spark)
    ref = readings(spark, sf).filter(F.col("ts") < "2024-01-16")
    path = f"{shared_dir(spark)}/drift-{uuid.uuid4().hex}"
    edges = bin_edges(ref).checkpoint()
    body = live.drift_batches(edges, histogram(ref, edges).checkpoint(), lambda d, i: d.write.mode("overwrite").parquet(path))
    live.run_batches(live.drift_counts(event_stream(spark, sf), edges), "drift", body, "complete")
    return spark.read.parquet(path).select("tag", "n_ref", "n_live", F.round("psi", 6).alias("psi"), "status")


@query("stream_buffer", f"""WITH {READINGS_SQL} SELECT user_id, (us // 86400000000 + 1) * 86400000000 AS as_of_us, count(*) AS n_values, min(us) AS oldest_us, max(us) AS newest_us FROM r GROUP BY ALL""")
def _(spark, sf):
    out = live.run_to_parquet(live.rolling_buffer(event_stream(spark, sf), "1 day", "1 day"), "buffer")
    return out.select(F.col("asset").cast("long").alias("user_id"), us("as_of").alias("as_of_us"), "n_values",
                      us("oldest").alias("oldest_us"), us("newest").alias("newest_us"))


STREAM_TREND_SQL = KEYED + """,
sm AS (SELECT *, avg(value) OVER (PARTITION BY tag ORDER BY rn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS y,
 (us - min(us) OVER (PARTITION BY tag)) / 60e6 AS x FROM ix),
f AS (SELECT tag, us, rn, y, regr_slope(y, x) OVER w AS slope, regr_r2(y, x) OVER w AS r2 FROM sm
 WINDOW w AS (PARTITION BY tag ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
p AS (SELECT *, CASE WHEN slope > 1e-9 AND y < 95.0 THEN 95.0 WHEN slope < -1e-9 AND y > 5.0 THEN 5.0 END AS breach FROM f WHERE rn >= 10 AND (rn - 10) % 2 = 0),
w AS (SELECT *, (breach - y) / slope AS m FROM p WHERE breach IS NOT NULL AND r2 >= 0.25 AND (breach - y) / slope BETWEEN 0 AND 20000)""" + thin_sql(
    "w", "tag", 6 * 3_600_000_000, name="tp")


@query("stream_trend", f"""WITH RECURSIVE {STREAM_TREND_SQL} SELECT tag AS series, us AS ts_us, round(y, 6) AS smooth, breach AS lim FROM tp""")
def _(spark, sf):
    """Every user's series judged for its trend, from kept readings."""
    base = charts.fit_baseline(user_readings(spark, sf), ["asset", "tag"])
    limits = table(spark, sf, "events").select(F.col("event_type").alias("tag"), F.lit(5.0).alias("low"), F.lit(95.0).alias("high")).distinct()
    out = live.run_to_parquet(detectors.chart_stream(event_stream(spark, sf), base, 10, limits, trend=(10, 3, 2), horizon_minutes=20_000,
                                                     trend_cooldown_s=6 * 3600), "trend")
    return out.filter("detector = 'Trend.Projection'").select(
        F.concat_ws("|", "asset", "tag").alias("series"), us("ts").alias("ts_us"), r6("value").alias("smooth"), "lim")


WINDOWS_SQL = f"""{READINGS_SQL}, win AS (SELECT r.*, unnest(range((us + 172799999999) // 172800000000 * 172800000000, us + 432000000000, 172800000000)) AS as_of FROM r)"""


@query("stream_windows", f"""WITH {WINDOWS_SQL} SELECT user_id, as_of AS as_of_us, count(*) AS n_values, count(DISTINCT tag) AS n_tags,
 min(us) AS oldest_us, max(us) AS newest_us, round(sum(value), 6) AS total FROM win GROUP BY ALL""")
def _(spark, sf):
    """The five-day buffer of every user, handed on every two days by its timer."""
    from ..streaming import buffer
    d = live.run_to_parquet(buffer.windows(event_stream(spark, sf), 5 * 86_400, 2 * 86_400), "windows")
    return d.groupBy(F.col("asset").cast("long").alias("user_id"), us("as_of").alias("as_of_us")).agg(
        F.count(F.lit(1)).alias("n_values"), F.count_distinct("tag").alias("n_tags"), F.min(us("ts")).alias("oldest_us"),
        F.max(us("ts")).alias("newest_us"), F.round(F.sum("value"), 6).alias("total"))


def peaks(windows):
    """One recommendation for each reading that tops its window's mean by a deviation, the same id in every window."""
    from ..functions.ids import stable_id
    key = ["asset", "scenario", "as_of", "tag"]
    s = windows.groupBy(*key).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    high = windows.join(s, key).filter(F.col("value") > F.col("m") + F.col("s"))
    return high.select(stable_id("peak", F.col("asset"), F.col("tag"), us("ts")).alias("id"), "asset", "tag", "ts", "value")


@query("stream_recommendations", f"""WITH {WINDOWS_SQL}, n AS (SELECT user_id, as_of FROM win GROUP BY ALL HAVING count(*) >= 10),
s AS (SELECT user_id, as_of, tag, avg(value) AS m, stddev_samp(value) AS s FROM win SEMI JOIN n USING (user_id, as_of) GROUP BY ALL)
SELECT DISTINCT user_id, tag, us AS ts_us, value FROM win JOIN s USING (user_id, as_of, tag) WHERE value > m + s""")
def _(spark, sf):
    """Readings to new recommendations: each peak once, in whichever of its windows it shows first."""
    import uuid
    from ..session import shared_dir
    from ..streaming import buffer
    path = f"{shared_dir(spark)}/recommendations-{uuid.uuid4().hex}"
    live.run_batches(buffer.windows(event_stream(spark, sf), 5 * 86_400, 2 * 86_400), "evaluate", buffer.evaluation_batches(path, peaks, 10))
    found = buffer.stored(spark, path)
    if found is None:
        found = spark.createDataFrame([], "asset string, tag string, ts timestamp, value double")
    return found.select(F.col("asset").cast("long").alias("user_id"), "tag", us("ts").alias("ts_us"), "value")


@query("stream_outbox", """SELECT user_id, event_type AS tag, count(DISTINCT user_id || event_type) AS n FROM events WHERE value > 90 GROUP BY ALL""")
def _(spark, sf):
    """Requests of high readings: each (user, tag) goes out once, whatever is replayed."""
    import uuid
    from ..session import shared_dir
    from ..streaming import buffer
    path = f"{shared_dir(spark)}/outbox-{uuid.uuid4().hex}"
    high = event_stream(spark, sf).filter("value > 90").withColumn("id", F.concat_ws("|", "asset", "tag"))
    send = lambda d, epoch: d.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{path}/received")
    live.run_batches(live.unseen(high.select("id", "asset", "tag", "ts"), "60 days"), "outbox", buffer.outbox_batches(path, send))
    sent = spark.read.schema("id string, asset string, tag string").parquet(f"{path}/received")
    return sent.groupBy(F.col("asset").cast("long").alias("user_id"), "tag").agg(F.count(F.lit(1)).alias("n"))
