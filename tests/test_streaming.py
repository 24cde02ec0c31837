"""Streams over several micro-batches give the batch answer."""

import os
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantwave.operators import charts, drift, quality, rolling, sessions
from plantwave.operators.recurrences import thin
from plantwave.operators.rolling import frozen_windows
from plantwave.streaming import buffer, detectors, live

DDL = "asset string, scenario string, ts timestamp, tag string, value double"


def make(seed=3, n=400):
    rng = np.random.default_rng(seed)
    out = []
    for tag in "xy":
        t = pd.Timestamp("2026-01-01") + pd.to_timedelta(np.cumsum(rng.integers(30, 90, n)), unit="s")
        v = rng.normal(0, 1, n)
        v[150:200] = 1.5
        v[250:300] += 3
        out.append(pd.DataFrame({"asset": "a", "scenario": "live", "ts": t, "tag": tag, "value": v}))
    return pd.concat(out).sort_values("ts")


@pytest.fixture()
def feed(spark, tmp_path):
    """The same readings as static rows and as a stream of five files."""
    pdf = make()
    static = spark.createDataFrame(pdf, DDL)
    for i, part in enumerate(np.array_split(np.arange(len(pdf)), 5)):
        spark.createDataFrame(pdf.iloc[part], DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return static, stream


def test_charts_match_batch(spark, feed):
    static, stream = feed
    base = charts.fit_baseline(static, ["asset", "tag"])
    got = live.run_to_parquet(detectors.chart_stream(stream, base, 20), "t").toPandas()
    per = static.select("asset", "scenario", "tag").distinct().join(base, ["asset", "tag"])
    keys = ["asset", "scenario", "tag"]
    want = {
        "SPC.Shewhart": charts.shewhart_alerts(static, per), "SPC.EWMA": charts.ewma_alerts(static, per),
        "Regime.CUSUM": charts.cusum_alerts(static, per), "FrozenSensor": thin(frozen_windows(static, 20), keys, 1800),
    }
    for name, df in want.items():
        a = sorted((r.tag, r.ts) for r in df.select("tag", "ts").collect())
        b = sorted((t, ts.to_pydatetime()) for t, ts in got[got.detector == name][["tag", "ts"]].itertuples(index=False))
        assert a and a == b, name


def test_late_rows_are_dropped_by_charts(spark, tmp_path):
    base = spark.createDataFrame([("a", "t", 0.0, 1.0, 3.0, -3.0, 1 / 3, 1.0, -1.0)],
                                 "asset string, tag string, mean double, sigma double, ucl double, lcl double, ewma_sigma double, ewma_ucl double, ewma_lcl double")
    t0 = datetime(2026, 1, 1)
    for i, minutes in enumerate(([0, 20], [10, 40])):
        spark.createDataFrame([("a", "s", t0 + timedelta(minutes=m), "t", 9.0) for m in minutes], DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.run_to_parquet(detectors.chart_stream(files, base), "late")
    assert sorted(r.ts.minute for r in out.filter("detector = 'SPC.Shewhart'").collect()) == [0, 20, 40]


def test_charts_count_what_they_drop(spark, tmp_path):
    base = charts.fit_baseline(spark.createDataFrame(make(), DDL).filter("tag = 'x'"), ["asset", "tag"])
    t0 = datetime(2026, 1, 1)
    for batch in ([("x", 0), ("x", 20), ("new", 0)], [("x", 10), ("x", 15), ("x", 40), ("new", 5), ("new", 6)]):
        rows = [("a", "s", t0 + timedelta(minutes=m), tag, 0.0) for tag, m in batch]
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.run_to_parquet(detectors.chart_stream(files, base), "counts").groupBy("tag", "detector").agg(F.sum("value"))
    assert sorted(map(tuple, out.collect())) == [("new", detectors.UNKNOWN, 3.0), ("x", detectors.LATE, 2.0)]
    assert detectors.without_baseline(spark.read.parquet(str(tmp_path / "in")), base).count() == 3


def test_sessions_match_batch(spark, feed):
    static, stream = feed
    a = lambda d: d.filter("value > 2").withColumn("detector", F.lit("D")).withColumn("severity", F.lit("low"))
    got = live.run_to_parquet(live.session_stream(a(stream), "10 minutes"), "s")
    full = a(static).select("*", F.lit("k").alias("alert_type"), F.lit(None).cast("string").alias("side"), F.lit(0.0).alias("lim"),
                            F.lit(1.0).alias("confidence"), F.lit("").alias("message"), F.lit(None).cast("map<string,double>").alias("contributors"),
                            F.lit(None).cast("string").alias("extra"))
    want = sessions.sessionise(full, 10)
    key = ["tag", "start_ts", "end_ts", "alert_count"]
    rows = lambda d: sorted(tuple(r) for r in d.select(*key).collect())
    assert rows(want) == rows(got.withColumnRenamed("tag_key", "tag")) and rows(want)


def test_quality_matches_batch(spark, feed):
    static, stream = feed
    m = spark.createDataFrame([("x", -2.0, 2.0), ("y", None, 3.0)], "tag string, min_range double, max_range double")
    rnd = lambda d: d.withColumn("value", F.round("value"))
    got = live.run_to_parquet(detectors.quality_stream(rnd(stream), m, 120), "q")
    want = quality.quality_flags(rnd(static), m, stale_s=120)
    rows = lambda d: sorted((r.tag, r.ts, r.quality) for r in d.select("tag", "ts", "quality").collect())
    assert rows(got) == rows(want) and {q for _, _, q in rows(want)} == {0, 1, 2}


def test_unseen_and_downsample(spark, feed):
    static, stream = feed
    out = live.run_to_parquet(live.unseen(stream.withColumn("id", F.col("tag")), "1 day"), "u")
    assert out.count() == 2
    got = live.run_to_parquet(live.downsample_stream(stream, "10 minutes", "last"), "d")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.downsample_stream(static, "10 minutes", "last").collect()))


def test_deferred_outcomes(spark, feed):
    static, stream = feed
    due = lambda d: d.filter("tag = 'y' AND value > 1.4 AND ts < timestamp'2026-01-01 04:00:00'").select(
        F.concat_ws("|", "tag", F.unix_micros("ts")).alias("id"), "asset", F.lit("x").alias("tag"),
        (F.col("ts") + F.expr("INTERVAL 20 MINUTES")).alias("due_ts"), F.lit(1.0).alias("predicted"))
    got = live.run_to_parquet(live.deferred_outcomes(due(stream), stream.filter("tag = 'x'"), "5 minutes", "1 minute"), "o").collect()
    x = static.filter("tag = 'x'").toPandas()
    want = {}
    for r in due(static).collect():
        gap = (x.ts - pd.Timestamp(r.due_ts)).abs()
        want[r.id] = x.value[gap.idxmin()]
    assert got and {r.id for r in got} <= set(want)
    assert len(got) > 0.8 * len(want)
    assert all(r.actual == pytest.approx(want[r.id]) for r in got)


def test_every_decision_has_its_outcome(spark, tmp_path):
    """Sparse readings, ties, and decisions due near and after the end of the stream."""
    t0, minute = datetime(2026, 1, 1), timedelta(minutes=1)
    reads = [("a", "x", t0 + m * minute, float(m)) for m in (0, 3, 7, 40, 42, 90, 118)]
    due = [(f"d{m}", "a", "x", t0 + m * minute, 10.0) for m in (0, 5, 20, 38, 41, 60, 89, 113, 119, 121, 130, 500)]
    due += [("other", "b", "x", t0 + 5 * minute, 10.0), ("none", "a", None, t0 + 5 * minute, 10.0)]
    ddl = {"r": "asset string, tag string, ts timestamp, value double",
           "d": "id string, asset string, tag string, due_ts timestamp, predicted double"}
    streams, static = {}, {}
    for k, rows in (("r", reads), ("d", sorted(due, key=lambda x: x[3]))):
        static[k] = spark.createDataFrame(rows, ddl[k])
        for part in np.array_split(np.arange(len(rows)), 3):
            spark.createDataFrame([rows[i] for i in part], ddl[k]).coalesce(1).write.mode("append").parquet(str(tmp_path / k))
        streams[k] = spark.readStream.schema(ddl[k]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / k))
    want = {}
    for i, asset, tag, ts, _ in due:
        near = [(abs(t - ts), t, v) for a, g, t, v in reads if (a, g) == (asset, tag) and abs(t - ts) <= 5 * minute]
        want[i] = min(near)[2] if near else None
    assert want["d5"] == 3.0 and want["d20"] is None and want["d121"] == 118.0
    rows = lambda d: sorted((tuple(r) for r in d.select("id", "asset", "tag", "predicted", "actual", "dev_pct", "within").collect()), key=str)
    got = rows(live.run_to_parquet(live.deferred_outcomes(streams["d"], streams["r"], "5 minutes", "10 minutes"), "o"))
    assert {r[0]: r[4] for r in got} == want and len(got) == len(want)
    assert got == rows(live.deferred_outcomes(static["d"], static["r"], "5 minutes", "10 minutes"))


def test_deferred_outcomes_query_answers_all(spark):
    import __spark_entry__ as entry
    from plantwave.catalog.registry import user_readings
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    e = user_readings(spark, sf).select("asset", "tag", "ts", "value").toPandas()
    want = {}
    for a, ts in e[e.tag == "error"][["asset", "ts"]].itertuples(index=False):
        x = e[(e.asset == a) & (e.tag == "purchase")]
        due = ts + pd.Timedelta(days=1)
        gap = (x.ts - due).abs()
        near = sorted(zip(gap[gap <= pd.Timedelta(days=1)], x.ts[gap <= pd.Timedelta(days=1)], x.value[gap <= pd.Timedelta(days=1)]))
        want[f"{a}|{ts.value // 1000}"] = near[0][2] if near else None
    got = entry.queries()["stream_deferred_outcomes"](spark, sf).collect()
    assert len(got) == len(want) and {r.id: r.actual for r in got} == want


def test_foreach_batch_bodies(spark, feed):
    static, stream = feed
    store, bodies = {}, []
    def evaluate(d):
        return d.filter("value > 3").select(F.concat_ws("|", "tag", F.unix_micros("ts")).alias("id"), "ts")
    def sink(d, i):
        rows = [r.id for r in d.collect()]
        assert not set(rows) & set(store)
        store.update(dict.fromkeys(rows, i))
    seen = lambda: spark.createDataFrame([(k,) for k in store], "id string") if store else None
    live.run_batches(stream, "evaluate", live.evaluation_batches(lambda b: static, evaluate, seen, sink))
    assert set(store) == {r.id for r in evaluate(static).collect()} and len(set(store.values())) == 1
    few = live.evaluation_batches(lambda b: static.limit(5), evaluate, seen, lambda d, i: bodies.append(i))
    few(static, 0)
    assert bodies == []
    recs = spark.createDataFrame([("1", "critical"), ("2", "low")], "id string, urgency string").selectExpr(
        "*", "'s' scenario", "timestamp'2026-01-01' ts", "'R' rule_id", "'d' diagnosis", "'go' action_text")
    live.routing_batches(lambda d, i: bodies.extend(r.id for r in d.collect()))(recs, 0)
    assert bodies == ["1"]
    end = F.lit("2026-01-01 01:00:00").cast("timestamp")
    assert live.emitted_between(static, None, end).count() > live.emitted_between(static, F.lit("2026-01-01 00:30:00").cast("timestamp"), end).count() > 0


# --- the live path -------------------------------------------------------------------------------------

def files(spark, path, frames, ddl=DDL):
    for part in frames:
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_all_five_detectors_match_batch(spark, feed):
    static, stream = feed
    base = charts.fit_baseline(static, ["asset", "tag"])
    limits = spark.createDataFrame([("x", -4.0, 4.0), ("y", None, 3.5)], "tag string, low double, high double")
    got = live.run_to_parquet(detectors.chart_stream(stream, base, 20, limits, trend=(12, 3, 2), horizon_minutes=400,
                                                     trend_cooldown_s=900), "five").toPandas()
    want = rolling.trend_alerts(static, limits, 12, 3, 2, horizon_minutes=400, cooldown_s=900).toPandas()
    key = lambda d: sorted((t, pd.Timestamp(ts), round(v, 6), lim, s) for t, ts, v, lim, s in d[["tag", "ts", "value", "lim", "side"]].itertuples(index=False))
    assert len(want) > 5 and key(got[got.detector == "Trend.Projection"]) == key(want)
    assert set(got.detector) == {"SPC.Shewhart", "SPC.EWMA", "Regime.CUSUM", "FrozenSensor", "Trend.Projection"}


def test_running_sums_equal_plain_fits():
    rng = np.random.default_rng(2)
    us, x = np.cumsum(rng.integers(1, 90, 200)) * 1_000_000, rng.normal(50, 2, 200)
    x[100:140] = 7.0
    due, y, slope, r2 = detectors.trend_of_new(us, x, 60, 140, 10, 3, 3)
    assert [(d + 1 - 10) % 3 for d in due] == [0] * 20 and due.min() >= 140
    for k, i in enumerate(due):
        s = [x[max(0, j - 2):j + 1].mean() for j in range(i - 9, i + 1)]
        t = (us[i - 9:i + 1] - us[0]) / 60e6
        m = np.polyfit(t, s, 1)[0]
        assert y[k] == pytest.approx(s[-1]) and slope[k] == pytest.approx(m)
        assert r2[k] == pytest.approx(np.corrcoef(t, s)[0, 1] ** 2)


def test_state_of_silent_series_ends(spark, tmp_path):
    base = spark.createDataFrame([("a", t, 0.0, 1.0, 3.0, -3.0, 1 / 3, 1.0, -1.0) for t in "xy"],
                                 "asset string, tag string, mean double, sigma double, ucl double, lcl double, ewma_sigma double, ewma_ucl double, ewma_lcl double")
    t0 = datetime(2026, 1, 1)
    rows = lambda tag, *days: [("a", "s", t0 + timedelta(days=d), tag, 0.5) for d in days]
    feed = files(spark, tmp_path / "in", [rows("x", 0) + rows("y", 0), rows("y", 1, 2), rows("y", 9), rows("y", 10)])
    progress = []
    live.run_to_parquet(detectors.chart_stream(feed, base, ttl_s=3 * 86_400), "silent", progress=progress)
    held = [p.stateOperators[0].numRowsTotal for p in progress]
    assert held[-1] < max(held)


def test_windows_and_recommendations_match_batch(spark, tmp_path):
    from plantwave.catalog.learning import peaks
    pdf = make(5, 300)
    pdf.loc[pdf.index[::37], "value"] += 9
    pdf = pd.concat([pdf, pdf.assign(asset="b", ts=pdf.ts + pd.Timedelta(hours=3))]).sort_values("ts")
    static = spark.createDataFrame(pdf, DDL)
    stream = files(spark, tmp_path / "in", [pdf.iloc[i] for i in np.array_split(np.arange(len(pdf)), 5)])
    progress = []
    got = live.run_to_parquet(buffer.windows(stream, 3600, 1500, "1 minute"), "w", progress=progress)
    want = buffer.windows_of(static, 3600, 1500)
    rows = lambda d: sorted(map(tuple, d.select("asset", "scenario", "as_of", "ts", "tag", "value").collect()))
    assert rows(got) == rows(want) and want.count() > 2 * len(pdf)
    assert progress[-1].stateOperators[0].numRowsTotal == 0
    path = str(tmp_path / "recs")
    body = buffer.evaluation_batches(path, peaks, 10)
    live.run_batches(buffer.windows(stream, 3600, 1500, "1 minute"), "e", body)
    found = [r.id for r in buffer.stored(spark, path).collect()]
    enough = want.groupBy("asset", "scenario", "as_of").count().filter("count >= 10")
    ready = want.join(enough, ["asset", "scenario", "as_of"], "left_semi")
    assert len(found) == len(set(found)) and set(found) == {r.id for r in peaks(ready).collect()} and found
    epoch = buffer.stored(spark, path).agg(F.max("epoch")).first()[0]
    body(ready, epoch)  # a replayed epoch replaces its own rows only
    assert sorted(r.id for r in buffer.stored(spark, path).collect()) == sorted(found)


def test_an_id_fires_once_for_ever(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    ddl = "id string, ts timestamp"
    batches = [[("a", t0), ("b", t0)], [("a", t0 + timedelta(minutes=5)), ("c", t0)], [("b", t0 + timedelta(minutes=9))]]
    stream = files(spark, tmp_path / "in", batches, ddl)
    sent, path = [], str(tmp_path / "out")
    body = buffer.outbox_batches(path, lambda d, e: sent.extend((r.id, e) for r in d.collect()))
    kept = []
    live.run_batches(live.unseen(stream, "1 day"), "once", lambda b, e: (kept.append((b.collect(), e)), body(b, e)))
    assert sorted(i for i, _ in sent) == ["a", "b", "c"]
    for rows, epoch in kept:
        body(spark.createDataFrame(rows, ddl), epoch)
    assert len(sent) == 3 and sorted(r.id for r in spark.read.parquet(f"{path}/rows").collect()) == ["a", "b", "c"]


def test_drift_counts_add_up(spark, feed):
    """Several micro-batches give one report, and the reference is not read by the body."""
    static, stream = feed
    ref = static.limit(300).checkpoint()
    edges = drift.bin_edges(ref).checkpoint()
    counts = drift.histogram(ref, edges).checkpoint()
    seen = []
    body = live.drift_batches(edges, counts, lambda d, e: seen.append(sorted(map(tuple, d.collect()))))
    live.run_batches(live.drift_counts(stream, edges), "drift", body, "complete")
    assert len(seen) == 5 and seen[-1] == sorted(map(tuple, drift.psi_report(ref, static, edges=edges).collect()))
    assert seen[0] != seen[-1]


def test_append_streams_end_their_state(spark, feed):
    _, stream = feed
    alerts = stream.filter("value > 2").withColumn("detector", F.lit("D")).withColumn("severity", F.lit("low"))
    for name, d in (("s", live.session_stream(alerts, "10 minutes", "1 minute")), ("b", live.rolling_buffer(stream, "20 minutes", "10 minutes", "1 minute")),
                    ("d", live.downsample_stream(stream, "10 minutes", "last", "1 minute"))):
        progress = []
        assert live.run_to_parquet(d, name, progress=progress).count() >= 10
        held = [p.stateOperators[0].numRowsTotal for p in progress]
        assert held[-1] == 0 and max(held) < 20
