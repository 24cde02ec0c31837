"""Planted faults, and chunked plans against plain ones."""

import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantwave.model import SERIES, dim_tag
from plantwave.operators import asof, charts, divergence, overlap, pca, rolling, sessions, windows
from plantwave.operators.alerts import after_warmup, run_starts
from plantwave.operators.scale import chunk_seconds_for
from plantwave.sources.samples import to_wide

from . import data


@pytest.fixture(scope="module")
def runs(spark):
    r = data.readings(spark, data.long(data.wide(), "normal"), data.long(data.spike(), "spike"),
                      data.long(data.drift(), "drift")).cache()
    base = charts.fit_baseline(r.filter("scenario = 'normal'"), ["asset", "tag"])
    return r, r.select(*SERIES).distinct().join(base, ["asset", "tag"]).cache()


def test_baseline_limits_are_symmetric(runs):
    _, base = runs
    bad = base.filter(F.abs(F.col("ucl") + F.col("lcl") - 2 * F.col("mean")) > 1e-9).count()
    assert bad == 0 and base.filter("sigma <= 0").count() == 0


def test_constant_series_gets_the_floor(spark):
    d = data.wide()
    d["column.RR"] = 5.5
    b = charts.fit_baseline(data.readings(spark, data.long(d)))
    assert b.filter("tag = 'column.RR'").first().sigma == 1e-9


def test_spike_is_one_shewhart_alert(runs):
    r, base = runs
    a = charts.shewhart_alerts(r.filter("scenario = 'spike' AND tag = 'cstr.T_R_C'"), base).collect()
    hot = [x for x in a if x.severity == "critical"]
    assert len(hot) == 1 and hot[0].ts == pd.Timestamp("2026-01-01 00:43:00") and hot[0].side == "above"
    assert hot[0].confidence == 1.0 and hot[0].extra.deviation_sigma > 8


def test_drift_is_found_by_ewma_cusum_and_trend(spark, runs):
    r, base = runs
    d = r.filter("scenario = 'drift' AND tag = 'cstr.T_R_C'")
    assert charts.ewma_alerts(d, base).count() > 0
    up = charts.cusum_alerts(d, base).collect()
    assert up and {x.extra.direction for x in up} == {"upward"}
    t = rolling.trend_alerts(d, dim_tag(spark), 60, 5, 1).collect()
    assert t and all(x.lim == 82.0 and x.extra.slope_per_minute > 0 for x in t)


def test_rising_away_from_a_low_limit_is_no_trend(spark):
    d = data.wide(200)
    d["column.purity_B"] = 99 + np.linspace(0, 0.5, 200)
    r = data.readings(spark, data.long(d[["ts", "column.purity_B"]]))
    assert rolling.trend_alerts(r, dim_tag(spark), 60, 5).count() == 0


def test_frozen_sensor(spark):
    d = data.wide(120)
    d.loc[40:90, "cstr.T_R_C"] = 78.25
    r = data.readings(spark, data.long(d[["ts", "cstr.T_R_C", "column.purity_B"]]))
    a = rolling.frozen_alerts(r, 20).orderBy("ts").collect()
    # rows 40..59 are flat, so the first alert is at row 60; the next after 30 minutes
    assert [x.ts.minute + 60 * x.ts.hour for x in a] == [60, 91]
    assert {x.tag for x in a} == {"cstr.T_R_C"} and a[0].value == 78.25


def test_warmup_cut(runs):
    r, base = runs
    a = charts.shewhart_alerts(r, base)
    late = after_warmup(a, run_starts(r), 15)
    assert late.filter("ts < timestamp'2026-01-01 00:15:00'").count() == 0
    assert late.filter("severity = 'critical' AND scenario = 'spike'").count() == 1


def alerts(spark, minutes, tag="t", severity=None, contributors=None):
    rows = [("a", "s", datetime(2026, 1, 1) + timedelta(minutes=m), "D", "k", (severity or {}).get(m, "low"), tag, None,
             float(m), 0.0, 1.0, "", (contributors or {}).get(m), None) for m in minutes]
    ddl = ("asset string, scenario string, ts timestamp, detector string, alert_type string, severity string, tag string, side string, "
           "value double, lim double, confidence double, message string, contributors map<string,double>, extra struct<x: double>")
    return spark.createDataFrame(rows, ddl)


@pytest.mark.parametrize("seconds", [None, 600])
def test_sessions_gap_rule(spark, seconds):
    s = sessions.sessionise(alerts(spark, [90, 0, 30, 61]), 30, seconds).orderBy("start_ts").collect()
    assert [(x.alert_count, x.duration_min) for x in s] == [(2, 30.0), (2, 29.0)]
    assert sessions.sessionise(alerts(spark, [0, 60, 120]), 30, seconds).count() == 3
    assert sessions.sessionise(alerts(spark, []), 30, seconds).count() == 0


def test_null_tag_groups_with_null_tag_and_peak_wins(spark):
    a = alerts(spark, [0, 10, 20], None, {10: "high", 20: "high"}, {0: {"x": 1.0}, 20: {"x": 0.5, "y": 2.0}})
    s = sessions.sessionise(a.unionByName(alerts(spark, [5]))).filter("tag IS NULL").collect()
    assert len(s) == 1 and s[0].peak_severity == "high" and s[0].peak_alert.value == 20.0
    assert s[0].first_alert.value == 0.0 and s[0].contributors == {"x": 1.0, "y": 2.0}


def random_readings(spark, seed=4, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(3):
        t = pd.Timestamp("2026-01-01") + pd.to_timedelta(np.cumsum(rng.integers(20, 400, n)), unit="s")
        v = rng.normal(0, 1, n)
        v[100:140] = 2.0
        v[200:260] += 4
        rows.append(pd.DataFrame({"asset": "a", "scenario": "s", "ts": t, "tag": f"t{k}", "value": v}))
    return data.readings(spark, *rows)


@pytest.mark.parametrize("name", ["shewhart", "ewma", "cusum", "frozen", "trend", "sessions", "training", "asof", "nearest",
                                  "recent", "windows", "fill", "divergence", "overlap"])
def test_chunked_plan_equals_plain_plan(spark, name):
    r = random_readings(spark).cache()
    base = charts.fit_baseline(r, SERIES)
    lim = spark.createDataFrame([(f"t{k}", -2.0, 3.0) for k in range(3)], "tag string, low double, high double")
    probes = r.filter("tag = 't0'").select("asset", "scenario", (F.col("ts") + F.expr("INTERVAL 7 SECONDS")).alias("ts"), F.lit("t1").alias("tag"))

    def run(sec):
        if name == "shewhart":
            return charts.shewhart_alerts(r, base, 600, seconds=sec)
        if name == "ewma":
            return charts.ewma_alerts(r, base, 600, seconds=sec)
        if name == "cusum":
            return charts.cusum_alerts(r, base, 1800, seconds=sec)
        if name == "frozen":
            return rolling.frozen_alerts(r, 8, seconds=sec)
        if name == "trend":
            return rolling.trend_alerts(r, lim, 15, 3, 2, min_r2=0.05, seconds=sec)
        if name == "sessions":
            return sessions.sessionise(charts.shewhart_alerts(r, base, 60), 30, sec)
        if name == "training":
            return charts.training_rows(r, 0.3, seconds=sec)
        if name == "asof":
            return asof.asof_backward(probes, r, seconds=sec, at="at")
        if name == "nearest":
            return asof.asof_nearest(probes, r, seconds=sec)
        if name == "recent":
            return asof.recent_mean(probes, r, 30, seconds=sec)
        if name == "windows":
            w = r.select("asset", F.col("tag").alias("scenario"), "ts", "value")
            return windows.forecast_windows(w, ["value"], ["value"], 7, 4, seconds=sec).withColumn("x", F.to_json("x")).withColumn("y", F.to_json("y"))
        if name == "fill":
            return windows.fill_both_ways(r.withColumn("value", F.when(F.col("value") > 1, F.col("value"))), ["value"], SERIES, seconds=sec)
        if name == "divergence":
            d = r.select(*SERIES, "ts", F.col("value").alias("actual"), F.lit(0.0).alias("predicted"), F.lit(0.3).alias("std"))
            return divergence.divergence_runs(d, SERIES, 3, 40, seconds=sec)
        s = sessions.sessionise(charts.shewhart_alerts(r, base, 60).unionByName(charts.cusum_alerts(r, base, 60)), 20)
        return overlap.co_occurrence_counts(s, 45, seconds=sec)

    def rows(df):
        df = df.select(*[F.round(c, 8).alias(c) if t == "double" else (F.to_json(c).alias(c) if t[:3] in ("str", "map") and t != "string" else F.col(c))
                         for c, t in df.dtypes])
        p = df.toPandas().astype(str)[sorted(df.columns)]
        for c in p.columns:  # nested numbers agree to rounding only
            p[c] = p[c].map(lambda v: re.sub(r"-?\d+\.\d{6,}", lambda m: f"{float(m.group()):.6f}", v))
        return p.sort_values(list(p.columns)).reset_index(drop=True)
    plain, chunked = rows(run(None)), rows(run(1800))
    assert len(plain) > 0
    pd.testing.assert_frame_equal(plain, chunked)


def test_chunk_width_depends_on_the_busiest_series(spark):
    r = random_readings(spark)
    assert chunk_seconds_for(r, SERIES) is None
    sec = chunk_seconds_for(r, SERIES, target_rows=50)
    assert sec and sec < 400 * 400
    assert chunk_seconds_for(r.limit(0), SERIES) is None


def test_overlap_counts_equal_pairs(spark):
    rng = np.random.default_rng(11)
    rows = []
    for det in "AB":
        for tag in ("x", None):
            t = 0
            for i in range(25):
                t += int(rng.integers(30, 400))
                end = t + int(rng.integers(0, 300))
                rows.append(("a", "s", f"{det}{tag}{i}", det, tag, datetime(2026, 1, 1) + timedelta(minutes=t),
                             datetime(2026, 1, 1) + timedelta(minutes=end)))
                t = end
    s = spark.createDataFrame(rows, "asset string, scenario string, session_id string, detector string, tag string, start_ts timestamp, end_ts timestamp")
    got = {(r.session_id, r.o_detector, r.o_tag): r.n for r in overlap.co_occurrence_counts(s, 90).collect()}
    want = {}
    for x in rows:
        for y in rows:
            if x is not y and (abs(x[5] - y[5]) <= timedelta(minutes=90) or (y[5] <= x[6] and y[6] >= x[5])):
                key = (x[2], y[3], y[4])
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(size=(300, 2))
    x = f @ rng.normal(size=(2, 5)) + 0.3 * rng.normal(size=(300, 5))
    cols = list("pqrst")
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(i=range(300)))
    m = pca.fit_pca(df, cols)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w, v = np.linalg.eigh(np.corrcoef(z.T))
    w, v = w[::-1], v[:, ::-1]
    k = int(np.searchsorted(np.cumsum(w) / w.sum(), 0.9)) + 1
    assert m.n_components == k and np.allclose(m.eigenvalues, w[:k])
    s = z @ v[:, :k]
    got = pca.score_pca(df, m).orderBy("i").toPandas()
    assert np.allclose(got.t2, (s ** 2 / w[:k]).sum(1)) and np.allclose(got.spe, ((z - s @ v[:, :k].T) ** 2).sum(1))
    old = pca.ONE_AGG_COLUMNS
    pca.ONE_AGG_COLUMNS = 3
    try:
        other = pca.score_pca(df, pca.fit_pca(df, cols)).orderBy("i").toPandas()
    finally:
        pca.ONE_AGG_COLUMNS = old
    assert np.allclose(other.t2, got.t2) and np.allclose(other.spe, got.spe)
    assert other.contributors.map(lambda c: sorted(dict(c))).tolist() == got.contributors.map(lambda c: sorted(dict(c))).tolist()
    assert pca.PcaModel.from_table(m.to_table(spark)) == m


def test_pca_alerts_on_a_broken_correlation(spark):
    d = data.wide(300)
    d["column.T_bot_C"] = 117.8 + 3 * (d["column.T_top_C"] - 70) + np.random.default_rng(1).normal(0, 0.05, 300)
    train = data.readings(spark, data.long(d[["ts", "column.T_bot_C", "column.T_top_C", "column.RR"]]))
    w = to_wide(train, ["column.T_bot_C", "column.T_top_C", "column.RR"])
    cols = ["column_T_bot_C", "column_T_top_C", "column_RR"]
    m = pca.fit_pca(w, cols)
    bad = w.withColumn("column_T_bot_C", F.when(F.minute("ts") == 30, F.lit(120.0)).otherwise(F.col("column_T_bot_C")))
    a = pca.pca_alerts(bad, m).filter("detector = 'PCA.SPE' AND minute(ts) = 30").collect()
    assert a and a[0].tag is None and "column_T_bot_C" in a[0].contributors
    with pytest.raises(ValueError):
        pca.fit_pca(w.limit(10), cols)


def test_pca_per_asset_equals_a_model_of_its_own(spark):
    rng = np.random.default_rng(5)
    frames = []
    for k, n in enumerate([400, 60, 29, 50]):
        x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, 4)) + 0.2 * rng.normal(size=(n, 4)) + 10 * k
        if k == 1:
            x[:, 3] = 7.0  # one tag stands still
        if k == 3:
            x[:] = 1.0  # all of them do
        frames.append(pd.DataFrame(x, columns=list("pqrs")).assign(asset=f"a{k}"))
    pdf = pd.concat(frames, ignore_index=True).assign(i=lambda d: range(len(d)))
    df = spark.createDataFrame(pdf).withColumn("p", F.when(F.col("i") != 3, F.col("p")))
    cols = list("pqrs")
    models = pca.fit_pca_by(df.union(df.limit(1).withColumn("asset", F.lit(None).cast("string"))), cols)
    got = pca.score_pca_by(df, models, cols, top=2).orderBy("i").toPandas()
    assert sorted(r.asset for r in models.collect()) == ["a0", "a1"]
    for asset in ("a0", "a1"):
        mine = df.filter(F.col("asset") == asset)
        one = pca.fit_pca(mine, cols)
        table = pca.PcaModel.from_table(models.filter(F.col("asset") == asset).drop("asset"))
        assert (table.n_components, table.n_train) == (one.n_components, one.n_train)
        assert np.allclose([table.t2_limit, table.spe_limit], [one.t2_limit, one.spe_limit])
        want, have = pca.score_pca(mine, one, top=2).orderBy("i").toPandas(), got[got.asset == asset]
        assert have.i.tolist() == want.i.tolist()
        assert np.allclose(have.t2, want.t2) and np.allclose(have.spe, want.spe)
        assert have.contributors.map(lambda c: sorted(dict(c))).tolist() == want.contributors.map(lambda c: sorted(dict(c))).tolist()
    with pytest.raises(ValueError):
        pca.moments_by(df, ["p"] * 33, ["asset"])
    assert pca.score_pca_by(df.limit(0), models.limit(0), cols).count() == 0


def test_pca_alerts_per_asset(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(3):
        x = rng.normal(size=(200, 1)) @ np.array([[1.0, 2.0 - k, 0.5]]) + 0.05 * rng.normal(size=(200, 3)) + 100 * k
        x[150] += [0, 3, 0] if k == 1 else 0
        rows.append(pd.DataFrame(x, columns=list("pqr")).assign(asset=f"a{k}", scenario="s",
                                                                ts=pd.date_range("2026-01-01", periods=200, freq="1min")))
    w = spark.createDataFrame(pd.concat(rows))
    fit = pca.fit_pca_by(w.filter("ts < timestamp'2026-01-01 02:00:00'"), list("pqr"))
    a = pca.pca_alerts_by(w, fit, list("pqr"), cooldown_s=0).filter("detector = 'PCA.SPE' AND ts = timestamp'2026-01-01 02:30:00'").collect()
    assert "a1" in {r.asset for r in a} and all("q" in r.contributors for r in a if r.asset == "a1")


def test_points_in_the_future_and_warm_up(spark):
    t = pd.date_range("2026-01-01", periods=8, freq="1min")
    pdf = pd.concat([pd.DataFrame({"asset": "a", "scenario": "long", "ts": t, "v": np.arange(8.0)}),
                     pd.DataFrame({"asset": "a", "scenario": "short", "ts": t[:2], "v": [1.0, 2.0]}),
                     pd.DataFrame({"asset": "b", "scenario": "empty", "ts": t[:1], "v": [np.nan]})])
    w = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    for seconds in (None, 60):
        now = {r.scenario: r for r in windows.latest_windows(w, ["v"], 3, seconds=seconds).collect()}
        assert [x.v for x in now["long"].x] == [5.0, 6.0, 7.0] and not now["long"].warming_up and now["long"].ts == t[-1]
        assert (now["short"].have, now["short"].needs, now["short"].warming_up, now["short"].x) == (2, 3, True, None)
        assert (now["empty"].have, now["empty"].ts, now["empty"].warming_up) == (0, None, True)
    made = spark.createDataFrame(pd.DataFrame({"asset": "a", "scenario": "long", "ts": [t[5]], "trajectory": [[9.0, 8.0, 7.0, 6.0]]}))
    read = w.withColumnRenamed("v", "value")
    every = windows.aligned_forecasts(made, read, ["asset", "scenario"], 60_000_000, future=True).orderBy("pos").collect()
    assert [(r.predicted, r.actual) for r in every] == [(9.0, 6.0), (8.0, 7.0), (7.0, None), (6.0, None)]
    assert windows.aligned_forecasts(made, read, ["asset", "scenario"], 60_000_000).count() == 2
