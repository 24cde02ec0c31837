"""Quantiles, drift, operating points, models, physics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantwave.functions import faults, physics
from plantwave.functions.stats import f_quantile, residual_limit
from plantwave.operators import divergence, drift, learn, pareto, reports, scale, windows
from plantwave.operators.quantiles import exact_quantiles


def test_f_quantile_table_values():
    # published upper 1 % and 5 % points
    assert f_quantile(0.99, 3, 20) == pytest.approx(4.938, abs=1e-3)
    assert f_quantile(0.95, 1, 10) == pytest.approx(4.965, abs=1e-3)
    assert f_quantile(0.99, 8, 120) == pytest.approx(2.663, abs=1e-3)
    assert residual_limit([], 0.99) == float("inf")


@pytest.mark.parametrize("ties", [False, True])
def test_bucketed_quantiles_equal_numpy(spark, ties):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 5000)
    x = np.round(x, 0) if ties else x
    d = spark.createDataFrame(pd.DataFrame({"k": ["hot"] * 4500 + ["cold"] * 500, "v": x}))
    probs = [0, 0.1, 0.25, 0.5, 0.95, 1]
    got = {r.k: r.quantiles for r in exact_quantiles(d, ["k"], "v", probs, max_group_rows=100, buckets=16).collect()}
    assert np.allclose(got["hot"], np.quantile(x[:4500], probs)) and np.allclose(got["cold"], np.quantile(x[4500:], probs))


def psi_by_hand(ref, liv, edges):
    e = np.array(edges)
    e[0], e[-1] = -np.inf, np.inf
    p = np.clip(np.histogram(ref, e)[0] / max(1, len(ref)), 1e-6, None)
    q = np.clip(np.histogram(liv, e)[0] / max(1, len(liv)), 1e-6, None)
    return max(0.0, float(((q - p) * np.log(q / p)).sum()))


def test_drift_against_a_hand_count(spark):
    rng = np.random.default_rng(0)
    ref = pd.DataFrame({"T": rng.normal(120, 2, 2000), "RR": rng.normal(5.5, .2, 2000), "const": 1.0, "gone": rng.normal(0, 1, 2000)})
    liv = pd.DataFrame({"T": rng.normal(128, 2, 500), "RR": rng.normal(5.5, .2, 500), "const": 1.0})
    mk = lambda d: spark.createDataFrame(d.melt(var_name="tag", value_name="value"))
    for rows in (10**6, 50):
        e = {r.tag: r.edges for r in drift.bin_edges(mk(ref), max_group_rows=rows).collect()}
        assert all(b > a for a, b in zip(e["const"], e["const"][1:]))
        rep = drift.psi_report(mk(ref), mk(liv), max_group_rows=rows).cache()
        got = {r.tag: r for r in rep.collect()}
        for t in ("T", "RR", "const"):
            assert got[t].psi == pytest.approx(psi_by_hand(ref[t], liv[t], e[t]), abs=1e-9)
        assert got["T"].status == "significant" and got["RR"].status == "none"
        assert (got["gone"].psi, got["gone"].n_live) == (0.0, 0)
        assert drift.overall(rep).first().worst_feature == "T"


def test_salted_join_is_the_plain_join(spark, monkeypatch):
    big = spark.range(2000).selectExpr("CASE WHEN id < 1500 THEN 'hot' ELSE concat('k', id % 7) END AS k", "id")
    small = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(5)], "k string, p int")
    want = sorted(map(tuple, big.join(small, "k").select("k", "id", "p").collect()))
    assert sorted(map(tuple, scale.salted_join(big, small, ["k"], F.col("id")).select("k", "id", "p").collect())) == want
    monkeypatch.setattr(scale, "fits", lambda *a: False)
    assert sorted(map(tuple, scale.attach_small(big, small, ["k"], F.col("id")).select("k", "id", "p").collect())) == want


def test_drift_single_value_reference(spark):
    one = spark.createDataFrame([("t", 3.0)], "tag string, value double")
    assert drift.bin_edges(one).first().edges == [2.5, 3.5]
    assert drift.live_window(one.withColumn("ts", F.current_timestamp()), 100).count() == 0


def brute(p):
    return np.array([not any((q <= a).all() and (q < a).any() for q in p) for a in p])


@pytest.mark.parametrize("slice_rows, cell_rows", [(20000, 2000), (15, 5)])
def test_skyline_equals_brute_force(spark, slice_rows, cell_rows):
    rng = np.random.default_rng(6)
    x = np.round(rng.random((300, 3)), 2)
    x[:5] = x[5:10]
    d = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(300))).repartition(4)
    obj = [("a", "minimize"), ("b", "maximize"), ("c", "minimize")]
    signed = x * [1, -1, 1]
    got = {r.id for r in pareto.pareto_front(d, obj, slice_rows, cell_rows).collect()}
    assert got == set(np.flatnonzero(brute(signed)))
    cur = d.filter("id < 40")
    front = pareto.pareto_front(d, obj)
    spec = [("a", "minimize", 1.0, 0.0, 1.0), ("b", "maximize", 0.5, 0.0, 1.0), ("c", "minimize", 2.0, 0.0, 1.0)]
    gaps = {r.id: r for r in pareto.improvement_gap(cur, front, spec, "id", "id", slice_rows=slice_rows, cell_rows=cell_rows).collect()}
    f = signed[sorted(got)]
    for i in range(40):
        ok = (f <= signed[i]).all(1) & (f < signed[i]).any(1)
        best = (np.maximum(signed[i] - f, 0) * [1, .5, 2]).sum(1)[ok].max() if ok.any() else 0
        assert (i in gaps) == (best >= 0.05)
        if i in gaps:
            assert gaps[i].distance == pytest.approx(best)


def test_few_cells_meet(spark):
    """Of the cells of a full cube only a surface is left, and pairs grow far slower than with every cell against every other."""
    d = pareto.uniform_points(spark, 20_000, {"a": (0.0, 1.0), "b": (0.0, 1.0), "c": (0.0, 1.0)})
    cols = ["a", "b", "c"]
    counts = []
    for cell_rows in (300, 40):
        boxes = pareto.cell_boxes(pareto.with_cells(d, cols, pareto.grid_cuts(d, cols, 20_000, cell_rows)), cols)
        pairs = pareto.meeting_cells(boxes, cols)
        left = {a for a, _ in pairs}
        sent = sum(int(n) * sum(1 for a, _ in pairs if a == c) for c, n in zip(boxes["_cell"], boxes["n"]) if c in left)
        rows = int(boxes[boxes["_cell"].isin(left)]["n"].sum())
        counts.append((len(boxes), len(pairs), sent / rows))
        assert len(left) < 0.75 * len(boxes) and len(pairs) < 0.2 * len(boxes) ** 2
    assert counts[1][1] / counts[0][1] < (counts[1][0] / counts[0][0]) ** 2


def test_gain_cells_keep_the_best(spark):
    """A front cell is only left out where another one is surely better."""
    rng = np.random.default_rng(12)
    front, now, w = rng.random((400, 2)), rng.random((300, 2)) + 0.3, np.array([1.0, 3.0])
    cut = lambda x: (x * 8).astype(int) @ [100, 1]
    def boxes(x):
        t = pd.DataFrame(x, columns=["a", "b"]).assign(_cell=cut(x)).groupby("_cell").agg(
            n=("a", "size"), loa=("a", "min"), hia=("a", "max"), lob=("b", "min"), hib=("b", "max"))
        return t.reset_index()
    pairs = pareto.gaining_cells(boxes(now), boxes(front), ["a", "b"], w)
    order = np.argsort(front @ w)
    best = pareto.first_dominating(now, front[order], 7)
    for k, j in enumerate(best):
        good = np.flatnonzero((front[order] <= now[k]).all(1) & (front[order] < now[k]).any(1))
        assert j == (good[0] if len(good) else -1)
        assert j < 0 or (cut(now)[k], cut(front[order])[j]) in pairs
    assert len(pairs) < 0.7 * len(boxes(now)) * len(boxes(front))


@pytest.mark.parametrize("dims, slice_rows", [(1, 50_000), (2, 13), (3, 50_000), (4, 40)])
def test_ranks_are_longest_chains(spark, dims, slice_rows):
    rng = np.random.default_rng(dims)
    x = np.round(rng.random((160, dims)), 1 if dims == 2 else 2)
    names = list("abcd")[:dims]
    d = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=range(160)))
    none = spark.createDataFrame([(None,) * dims + (500,)], d.schema)
    got = {r.id: r["rank"] for r in pareto.pareto_ranks(
        d.union(none), [(c, "minimize") for c in names], "id", slice_rows=slice_rows).collect()}
    want, left, rank = {500: None}, np.arange(160), 0
    while len(left):
        top = brute(x[left])
        want.update(dict.fromkeys(left[top].tolist(), rank))
        left, rank = left[~top], rank + 1
    assert got == want


def test_jobs_of_ranks_follow_slices_not_fronts(spark):
    """A chain of 400 points has 400 fronts and is ranked in as many jobs as one of 20."""
    def jobs(n):
        group = f"ranks-{n}"
        spark.sparkContext.setJobGroup(group, group)
        d = spark.range(n).select("id", F.col("id").cast("double").alias("x"))
        assert pareto.pareto_ranks(d, [("x", "minimize")], "id").agg(F.max("rank")).first()[0] == n - 1
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    try:
        assert jobs(400) == jobs(20)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_ranks_and_crowding(spark):
    x = np.random.default_rng(3).random((60, 2))
    d = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=range(60)))
    obj = [("a", "minimize"), ("b", "minimize")]
    r = pareto.pareto_ranks(d, obj, "id", 2).filter("rank IS NOT NULL").cache()
    first = brute(x)
    rest = np.flatnonzero(~first)
    assert {q.id for q in r.filter("rank = 0").collect()} == set(np.flatnonzero(first))
    assert {q.id for q in r.filter("rank = 1").collect()} == set(rest[brute(x[rest])])
    plain = {q.id: q.crowding for q in pareto.crowding(r, obj, "id").collect()}
    cut = {q.id: q.crowding for q in pareto.crowding(r, obj, "id", max_group_rows=3).collect()}
    assert plain == pytest.approx(cut)
    assert sum(np.isinf(v) for v in plain.values()) >= 2
    assert pareto.select_best(pareto.crowding(r, obj, "id"), 5, "id").count() == 5


def test_candidates_stay_in_bounds(spark):
    p = pareto.uniform_points(spark, 500, {"rr": (3.0, 7.5)}, {"t": 70.0})
    s = p.agg(F.min("rr"), F.max("rr"), F.avg("rr"), F.max("t")).first()
    assert 3 <= s[0] < 3.3 and 7.2 < s[1] < 7.5 and abs(s[2] - 5.25) < 0.25 and s[3] == 70.0
    assert p.collect() == pareto.uniform_points(spark, 500, {"rr": (3.0, 7.5)}, {"t": 70.0}).collect()


def test_column_estimate_is_monotonic(spark):
    d = spark.createDataFrame([(3.0 + i / 2,) for i in range(9)], "rr double")
    pur, q = physics.column_estimate(F.col("rr"), F.lit(2.0), F.lit(0.84))
    rows = d.select("rr", pur.alias("p"), q.alias("q")).orderBy("rr").collect()
    assert all(b.p >= a.p and b.q > a.q for a, b in zip(rows, rows[1:]))
    bad = d.select(physics.fenske_stages(F.lit(1.0), F.lit(0.1), 2.2).alias("n")).first()
    assert bad.n is None


def test_windows_and_split(spark):
    pdf = pd.concat([pd.DataFrame({"asset": "a", "scenario": s, "ts": pd.date_range("2026-01-01", periods=n, freq="1min"), "v": np.arange(n, dtype=float)})
                     for s, n in (("x", 30), ("y", 9))])
    pdf.loc[(pdf.scenario == "x") & (pdf.v == 10), "v"] = None
    w = windows.forecast_windows(spark.createDataFrame(pdf), ["v"], ["v"], 6, 4)
    rows = w.orderBy("scenario", "now_ts").collect()
    assert len(rows) == 29 - 6 - 4 + 1 and {r.scenario for r in rows} == {"x"}
    assert [v.v for v in rows[0].x] == [0, 1, 2, 3, 4, 5] and [v.v for v in rows[0].y] == [6, 7, 8, 9]
    s = windows.time_split(spark.createDataFrame(pdf).select("ts", "scenario"), 0.2, "ts", ["scenario"], seconds=120)
    assert s.filter("is_val").count() == 7
    assert s.filter("is_val").agg(F.min("ts")).first()[0] >= s.filter("NOT is_val").agg(F.max("ts")).first()[0]
    p = windows.point_horizons(spark.createDataFrame([([1.0, 2.0, 3.0],)], "tr array<double>"), "tr", [1, 3, 9]).first()
    assert (p["at_1min"], p["at_3min"], p["at_9min"]) == (1.0, 3.0, None)


def test_soft_sensor_and_forecaster_learn(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    d = spark.createDataFrame(pd.DataFrame({"i": range(600), "a": x[:, 0], "b": x[:, 1], "y": 3 * x[:, 0] + x[:, 1]}))
    train, test = learn.holdout(d, F.col("i"))
    assert 80 < test.count() < 160
    m = learn.fit_soft_sensor(train, ["a", "b"], "y", F.col("i"), n_models=2, trees=10, depth=4, step=0.3, min_leaf=5)
    scored = m.predict(test)
    assert reports.regression_metrics(scored, [], "y", "predicted").first().r2 > 0.9
    assert scored.filter("std < 0").count() == 0 and m.importances(spark).first().feature == "a"
    with pytest.raises(ValueError):
        learn.fit_soft_sensor(train.limit(10), ["a", "b"], "y", F.col("i"))
    t = pd.DataFrame({"asset": "a", "scenario": "s", "ts": pd.date_range("2026-01-01", periods=300, freq="1min"), "v": np.sin(np.arange(300) / 10)})
    _, met = learn.evaluate_forecaster(spark.createDataFrame(t), ["v"], ["v"], [0, 1], [1, 5])
    assert all(r.r2 > 0.99 for r in met.collect())


def test_foreign_model(spark):
    d = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    assert sorted(r.predicted for r in learn.predict_with(d, ["a", "b"], lambda x: x.sum(axis=1)).collect()) == [3.0, 7.0]


def test_promotion_rule(spark):
    d = spark.createDataFrame([(1.0, None), (None, 1.0), (0.9, 1.0), (1.0, 1.0), (0.96, 1.0)], "new double, base double")
    got = [r.p for r in d.select(learn.should_promote(F.col("new"), F.col("base")).alias("p")).collect()]
    assert got == [True, True, True, False, True]
    assert [r.p for r in d.select(learn.should_promote(F.col("new"), F.col("base"), 0.05).alias("p")).collect()][2:] == [True, False, False]


def test_forecast_violation_cooldown_is_inclusive(spark):
    rows = [("a", "s", pd.Timestamp("2026-01-01") + pd.Timedelta(minutes=m), "t", 99.0, [99.0, 98.0, 97.0]) for m in (0, 15, 30, 45)]
    f = spark.createDataFrame([(a, s, t.to_pydatetime(), g, c, tr) for a, s, t, g, c, tr in rows],
                              "asset string, scenario string, ts timestamp, tag string, current double, trajectory array<double>")
    lim = spark.createDataFrame([("t", 98.5, "below", "medium", "high", 0.5)],
                                "tag string, limit double, direction string, near string, far string, far_offset double")
    a = divergence.forecast_alerts(f, lim).orderBy("ts").collect()
    assert [x.ts.minute for x in a] == [0, 30] and a[0].severity == "high" and a[0].extra.horizon_minutes == 2.0


def test_faults(spark):
    d = spark.createDataFrame([(float(h), 50.0) for h in range(5)], "h double, v double")
    h, v = F.col("h"), F.col("v")
    r = d.select(faults.freeze(v, h, 2, 1.0).alias("f"), faults.drift(v, h, 2, 40.0).alias("d"), faults.bias(v, h, 2, F.lit(100.0)).alias("b"),
                 faults.noise(v, h, 2, h).alias("n")).collect()
    assert [x.f for x in r] == [50, 50, 1, 1, 1] and [x.d for x in r] == [50, 50, 50, 90, 100] and [x.b for x in r] == [50, 50, 55, 55, 55]
    assert [x.n == 50 for x in r] == [True, True, False, False, False]
