"""Work that must not grow faster than the rows."""

import hashlib
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantwave.operators import asof, learn, ordered, pareto, versioning, windows
from plantwave.streaming import buffer, detectors

KEYS = ["tag"]


def ticks(spark, n, value):
    return spark.range(n).select(F.lit("a").alias("tag"), F.timestamp_seconds(F.col("id")).alias("ts"), value.alias("value"))


def plan(d):
    return d._jdf.queryExecution().toString().lower()


@pytest.mark.parametrize("seconds", [None, 100])
def test_backward_fill_has_no_frame_without_end(spark, seconds):
    """Such a frame is computed anew for every row, so a series of n rows costs n squared."""
    d = ticks(spark, 1000, F.when(F.col("id") % 7 == 3, F.col("id").cast("double")))
    got = windows.fill_both_ways(d, ["value"], KEYS, seconds=seconds)
    assert "unboundedfollowing" not in plan(got)
    near = asof.asof_nearest(d.select("tag", "ts"), d, KEYS, seconds=seconds)
    assert "unboundedfollowing" not in plan(near)
    back = ordered.next_known(d, KEYS, ["ts"], F.col("value"), "b", seconds=seconds)
    want = {i: next((j for j in range(i, 1000) if j % 7 == 3), None) for i in range(1000)}
    assert {r.s: r.b for r in back.select(F.unix_seconds("ts").alias("s"), "b").collect()} == want


def test_outcomes_of_a_run_have_no_frame_without_end(spark):
    import __spark_entry__ as entry
    assert "unboundedfollowing" not in plan(entry.queries()["monitoring_run"](spark, "/root/testdata/sf0.001"))


def test_context_looks_readings_up_once(spark):
    """The look-up took part three times in the plan of a context, over all readings each time."""
    from plantwave.operators.rules import session_context
    from tests.test_rules_and_decisions import PILOT, readings, sessions
    ctx = session_context(sessions(spark, dict(id="x", detector="SPC.EWMA", tag="cstr.T_R_C", start=0, value=82.5),
                                   dict(id="y", detector="Model.T2", tag=None, start=20, value=1.0)), readings(spark, PILOT))
    assert "_hit" not in plan(ctx)
    got = {r.session_id: r for r in ctx.collect()}
    assert got["x"].v_own == got["x"].v_cstr_T_R_C is not None
    assert got["y"].v_own is None and got["y"].v_cstr_T_R_C is not None


# --- ranks ----------------------------------------------------------------------------

def jobs_of(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def chains(x):
    """Length of the longest chain of dominators, point by point in ascending order."""
    out = np.zeros(len(x), int)
    order = np.lexsort(x.T[::-1])
    for k, i in enumerate(order):
        by = [out[j] for j in order[:k] if (x[j] <= x[i]).all() and (x[j] < x[i]).any()]
        out[i] = 1 + max(by, default=-1)
    return out


@pytest.mark.parametrize("dims, job_rows, most_jobs", [(3, 50_000, 40), (1, 60, 80), (2, 60, 80), (3, 60, 80), (4, 60, 80)])
def test_small_slices_share_jobs(spark, dims, job_rows, most_jobs):
    """One job per slice made thousands of them; whatever the slices and jobs, the ranks are the same."""
    x = np.round(np.random.default_rng(dims).random((240, dims)), 2)
    names = list("abcd")[:dims]
    d = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=range(len(x))))
    got, jobs = jobs_of(spark, lambda: {r.id: r["rank"] for r in pareto.pareto_ranks(
        d, [(c, "minimize") for c in names], "id", slice_rows=3, **({} if job_rows == pareto.RANK_SLICE else {"job_rows": job_rows})).collect()})
    assert got == dict(enumerate(chains(x)))
    assert jobs < most_jobs


def test_what_is_handed_on_follows_values_not_ranks():
    """20 000 points with 15 different tails have thousands of ranks; a tail is handed on once at most."""
    rng = np.random.default_rng(4)
    x = np.unique(np.column_stack([rng.random(20_000), rng.integers(0, 5, 20_000), rng.integers(0, 3, 20_000)]), axis=0)
    stairs = pareto.Reach(np.empty((0, 2)), np.empty(0, int), x[:, 1:])
    ranks = pareto.rank_slice(x, stairs)
    rest, at = stairs.kept()
    assert ranks.max() > 1000 and len(rest) == len(at) <= 15


@pytest.mark.parametrize("name", ["crowding_distance", "crowding_distance_all"])
def test_crowding_reads_kept_ranks(spark, name):
    """The table of the points is used three times; it was built from the orders each time."""
    import __spark_entry__ as entry
    assert "orders.parquet" not in plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))


# --- streams --------------------------------------------------------------------------

def test_a_batch_is_made_once(spark, tmp_path):
    """Counting, judging and joining a micro-batch must not run the stateful step that makes it again."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        made.add(1)
        yield from batches
    rows = spark.range(40).select(F.lit("a").alias("asset"), F.lit("live").alias("scenario"), F.timestamp_seconds(F.lit(0)).alias("as_of"),
                                  F.col("id").cast("string").alias("id"), F.col("id").cast("double").alias("value"))
    batch = rows.coalesce(1).mapInPandas(count, rows.schema)
    body = buffer.evaluation_batches(str(tmp_path / "out"), lambda d: d.join(d.groupBy("asset").agg(F.avg("value").alias("m")), "asset").filter("value > m"), 10)
    body(batch, 0)
    assert made.value == 1
    assert buffer.stored(spark, str(tmp_path / "out")).count() == 20


@pytest.mark.parametrize("copies", [12, 60])
def test_readings_of_one_instant_have_no_trend(copies):
    """Weeks after the first kept reading, differences of running sums gave such windows a slope."""
    rng = np.random.default_rng(copies)
    us = np.repeat(np.sort(rng.integers(0, 30 * 86_400_000_000, 20)), copies)
    x = np.repeat(np.round(rng.random(20) * 200, 2), copies)
    due, y, slope, r2 = detectors.trend_of_new(us, x, len(x), 0, 10, 3, 2)
    flat = us[due] == us[due - 9]
    assert flat.any() and (slope[flat] == 0).all() and (r2[flat] == 0).all()
    for i, k, s in zip(due[~flat], y[~flat], slope[~flat]):
        assert k == pytest.approx(x[i - 2:i + 1].mean(), abs=1e-12)
        smooth = [x[max(j - 2, 0):j + 1].mean() for j in range(i - 9, i + 1)]
        assert s == pytest.approx(np.polyfit((us[i - 9:i + 1] - us[i]) / 60e6, smooth, 1)[0], rel=1e-6, abs=1e-12)


# --- trailing ranges ------------------------------------------------------------------

def test_trailing_moments_equal_plain_ranges(spark):
    rng = np.random.default_rng(8)
    n = 600
    us = np.sort(rng.integers(0, 40, n)) * 30_000_000
    x = np.where(us < 400_000_000, 7.3, np.round(rng.normal(1e6, 1e-3, n), 5))
    x = np.where(rng.random(n) < 0.1, np.nan, x)
    pdf = pd.DataFrame({"tag": rng.choice(["a", "b"], n), "us": us, "x": x, "id": range(n)})
    d = spark.createDataFrame(pdf).select("tag", "id", F.timestamp_micros("us").alias("ts"), F.nanvl("x", F.lit(None)).alias("value"))
    out = asof.trailing_moments(d, 2, "n", "mean", "sd", keys=KEYS)
    assert "-120000000" not in plan(out)  # no sliding frame, whose cost follows the rows in range
    got = {r.id: r for r in out.collect()}
    for i, r in pdf.iterrows():
        w = pdf[(pdf.tag == r.tag) & (pdf.us <= r.us) & (pdf.us >= r.us - 120_000_000)].x.dropna()
        g = got[i]
        assert g.n == len(w)
        assert (g["mean"] is None) == (len(w) == 0) and (g.sd is None) == (len(w) < 2)
        if len(w):
            assert g["mean"] == pytest.approx(w.mean(), rel=1e-12)
        if len(w) > 1:
            assert g.sd == pytest.approx(w.std(), rel=1e-6, abs=1e-12)


class Held:
    """State and timers of one key in memory."""

    def __init__(self):
        self.value, self.rows, self.timers = None, [], set()
        self.getListState = self.getValueState = lambda *_: self
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def appendList(self, rows):
        self.rows += rows

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_windows_that_end_together_share_a_frame():
    """Ten windows ended by one jump of event time; a frame for each cost more than its rows."""
    p, due, rows = buffer.BufferProcessor(100, 50), Held(), Held()
    rows.get = lambda: rows.rows
    p.init(due)
    p.rows = rows
    us = np.arange(1, 500) * 1_000_000
    list(p.handleInputRows(("a", "s"), iter([pd.DataFrame({"ts": pd.to_datetime(us, unit="us"), "tag": "t", "value": us / 1e6})]), None))

    class At:
        getCurrentWatermarkInMs = getExpiryTimeInMs = staticmethod(lambda: 10_000_000)
    At.getExpiryTimeInMs = staticmethod(lambda: 50_001)
    frames = list(p.handleExpiredTimer(("a", "s"), At, At))
    assert len(frames) == 1
    got = frames[0].groupby("as_of")["value"].agg(["min", "max"])
    assert [(t.value // 10**9 if hasattr(t, "value") else t, lo, hi) for t, lo, hi in got.itertuples()] == [
        (e, max(e - 99, 1), min(e, 499)) for e in range(50, 600, 50)]


def test_assets_share_a_bucket():
    """A call, a frame and a timer for each asset cost more than its readings; one bucket gives the windows of all."""
    p, due, rows = buffer.BufferProcessor(100, 50), Held(), Held()
    rows.get = lambda: rows.rows
    p.init(due)
    p.rows = rows
    us = np.arange(1, 121) * 1_000_000
    frame = pd.DataFrame({"asset": np.array(["a", "b", "c"])[np.arange(120) % 3], "scenario": "s", "ts": pd.to_datetime(us, unit="us"),
                          "tag": "t", "value": us / 1e6})
    list(p.handleInputRows((7,), iter([frame[:50], frame[50:]]), None))
    assert len(due.timers) == 1 and len(rows.rows) == 2

    class At:
        getCurrentWatermarkInMs = staticmethod(lambda: 10_000_000)
        getExpiryTimeInMs = staticmethod(lambda: 50_001)
    got = pd.concat(p.handleExpiredTimer((7,), At, At))
    want = sorted((a, e, v) for e in range(50, 250, 50) for a, v in zip(frame["asset"], frame["value"]) if e - 100 < v <= e)
    assert sorted((a, t.value // 10**9, v) for a, t, v in got[["asset", "as_of", "value"]].itertuples(index=False)) == want


class Bucket:
    """State of one bucket in memory."""

    def __init__(self):
        self.states, self.timers = {}, set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def getValueState(self, name, _):
        return Cell(self.states, name, None)

    def getListState(self, name, _):
        return Cell(self.states, name, ())


class Cell:
    def __init__(self, states, name, empty):
        self.get = lambda: states.get(name, empty)
        self.put = self.update = lambda v: states.__setitem__(name, v)
        self.clear = lambda: states.pop(name, None)


def in_buckets(make, batches, split):
    """What processors put out, all series in one bucket or each in its own, and the rows their states end with."""
    groups = {}
    out, held = [], 0
    for batch in batches:
        for k, part in batch.groupby(["asset", "tag"] if split else lambda _: 0):
            if k not in groups:
                groups[k] = make()
                groups[k].init(Bucket())
            out += list(groups[k].handleInputRows((0,), iter([part[:9], part[9:]]), None))
    for p in groups.values():
        held += len(p._held())
        assert len(p.handle.timers) == 1
    rows = pd.concat(out)
    return rows.sort_values(list(rows.columns), ignore_index=True), held


def series_batches():
    rng = np.random.default_rng(11)
    n = 1500
    pdf = pd.DataFrame({"asset": rng.choice(list("abcdefgh"), n), "tag": rng.choice(["x", "y"], n),
                        "ts": pd.to_datetime(np.sort(rng.integers(0, 2 * 86_400_000, n)) * 1000, unit="us"), "value": np.round(rng.normal(0, 2, n))})
    pdf.loc[(pdf.index > 500) & (pdf.index < 900) & (pdf.asset == "b"), "value"] = 1.0
    pdf.loc[::41, "value"] = np.nan
    late = pdf.iloc[700:1100].sample(frac=1, random_state=1)
    return [pdf[:700], pd.concat([late, pdf[100:130]]), pdf[1100:]]


def test_charts_of_series_share_a_bucket():
    """A call, a frame per detector and state requests for each series took nearly all the time."""
    batches = [b.assign(mean=0.0, sigma=1.0, ucl=3.0, lcl=-3.0, ewma_sigma=1 / 3, ewma_ucl=1.0, ewma_lcl=-1.0, has_baseline=b["asset"] != "h",
                        low=-4.0, high=4.0, has_limits=b["tag"] == "x") for b in series_batches()]
    make = lambda: detectors.ChartProcessor(5, trend=(12, 3, 2), horizon_minutes=4000, trend_cooldown_s=900)
    one, held = in_buckets(make, batches, False)
    each, _ = in_buckets(make, [b[b["asset"] != "h"] for b in batches], True)
    pd.testing.assert_frame_equal(one[one["detector"] != detectors.UNKNOWN].reset_index(drop=True), each)
    assert held == 14 and set(one["detector"]) == {"SPC.Shewhart", "SPC.EWMA", "Regime.CUSUM", "FrozenSensor", "Trend.Projection",
                                                   detectors.LATE, detectors.UNKNOWN}


def test_quality_of_series_shares_a_bucket():
    batches = [b.assign(min_range=-3.0, max_range=3.0) for b in series_batches()]
    one, held = in_buckets(lambda: detectors.StaleProcessor(3600), batches, False)
    each, _ = in_buckets(lambda: detectors.StaleProcessor(3600), batches, True)
    pd.testing.assert_frame_equal(one, each)
    assert held == 16 and set(one["quality"]) == {0, 1, 2, 3} and len(one) == sum(map(len, batches))


def test_a_bucket_drops_the_series_that_went_silent():
    p = detectors.StaleProcessor(3600)
    p.init(Bucket())
    frame = pd.DataFrame({"asset": ["a", "b", "c"], "tag": "t", "ts": pd.to_datetime([1, 2, 9], unit="s"), "value": 1.0, "min_range": 0.0, "max_range": 2.0})
    list(p.handleInputRows((0,), iter([frame]), None))

    class At:
        getCurrentWatermarkInMs = staticmethod(lambda: 5_000)
        getExpiryTimeInMs = staticmethod(lambda: 1_001)
    list(p.handleExpiredTimer((0,), At, At))
    assert p._held()["asset"].tolist() == ["c"] and p.handle.timers >= {9_001}


# --- distances of large fronts --------------------------------------------------------

def test_chunks_of_a_front_are_found_by_bisection(spark):
    """Counting the cuts below each value cost the square of the largest front, as its cuts grow with it."""
    rng = np.random.default_rng(4)
    d = spark.createDataFrame(pd.DataFrame({"id": range(900), "rank": rng.integers(0, 2, 900), "a": np.round(rng.random(900), 2), "b": rng.random(900)}))
    obj = [("a", "minimize"), ("b", "maximize")]
    cut = pareto.crowding(d, obj, "id", max_group_rows=20)
    assert "lambdafunction" not in plan(cut)
    rows = lambda c: {r.id: round(r.crowding, 9) for r in c.collect()}
    assert rows(cut) == rows(pareto.crowding(d, obj, "id")) and cut.count() == 900


# --- soft sensor ----------------------------------------------------------------------

def test_trees_see_points_in_place_of_rows_with_the_same_inputs(spark, monkeypatch):
    """Trees passed over every row at each level, whatever the number of different inputs."""
    d = spark.range(6000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn(
        "y", F.col("a") * 3 - F.col("b") * F.col("b") + F.col("id") % 11)
    fit, seen = learn.GBTRegressor.fit, []
    monkeypatch.setattr(learn.GBTRegressor, "fit", lambda self, rows: (seen.append(rows.count()), fit(self, rows))[1])
    settings = dict(n_models=2, trees=6, depth=4, step=0.3, subsample=1.0)
    by_row = learn.fit_soft_sensor(d, ["a", "b"], "y", F.col("id"), **settings)
    monkeypatch.setattr(learn, "FIT_ROWS", 1000)
    by_point = learn.fit_soft_sensor(d, ["a", "b"], "y", F.col("id"), **settings)
    assert min(seen[:2]) > 3000 and max(seen[2:]) <= 35 * learn.POINTS
    assert by_point.n_train == by_row.n_train == 6000
    grid = d.select("a", "b").distinct()
    want = {(r.a, r.b): r for r in by_row.predict(grid).collect()}
    got = by_point.predict(grid).collect()
    assert len(got) == 35
    for r in got:
        assert r.predicted == pytest.approx(want[r.a, r.b].predicted, abs=1e-6)
        assert r.std == pytest.approx(want[r.a, r.b].std, abs=1e-6)


def test_trees_see_rows_where_inputs_differ(spark, monkeypatch):
    fit, seen = learn.GBTRegressor.fit, []
    monkeypatch.setattr(learn.GBTRegressor, "fit", lambda self, rows: (seen.append(rows.count()), fit(self, rows))[1])
    monkeypatch.setattr(learn, "FIT_ROWS", 100)
    d = spark.range(1000).select("id", F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("y"))
    learn.fit_soft_sensor(d, ["a"], "y", F.col("id"), n_models=1, trees=2, depth=2)
    assert 500 < seen[0] < 800


# --- file hashes ----------------------------------------------------------------------

@pytest.mark.parametrize("own_state", [True, False])
def test_long_files_are_hashed_piece_by_piece(spark, tmp_path, monkeypatch, own_state):
    """Each file was read whole by one task, and none above the limit of its reader."""
    rng, want = np.random.default_rng(3), {}
    for i, n in enumerate([1, 2, 999, 1000, 1001, 2000, 5003, 64_000]):
        data = rng.bytes(n)
        (tmp_path / f"a b%20{i}.csv").write_bytes(data)
        want[f"a b%20{i}.csv"] = (hashlib.sha256(data).hexdigest(), n)
    (tmp_path / ".hidden.csv").write_bytes(rng.bytes(5000))
    monkeypatch.setattr(versioning, "PIECE_BYTES", 1000)
    if own_state:
        read = [sum(r["at"] for r in versioning._hash_on(pd.DataFrame([{"path": f"file:{tmp_path}/a b%207.csv", "size_bytes": 64_000,
                "at": 0, "state": None, "sha256": None}]), 1000))]
        assert read == [1000]
    else:
        monkeypatch.setattr(versioning, "_hash_on", without_state(versioning._hash_on))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1500")
    try:
        rows = versioning.file_meta(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {r.name: (r.sha256, r.size_bytes) for r in rows} == want and len(rows) == len(want)


def without_state(hash_on):
    def run(rows, piece):
        kept, versioning.Sha256.library = versioning.Sha256.library, None
        try:
            yield from hash_on(rows, piece)
        finally:
            versioning.Sha256.library = kept
    return run
