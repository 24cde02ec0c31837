"""Chunked scans against plain sequential recursions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantwave.operators import ordered
from plantwave.operators.recurrences import Cusum, Ewma, scan, thin

KEYS = ["asset", "scenario", "tag"]


def series(seed, n, shift=0.0, keys=3):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(keys):
        gaps = rng.integers(1, 900, n)
        ts = pd.Timestamp("2026-01-01") + pd.to_timedelta(np.cumsum(gaps), unit="s")
        x = rng.normal(0, 1, n)
        x[n // 3: n // 2] += shift
        out.append(pd.DataFrame({"asset": "a", "scenario": f"s{k}", "ts": ts, "tag": "t", "value": x}))
    return pd.concat(out, ignore_index=True)


def seq_cusum(x, mean, sigma):
    k, h, a, b, hits = 0.5 * sigma, 5 * sigma, 0.0, 0.0, []
    for i, v in enumerate(x):
        a, b = max(0.0, a + (v - mean) - k), max(0.0, b - (v - mean) - k)
        if a > h or b > h:
            hits.append((i, "upward" if a > h else "downward", a if a > h else b))
            a = b = 0.0
    return hits


def seq_thin(us, cd, strict):
    kept, last = [], None
    for t in us:
        if last is None or (t - last > cd if strict else t - last >= cd):
            kept.append(t)
            last = t
    return kept


@pytest.mark.parametrize("seconds", [None, 1800, 20000])
@pytest.mark.parametrize("shift", [0.0, 1.0, 4.0])
def test_cusum_equals_recursion(spark, seconds, shift):
    pdf = series(int(shift), 500, shift)
    df = spark.createDataFrame(pdf).withColumn("mean", F.lit(0.0)).withColumn("sigma", F.lit(1.0))
    got = scan(df, Cusum(), KEYS, ["ts"], "ts", seconds).toPandas()
    for s, g in pdf.groupby("scenario"):
        want = seq_cusum(g.value.to_numpy(), 0.0, 1.0)
        mine = got[got.scenario == s].sort_values("ts")
        assert list(mine.ts) == [g.ts.iloc[i] for i, _, _ in want]
        assert list(mine.direction) == [d for _, d, _ in want]
        assert np.allclose(mine.cusum, [v for _, _, v in want])


def test_cusum_transfer_on_any_entry_state():
    rng = np.random.default_rng(5)
    c = Cusum()
    for trial in range(300):
        n = int(rng.integers(1, 60))
        cols = {"value": rng.normal(rng.choice([-1.5, 0, 0.4, 2]), 1, n), "mean": [0.0], "sigma": [1.0]}
        entry = list(rng.uniform(0, 5, 2))
        _, _, want = c.emit(cols, entry)
        assert np.allclose(c.advance(entry, c.summarise(cols)), want)


@pytest.mark.parametrize("seconds", [None, 1800, 20000])
def test_ewma_equals_recursion(spark, seconds):
    pdf = series(1, 400)
    df = spark.createDataFrame(pdf).withColumn("mean", F.lit(0.5))
    got = scan(df, Ewma(0.2), KEYS, ["ts"], "ts", seconds).toPandas()
    for s, g in pdf.groupby("scenario"):
        e, want = 0.5, []
        for v in g.value:
            e = 0.2 * v + 0.8 * e
            want.append(e)
        assert np.allclose(got[got.scenario == s].sort_values("ts").ewma, want)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("seconds", [None, 300, 7200])
def test_thinning_equals_greedy(spark, strict, seconds):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(4):
        t = np.sort(rng.integers(0, 60, 300)) * 60  # many exact ties and exact cooldown gaps
        rows += [("a", f"s{k}", int(v)) for v in np.cumsum(rng.choice([0, 60, 300, 600, 1200], 300))]
    pdf = pd.DataFrame(rows, columns=["asset", "scenario", "sec"])
    pdf["ts"] = pd.Timestamp("2026-01-01") + pd.to_timedelta(pdf.sec, unit="s")
    got = thin(spark.createDataFrame(pdf), ["asset", "scenario"], 600, strict, seconds=seconds).toPandas()
    for s, g in pdf.groupby("scenario"):
        assert sorted(got[got.scenario == s].sec) == seq_thin(g.sec, 600, strict)


def test_empty_and_single_row(spark):
    one = spark.createDataFrame(series(0, 1, keys=1))
    assert thin(one, KEYS, 600).count() == 1
    assert thin(one.limit(0), KEYS, 600, seconds=600).count() == 0


@pytest.mark.parametrize("seconds", [600, 5000, 100000])
def test_two_level_windows_equal_plain(spark, seconds):
    df = spark.createDataFrame(series(8, 300)).withColumn(
        "sparse", F.when(F.col("value") > 0.8, F.col("value")))
    def run(sec):
        d = ordered.index_rows(df, KEYS, ["ts"], seconds=sec)
        d = ordered.previous_value(d, KEYS, ["ts"], "value", "prev", seconds=sec)
        d = ordered.last_known(d, KEYS, ["ts"], F.col("sparse"), "ff", seconds=sec)
        d = ordered.next_known(d, KEYS, ["ts"], F.col("sparse"), "bf", seconds=sec)
        d = ordered.running_total(d, KEYS, ["ts"], F.lit(1), "run", seconds=sec)
        cols = ["scenario", "ts", "rn", "n_rows", "prev", "ff", "bf", "run"]
        return d.select(cols).orderBy("scenario", "ts").toPandas()
    pd.testing.assert_frame_equal(run(None), run(seconds), check_dtype=False)


def test_halo_blocks_equal_plain_frames(spark):
    df = ordered.index_rows(spark.createDataFrame(series(9, 200)), KEYS, ["ts"])
    def run(block):
        d, parts, own = ordered.with_halo(df, KEYS, 12, 5, block)
        d = d.withColumn("back", F.sum("value").over(ordered.row_frame(parts, "rn", -12, 0)))
        d = d.withColumn("ahead", F.count("value").over(ordered.row_frame(parts, "rn", 1, 5)))
        return d.filter(own).select("scenario", "rn", F.round("back", 9).alias("back"), "ahead") \
                .orderBy("scenario", "rn").toPandas()
    pd.testing.assert_frame_equal(run(None), run(16))
