"""Sources, state tables, quality, history, snapshots."""

import json
import os
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantwave.model import PILOT_TAGS, dim_tag
from plantwave.operators import history, quality, reports, versioning
from plantwave.sources import live, samples, tables

from . import data

TAGS = [t[0] for t in PILOT_TAGS]


@pytest.fixture()
def folder(tmp_path):
    for name, rows in (("normal", 20), ("thermal_drift", 15)):
        d = data.wide(rows).rename(columns={"ts": "timestamp"})
        d.loc[3, "column.RR"] = None
        d.to_csv(tmp_path / f"{name}.csv", index=False)
    return tmp_path


def test_scan_list_and_projection(spark, folder):
    w = samples.read_scenarios(spark, str(folder), TAGS)
    assert {r.scenario: r["count"] for r in w.groupBy("scenario").count().collect()} == {"normal": 20, "thermal_drift": 15}
    assert w.filter("column_RR IS NULL").count() == 2 and w.filter("column_x_D IS NOT NULL").count() == 0
    assert [r.scenario for r in samples.list_scenarios(spark, str(folder)).collect()] == ["normal", "thermal_drift"]
    long = samples.to_long(w, TAGS)
    assert long.filter("tag = 'column.RR'").count() == 33
    back = samples.to_wide(long, TAGS)
    assert back.count() == 35 and "column_x_D" in back.columns
    assert samples.existing_scenarios(spark, str(folder), ["normal", "nope"]).count() == 1
    with pytest.raises(FileNotFoundError):
        samples.existing_scenarios(spark, str(folder), ["nope"])


def test_idempotent_and_partitioned_writes(spark, folder, tmp_path):
    w = samples.read_scenarios(spark, str(folder), TAGS)
    out = str(tmp_path / "store")
    samples.write_samples(w, out)
    stored = spark.read.parquet(out)
    assert samples.new_samples(w, stored, ["scenario", "ts"], ["asset"]).count() == 0
    twice = w.unionByName(w).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    assert samples.new_samples(twice, stored, ["scenario", "ts"], ["asset"]).count() == 35
    samples.write_samples(w.filter("scenario = 'normal'").limit(5), out, replace=True)
    assert spark.read.parquet(out).groupBy("scenario").count().orderBy("scenario").collect()[0]["count"] == 5
    assert spark.read.parquet(out).filter("scenario = 'thermal_drift'").count() == 15


def test_reingest(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "scenario string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "scenario string, v int")
    assert sorted(samples.reingest(old, new, False).collect()) == [("a", 1), ("b", 1), ("c", 2)]
    assert sorted(samples.reingest(old, new, True).collect()) == [("a", 1), ("b", 2), ("c", 2)]


def test_upserts(spark):
    old = spark.createDataFrame([("1", "x", "pending"), ("2", "y", "pending")], "id string, d string, status string")
    new = spark.createDataFrame([("2", "changed", "accepted"), ("3", "z", "pending")], "id string, d string, status string")
    assert sorted(tables.upsert_status(old, new).collect()) == [("1", "x", "pending"), ("2", "y", "accepted"), ("3", "z", "pending")]
    assert sorted(tables.set_status(old, new.select("id", "status")).collect()) == [("1", "x", "pending"), ("2", "y", "accepted")]


def test_routing(spark):
    r = spark.createDataFrame([("1", "critical"), ("1", "critical"), ("2", "high"), ("3", "weird"), (None, "critical"), (None, "critical")],
                              "id string, urgency string").selectExpr("*", "'s' scenario", "timestamp'2026-01-01' ts", "'R' rule_id",
                                                                      "'d' diagnosis", "'go' action_text")
    out = tables.routed(r).collect()
    assert sorted(str(x.id) for x in out) == ["1", "None", "None"]
    assert json.loads(out[0].body)["event"] == "recommendation"
    assert tables.routed(r, "nonsense").count() == 0
    assert "text" in json.loads(tables.routed(r, "high", chat=True).first().body)


def test_live_samples(spark):
    msgs = [{"timestamp": 1767225600.5, "values": {"cstr.T_R_C": 78.0, "unknown": 1.0}, "quality": {"cstr.T_R_C": 0}, "source": "x"},
            {"timestamp": None, "values": {"cstr.T_R_C": 1.0}}]
    df = spark.createDataFrame([(json.dumps(m),) for m in msgs] + [("not json",)], "value string")
    d = live.explode_samples(live.parse_samples(df), dim_tag(spark).filter("profile = 'pilot'"))
    assert d.count() == 19 and d.filter("value IS NOT NULL").count() == 1
    assert d.first().ts == datetime(2026, 1, 1, 0, 0, 0, 500000)


def test_quality_flags(spark):
    t0 = datetime(2026, 1, 1)
    vals = ["5", "5", "5", "x", "5", "200", "200", "7"]
    raw = spark.createDataFrame([("a", "t", t0 + timedelta(seconds=6 * i), v) for i, v in enumerate(vals)], "asset string, tag string, ts timestamp, value string")
    m = spark.createDataFrame([("t", 0.0, 100.0)], "tag string, min_range double, max_range double")
    for sec in (None, 10):
        q = [r.quality for r in quality.quality_flags(raw, m, seconds=sec).orderBy("ts").collect()]
        assert q == [0, 0, 2, 3, 2, 1, 1, 0]
    assert quality.bad_per_sample(quality.quality_flags(raw, m), ["asset"]).first().n_bad == 5


def test_upload_checks(spark):
    d = spark.createDataFrame([("1", "2026-01-01", "a"), ("2", "bad", "b"), ("x", "2026-01-02", "c")], "n string, t string, z string")
    v = {r.column: r.verdict for r in quality.numeric_check(d, ["n", "z"]).collect()}
    assert v == {"n": "warning", "z": "error"} and quality.timestamp_check(d, "t").first().n_bad == 1
    assert quality.coerce(d, ["n"]).filter("n IS NULL").count() == 1
    assert quality.missing_columns(d, ["n", "q"]) == ["q"]
    names = spark.createDataFrame([("ok_1",), ("A",), ("x",), (None,), ("ok\n",)], "n string")
    assert [r.ok for r in names.select(quality.valid_name(F.col("n")).alias("ok")).collect()][:4] == [True, False, False, False]
    assert quality.row_count_check(d, [], 3, 3).first().verdict == "ok"


def test_history_limits_and_half_open_window(spark):
    d = spark.range(20000).select(F.col("id"), F.timestamp_seconds("id").alias("ts"), F.lit("s").alias("scenario"))
    with pytest.raises(ValueError):
        history.query_recommendations(d, limit=50000)
    assert history.query_recommendations(d, limit=10000).count() == 10000
    w = history.events_in_window({"r": (d, "ts")}, F.timestamp_seconds(F.lit(5)), F.timestamp_seconds(F.lit(10)))
    assert sorted(int(r.id) for r in w.collect()) == [6, 7, 8, 9, 10]
    assert history.events_in_window({"r": (d, "ts")}, None, F.timestamp_seconds(F.lit(1))).count() == 2


def test_kpis(spark):
    r = data.readings(spark, data.long(data.wide()))
    k = {x.tag: x for x in reports.kpi_summary(r, dim_tag(spark)).collect()}
    assert not k["column.purity_B"].spec_violated and "cstr.T_feed_C" not in k
    low = r.withColumn("value", F.when(F.col("tag") == "column.purity_B", 97.5).otherwise(F.col("value")))
    assert {x.tag: x for x in reports.kpi_summary(low, dim_tag(spark)).collect()}["column.purity_B"].spec_violated
    s = reports.run_summary(low.filter("tag = 'column.purity_B'"), ["scenario"], F.col("value"), 98.5).first()
    assert (s.n_samples, s.below_spec_pct) == (60, 100.0) and s.duration_h == pytest.approx(59 / 60)


def test_snapshots(spark, folder):
    a = versioning.take_snapshot(spark, str(folder), "first").cache()
    rows = {r.name: r for r in a.collect()}
    assert rows["normal.csv"].n_rows == 20 and rows["thermal_drift.csv"].n_cols == 12
    assert len(rows["normal.csv"].snapshot_id) == 12
    assert versioning.take_snapshot(spark, str(folder)).first().snapshot_id == rows["normal.csv"].snapshot_id
    assert versioning.verify_counts(a, versioning.file_meta(spark, str(folder)).withColumn("n_rows", F.lit(0))).first().ok
    with open(folder / "normal.csv", "a") as f:
        f.write("x\n")
    pd.DataFrame({"a": [1]}).to_csv(folder / "new.csv", index=False)
    os.rename(folder / "thermal_drift.csv", folder / "kept.txt")
    b = versioning.take_snapshot(spark, str(folder), "second")
    assert {r.name: r.change for r in versioning.diff_snapshots(a, b).collect()} == {
        "normal.csv": "changed", "new.csv": "added", "thermal_drift.csv": "removed"}
    v = versioning.verify_counts(a, b).first()
    assert (v.ok, v.missing, v.extra, v.mismatched) == (False, 1, 1, 1)
    both = a.unionByName(b)
    assert versioning.list_snapshots(both).count() == 2
    assert versioning.load_snapshot(both, rows["normal.csv"].snapshot_id).count() == 2
    with pytest.raises(LookupError):
        versioning.load_snapshot(both, "none")
    with pytest.raises(FileNotFoundError):
        versioning.take_snapshot(spark, str(folder), pattern="*.nothing")


def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,x,y\n2024-01-01T00:00:00,1,2\n")
    (tmp_path / "b.csv").write_text("y,timestamp\n3,2024-01-01T00:01:00\nNaN,2024-01-01T00:02:00\n")
    w = samples.read_scenarios(spark, str(tmp_path), ["x", "y"])
    assert sorted((r.scenario, r.x, r.y) for r in w.collect() if r.y is not None) == [("a", 1.0, 2.0), ("b", None, 3.0)]
    assert w.count() == 3


def test_forced_reingest_on_disk_drops_old_weeks(spark, tmp_path):
    path = str(tmp_path / "samples")
    rows = lambda *r: spark.createDataFrame(list(r), "scenario string, ts string, v int").withColumn(
        "ts", F.to_timestamp("ts"))
    samples.write_samples(rows(("a", "2024-01-01", 1), ("a", "2024-02-01", 2), ("b", "2024-01-01", 3)), path)
    samples.write_samples(rows(("a", "2024-02-01", 9)), path, replace=True)
    assert sorted((r.scenario, r.v) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]
