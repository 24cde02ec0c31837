"""Ids, cuts and drops: what must not go missing."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plantwave.catalog import trail
from plantwave.functions.ids import stable_id
from plantwave.operators import drift, history, learn, pareto, rules
from plantwave.session import shared_dir


def test_ids_do_not_clash(spark):
    d = spark.range(600_000).select(stable_id("DEC", F.col("id"), F.lit("auto")).alias("id"))
    assert d.distinct().count() == 600_000


def test_ids_tell_separators_and_nulls_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("~", "c"), ("a\\", "b"), ("a", "\\b")]
    d = spark.createDataFrame(rows, "x string, y string").select(stable_id("X", F.col("x"), F.col("y")).alias("id"))
    assert d.distinct().count() == len(rows)


def test_more_edges_than_ten_thousand(spark):
    n = 20_000
    d = spark.range(n + 1).select(F.lit("t").alias("tag"), F.col("id").cast("double").alias("value"))
    edges = drift.bin_edges(d, n_bins=n).select(F.size("edges").alias("n")).first()
    assert edges.n == n + 1


def test_limits_raise_instead_of_cutting(spark):
    d = spark.range(3).select(F.col("id"), F.col("id").cast("timestamp").alias("ts"), F.lit("s").alias("scenario"))
    with pytest.raises(ValueError):
        history.query_samples(d, limit=20_000)
    assert history.query_samples(d, limit=20_000, max_limit=30_000).count() == 3
    assert history.latest_first(d, 20_000).count() == 3


def test_predictions_keep_rows_with_missing_inputs(spark):
    d = spark.range(120).select(F.col("id"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    model = learn.fit_soft_sensor(d, ["x"], "y", F.col("id"), n_models=1, trees=3)
    gap = d.withColumn("x", F.when(F.col("id") % 10 != 0, F.col("x")))
    got = model.predict(gap)
    assert got.count() == 120 and got.filter("predicted IS NULL").count() == 12


def test_all_ranks(spark):
    d = spark.createDataFrame([(i, float(i)) for i in range(4)], "id int, x double")
    ranks = pareto.pareto_ranks(d, [("x", "minimize")], "id").collect()
    assert sorted((r.id, r["rank"]) for r in ranks) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    some = pareto.pareto_ranks(d, [("x", "minimize")], "id", at_least=2).filter("rank IS NOT NULL")
    assert some.count() == 2


def test_registered_ranks_reach_every_customer(spark, tmp_path):
    """Six fronts of two customers: more orders for more money, and less of it front by front."""
    rows = [(10 * f + n, 100.0 * n - f, "5-LOW") for f in range(6) for n in (1, 2) for _ in range(n)]
    spark.createDataFrame(rows, "o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    q = entry.queries()
    want = sorted((10 * f + n, f) for f in range(6) for n in (1, 2))
    assert sorted(map(tuple, q["pareto_ranks_all"](spark, str(tmp_path)).collect())) == want
    got = q["crowding_distance_all"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r["rank"]) for r in got) == want and {r.crowding for r in got} == {-1.0}
    got = q["select_by_rank"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r["rank"]) for r in got) == [w for w in want if w[1] < 5]


def test_every_rule_fires(spark):
    ctx = trail.rule_context(spark, "/root/testdata/sf0.01")
    for pack, n in ((rules.PILOT_RULES, 10), (rules.BATCH_RULES, 3)):
        fired = rules.recommend(ctx, pack).select("rule_id").distinct()
        assert fired.count() == n


def test_shared_folder_is_named_or_local(spark):
    assert shared_dir(spark)
