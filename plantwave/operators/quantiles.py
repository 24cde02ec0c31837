"""Exact quantiles that never hold a group in one task.

Values are counted first (ties collapse), then cut into buckets at approximate
quantiles; only bucket totals are scanned per group, and only the buckets a wanted
rank falls into are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import TARGET_ROWS, attach_small


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    out: str = "quantiles", max_group_rows: int = TARGET_ROWS,
                    buckets: int = 256) -> DataFrame:
    """Linear-interpolated quantiles per group as an array in the order of `probs`."""
    keys = list(keys)
    d = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= max_group_rows:
        return d.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias(out))
    return _by_bucket(d, sizes, keys, probs, out, buckets)


def _by_bucket(d: DataFrame, sizes: DataFrame, keys: list[str], probs, out: str, buckets: int) -> DataFrame:
    counted = d.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    cuts = [i / buckets for i in range(1, buckets)]
    edges = counted.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx("_v", F.array(*[F.lit(c) for c in cuts]), 10_000)).alias("_e"))
    table = edges.join(sizes, keys) if keys else edges.join(F.broadcast(sizes))
    placed = attach_small(counted, table.persist(), keys, F.col("_v")) if keys else \
        counted.join(F.broadcast(table))
    # position of the first edge not below the value, by binary search over the sorted edges
    placed = placed.withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col("_v")))).drop("_e")
    totals = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_t"), F.first("n").alias("n"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_t").over(w), F.lit(0)))
    ranks = F.array(*[r for p in probs for r in (
        F.floor(F.lit(float(p)) * (F.col("n") - 1)), F.ceil(F.lit(float(p)) * (F.col("n") - 1)))])
    wanted = totals.withColumn("_ranks", F.filter(
        F.array_distinct(ranks), lambda r: (r >= F.col("_base")) & (r < F.col("_base") + F.col("_t"))))
    wanted = wanted.filter(F.size("_ranks") > 0)
    hot = placed.drop("n").join(wanted, [*keys, "_b"])
    cum = F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v")) + F.col("_base")
    hot = hot.withColumn("_hi", cum).withColumn("_lo", F.col("_hi") - F.col("_c"))
    hits = hot.withColumn("_hit", F.filter("_ranks", lambda r: (r >= F.col("_lo")) & (r < F.col("_hi"))))
    pairs = hits.select(*keys, "n", "_v", F.explode("_hit").alias("_r"))
    # at most two ranks per wanted probability and group
    table = pairs.groupBy(*keys, "n").agg(F.map_from_entries(F.array_agg(F.struct("_r", "_v"))).alias("_m"))
    cols = []
    for p in probs:
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col("_m")[F.floor(pos)], F.col("_m")[F.ceil(pos)]
        cols.append(lo + (hi - lo) * (pos - F.floor(pos)))
    return table.select(*keys, F.array(*cols).alias(out))
