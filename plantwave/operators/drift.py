"""Population stability: reference bins, live histogram, score and report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ladders import psi_status
from ..session import ensure_checkpoint_dir
from .history import recent_rows
from .quantiles import exact_quantiles
from .scale import TARGET_ROWS, attach_small, fits

N_BINS = 10
EPSILON = 1e-6
MIN_LIVE = 30


def raise_ties(edges: Column, step: float = EPSILON) -> Column:
    """Each edge not above its predecessor becomes predecessor + step, left to right."""
    start = F.slice(edges, 1, 1)
    return F.aggregate(F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 1, F.lit(0))), start, lambda acc, e: F.concat(
        acc, F.array(F.when(e <= F.element_at(acc, -1), F.element_at(acc, -1) + step).otherwise(e))))


def bin_edges(reference: DataFrame, keys: Sequence[str] = ("tag",), value: str = "value",
              n_bins: int = N_BINS, max_group_rows: int = TARGET_ROWS) -> DataFrame:
    """Strictly increasing equal-frequency edges per feature, with the reference count."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = exact_quantiles(reference, keys, value, probs, "edges", max_group_rows)
    n = reference.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ref"))
    v = F.col("edges")[0]
    single = F.array(v - 0.5, v + 0.5)
    return q.join(n, list(keys)).withColumn(
        "edges", F.when(F.col("n_ref") < 2, single).otherwise(raise_ties(F.col("edges"))))


def histogram(df: DataFrame, edges: DataFrame, keys: Sequence[str] = ("tag",), value: str = "value",
              n_bins: int = N_BINS, small: bool | None = None) -> DataFrame:
    """Counts per bin; the outer edges are open.

    With a countably small edge table readings are not shuffled, only counts; `small` says
    so when the caller has counted already.
    """
    d = attach_small(df.filter(F.col(value).isNotNull()).select(*keys, value), edges.select(*keys, "edges"), keys,
                     F.col(value), small)
    b = F.lit(0)
    for i in range(1, n_bins):
        inside = (F.size("edges") - 1 > i) & (F.get("edges", F.lit(i)) <= F.col(value))
        b = b + F.coalesce(inside, F.lit(False)).cast("int")
    return d.withColumn("bin", b).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def psi_report(reference: DataFrame, live: DataFrame, keys: Sequence[str] = ("tag",), value: str = "value",
               n_bins: int = N_BINS, edges: DataFrame | None = None,
               max_group_rows: int = TARGET_ROWS) -> DataFrame:
    """PSI, status and sizes per reference feature; a feature without live rows scores 0."""
    keys = list(keys)
    ensure_checkpoint_dir(reference.sparkSession)
    e = (bin_edges(reference, keys, value, n_bins, max_group_rows) if edges is None else edges).checkpoint()
    small = fits(e)
    return psi_of_counts(e, histogram(reference, e, keys, value, n_bins, small), histogram(live, e, keys, value, n_bins, small), keys)


def psi_of_counts(edges: DataFrame, reference_counts: DataFrame, live_counts: DataFrame,
                  keys: Sequence[str] = ("tag",)) -> DataFrame:
    """The same report from two histograms `(keys, bin, n)`; reads no readings."""
    keys = list(keys)
    bins = edges.select(*keys, "n_ref", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    ref, liv = reference_counts.withColumnRenamed("n", "_r"), live_counts.withColumnRenamed("n", "_l")
    n_live = live_counts.groupBy(*keys).agg(F.sum("n").alias("n_live"))
    d = (bins.join(ref, [*keys, "bin"], "left").join(liv, [*keys, "bin"], "left")
         .join(n_live, keys, "left").fillna(0, ["_r", "_l", "n_live"]))
    p = F.greatest(F.col("_r") / F.greatest(F.col("n_ref"), F.lit(1)), F.lit(EPSILON))
    q = F.greatest(F.col("_l") / F.greatest(F.col("n_live"), F.lit(1)), F.lit(EPSILON))
    out = d.groupBy(*keys, "n_ref", "n_live").agg(
        F.greatest(F.sum((q - p) * F.log(q / p)), F.lit(0.0)).alias("psi"))
    out = out.withColumn("psi", F.when(F.col("n_live") == 0, 0.0).otherwise(F.col("psi")))
    return out.withColumn("status", psi_status(F.col("psi")))


def overall(report: DataFrame, feature: str = "tag", group: Sequence[str] = ()) -> DataFrame:
    """Worst feature (first by name on a tie) and its status."""
    worst = F.min_by(F.struct(feature, "psi", "status"), F.struct(-F.col("psi"), F.col(feature)))
    return report.groupBy(*group).agg(worst.alias("w")).select(
        *group, F.col("w.status").alias("overall_status"), F.col("w.psi").alias("max_psi"),
        F.col(f"w.{feature}").alias("worst_feature"))


def live_window(readings: DataFrame, window: int, keys: Sequence[str] = ("tag",), ts: str = "ts",
                tie: Sequence[str] = ()) -> DataFrame:
    """The last `window` rows per feature, and none of a feature still warming up."""
    d = recent_rows(readings, window, keys, ts=ts, tie=tie)
    ready = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= MIN_LIVE)
    return d.join(ready.select(*keys), list(keys), "left_semi")
