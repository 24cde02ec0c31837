"""Control charts: baselines, Shewhart, EWMA and CUSUM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ladders import severity_from_shift, severity_from_sigma
from ..model import SERIES
from .alerts import as_alerts, extra_struct
from .ordered import as_found, chunk_carry, index_rows
from .recurrences import Cusum, Ewma, scan, thin
from .scale import with_chunk

SIGMA_FLOOR = 1e-9


def training_rows(df: DataFrame, fraction: float, keys: Sequence[str] = SERIES, ts: str = "ts",
                  tie: Sequence[str] = (), seconds: int | None = None) -> DataFrame:
    """The first floor(n × fraction) rows of every series."""
    d = index_rows(df, keys, [ts, *tie], ts, seconds)
    return d.filter(F.col("rn") <= F.floor(F.col("n_rows") * F.lit(fraction)))


def evaluation_rows(df: DataFrame, fraction: float, keys: Sequence[str] = SERIES, ts: str = "ts",
                    tie: Sequence[str] = (), seconds: int | None = None) -> DataFrame:
    """The rows after the training slice."""
    d = index_rows(df, keys, [ts, *tie], ts, seconds)
    return d.filter(F.col("rn") > F.floor(F.col("n_rows") * F.lit(fraction)))


def fit_baseline(df: DataFrame, keys: Sequence[str] = SERIES, fraction: float = 1.0, ts: str = "ts",
                 value: str = "value", tie: Sequence[str] = (), seconds: int | None = None,
                 lam: float = 0.2, width: float = 3.0) -> DataFrame:
    """Mean, sample deviation (floored) and chart limits per series."""
    train = df if fraction >= 1.0 else training_rows(df, fraction, keys, ts, tie, seconds)
    stats = train.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.greatest(F.stddev_samp(value), F.lit(SIGMA_FLOOR)).alias("sigma"),
        F.count(value).alias("n_fit"),
    )
    return with_limits(stats, lam, width)


def with_limits(stats: DataFrame, lam: float = 0.2, width: float = 3.0) -> DataFrame:
    ewma_sigma = F.col("sigma") * (lam / (2.0 - lam)) ** 0.5
    return (stats
            .withColumn("ucl", F.col("mean") + 3.0 * F.col("sigma"))
            .withColumn("lcl", F.col("mean") - 3.0 * F.col("sigma"))
            .withColumn("ewma_sigma", ewma_sigma)
            .withColumn("ewma_ucl", F.col("mean") + width * F.col("ewma_sigma"))
            .withColumn("ewma_lcl", F.col("mean") - width * F.col("ewma_sigma")))


def attach(df: DataFrame, params: DataFrame, keys: Sequence[str], ts: str = "ts",
           seconds: int | None = None) -> DataFrame:
    """Per-series parameters onto readings, balanced by time chunk when series are large."""
    if not seconds:
        return df.join(params, list(keys))
    d = chunk_carry(with_chunk(df, ts, seconds), keys, {"_n": F.count(F.lit(1))}, {}, params)
    return as_found(d, df)


def _present(df: DataFrame, value: str, ts: str, seconds: int | None) -> DataFrame:
    """Non-null readings, chunked once for all following steps."""
    d = df.filter(F.col(value).isNotNull())
    return with_chunk(d, ts, seconds) if seconds else d


def shewhart_violations(df: DataFrame, baseline: DataFrame, keys: Sequence[str] = SERIES,
                        ts: str = "ts", value: str = "value", seconds: int | None = None) -> DataFrame:
    """Rows outside mean ± 3σ with side, limit and deviation in σ."""
    d = attach(df.filter(F.col(value).isNotNull()),
               baseline.select(*keys, "mean", "sigma", "ucl", "lcl"), keys, ts, seconds)
    x = F.col(value)
    return (d.filter((x > F.col("ucl")) | (x < F.col("lcl")))
            .withColumn("side", F.when(x > F.col("ucl"), "above").otherwise("below"))
            .withColumn("lim", F.when(x > F.col("ucl"), F.col("ucl")).otherwise(F.col("lcl")))
            .withColumn("deviation", F.abs(x - F.col("mean")) / F.col("sigma")))


def ewma_series(df: DataFrame, baseline: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts",
                value: str = "value", tie: Sequence[str] = (), lam: float = 0.2,
                seconds: int | None = None) -> DataFrame:
    """Every non-null reading with its EWMA."""
    d = attach(_present(df, value, ts, seconds),
               baseline.select(*keys, "mean", "ewma_sigma", "ewma_ucl", "ewma_lcl"), keys, ts, seconds)
    return scan(d, Ewma(lam, value), keys, [ts, *tie], ts, seconds)


def ewma_violations(df: DataFrame, baseline: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts",
                    value: str = "value", tie: Sequence[str] = (), lam: float = 0.2,
                    seconds: int | None = None) -> DataFrame:
    e = F.col("ewma")
    d = ewma_series(df, baseline, keys, ts, value, tie, lam, seconds)
    return (d.filter((e > F.col("ewma_ucl")) | (e < F.col("ewma_lcl")))
            .withColumn("side", F.when(e > F.col("ewma_ucl"), "above").otherwise("below"))
            .withColumn("lim", F.when(e > F.col("ewma_ucl"), F.col("ewma_ucl"))
                        .otherwise(F.col("ewma_lcl")))
            .withColumn("deviation", F.abs(e - F.col("mean")) / F.col("ewma_sigma")))


def cusum_triggers(df: DataFrame, baseline: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts",
                   value: str = "value", tie: Sequence[str] = (), k_sigma: float = 0.5,
                   h_sigma: float = 5.0, seconds: int | None = None) -> DataFrame:
    """Every reset of the two-sided CUSUM, before cooldown."""
    d = attach(_present(df, value, ts, seconds), baseline.select(*keys, "mean", "sigma"),
               keys, ts, seconds)
    out = scan(d, Cusum(k_sigma, h_sigma, value), keys, [ts, *tie], ts, seconds)
    return (out.withColumn("shift", (F.col(value) - F.col("mean")) / F.col("sigma"))
            .withColumn("confidence",
                        F.least(F.lit(1.0), F.col("cusum") / (2.0 * h_sigma * F.col("sigma")))))


def shewhart_alerts(df, baseline, cooldown_s: float = 600, seconds: int | None = None) -> DataFrame:
    v = shewhart_violations(df, baseline, seconds=seconds)
    v = thin(v, SERIES, cooldown_s, seconds=seconds)
    return as_alerts(
        v, detector="SPC.Shewhart", alert_type="shewhart_violation",
        severity=severity_from_sigma(F.col("deviation")), side=F.col("side"),
        value=F.col("value"), lim=F.col("lim"),
        confidence=F.least(F.lit(1.0), F.col("deviation") / 3.0),
        message=F.format_string("%s at %.3f is %s its three-sigma limit %.3f", F.col("tag"),
                                F.col("value"), F.col("side"), F.col("lim")),
        extra=extra_struct(deviation_sigma=F.col("deviation")),
    )


def ewma_alerts(df, baseline, cooldown_s: float = 600, lam: float = 0.2,
                seconds: int | None = None) -> DataFrame:
    v = thin(ewma_violations(df, baseline, lam=lam, seconds=seconds), SERIES, cooldown_s, seconds=seconds)
    return as_alerts(
        v, detector="SPC.EWMA", alert_type="ewma_violation",
        severity=severity_from_sigma(F.col("deviation")), side=F.col("side"),
        value=F.col("ewma"), lim=F.col("lim"),
        confidence=F.least(F.lit(1.0), F.col("deviation") / 3.0),
        message=F.format_string("%s moving average %.3f is %s its limit %.3f", F.col("tag"),
                                F.col("ewma"), F.col("side"), F.col("lim")),
        extra=extra_struct(deviation_sigma=F.col("deviation")),
    )


def cusum_alerts(df, baseline, cooldown_s: float = 1800, k_sigma: float = 0.5, h_sigma: float = 5.0,
                 seconds: int | None = None) -> DataFrame:
    t = cusum_triggers(df, baseline, k_sigma=k_sigma, h_sigma=h_sigma, seconds=seconds)
    t = thin(t, SERIES, cooldown_s, seconds=seconds)
    return as_alerts(
        t, detector="Regime.CUSUM", alert_type="regime_change",
        severity=severity_from_shift(F.abs(F.col("shift"))),
        side=F.when(F.col("direction") == "upward", "above").otherwise("below"),
        value=F.col("value"), lim=F.col("mean"), confidence=F.col("confidence"),
        message=F.format_string("%s moved %s to %.3f from a mean of %.3f (%+.2f sigma)", F.col("tag"),
                                F.col("direction"), F.col("value"), F.col("mean"), F.col("shift")),
        extra=extra_struct(deviation_sigma=F.col("shift"), direction=F.col("direction"),
                           cusum=F.col("cusum")),
    )
