"""Multivariate monitoring: distributed correlation fit, T² and SPE as Columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ladders import severity_from_ratio
from ..functions.stats import hotelling_limit, residual_limit
from .alerts import as_alerts
from .recurrences import thin
from .scale import attach_small

MIN_TRAIN = 30
ONE_AGG_COLUMNS = 32
MODEL_DDL = (
    "tags ARRAY<STRING>, means ARRAY<DOUBLE>, stds ARRAY<DOUBLE>, components ARRAY<ARRAY<DOUBLE>>, "
    "eigenvalues ARRAY<DOUBLE>, n_components INT, variance_explained DOUBLE, t2_limit DOUBLE, "
    "spe_limit DOUBLE, n_train LONG"
)


@dataclass(frozen=True)
class PcaModel:
    """Loadings and limits; p×p numbers, independent of the data volume."""

    tags: list[str]
    means: list[float]
    stds: list[float]
    components: list[list[float]]
    eigenvalues: list[float]
    n_components: int
    variance_explained: float
    t2_limit: float
    spe_limit: float
    n_train: int

    def to_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(vars(self).values())], MODEL_DDL)

    @staticmethod
    def from_table(df: DataFrame) -> PcaModel:
        return PcaModel(**df.first().asDict())


def _corr(a: str, b: str) -> Column:
    """Correlation; null where a column stands still, which `corr` answers with an error in ANSI mode."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def correlation_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair of columns over complete rows, in one aggregation."""
    cols = list(columns)
    complete = df.select(*cols).dropna()
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    agg = complete.agg(*[_corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("r"))
                     for i, (a, b) in enumerate(pairs)])
    return agg.select(F.explode(rows).alias("x")).select("x.*")


def _moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Row count, means, sample deviations and correlation matrix of complete rows."""
    p = len(cols)
    if p <= ONE_AGG_COLUMNS:
        pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
        row = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols], *[F.stddev_samp(c) for c in cols],
                     *[_corr(cols[i], cols[j]) for i, j in pairs]).first()
        r = np.eye(p)
        for (i, j), v in zip(pairs, row[1 + 2 * p:]):
            r[i, j] = r[j, i] = v if v is not None else np.nan
        n, mu, sd = row[0], np.array(row[1:1 + p], float), np.array(row[1 + p:1 + 2 * p], float)
        return n, mu, sd, r
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation, Summarizer
    vec = VectorAssembler(inputCols=cols, outputCol="v").transform(df).select("v")
    s = vec.select(Summarizer.metrics("count", "mean", "std").summary(vec.v).alias("s")).first().s
    return int(s["count"]), s["mean"].toArray(), s["std"].toArray(), Correlation.corr(vec, "v").first()[0].toArray()


def fit_pca(df: DataFrame, tags: Sequence[str], variance: float = 0.90, alpha: float = 0.99,
            legacy_n: int | None = None) -> PcaModel:
    """Fit on complete rows of a wide frame; only p×p numbers reach the driver.

    `legacy_n` replaces the fitted row count in the T² limit.
    """
    cols = list(tags)
    n, mu, sd, r = _moments(df.select(*cols).dropna(), cols)
    if n < MIN_TRAIN:
        raise ValueError(f"not enough training samples: {n} (need {MIN_TRAIN})")
    return _solve(cols, n, mu, sd, r, variance, alpha, legacy_n)


def _solve(cols: list[str], n: int, mu: np.ndarray, sd: np.ndarray, r: np.ndarray, variance: float,
           alpha: float, legacy_n: int | None) -> PcaModel:
    flat = ~(sd >= 1e-9)
    r[flat, :] = 0.0
    r[:, flat] = 0.0
    sd = np.where(flat, 1e-9, sd)
    values, vectors = np.linalg.eigh(r)
    order = np.argsort(-values, kind="stable")
    values, vectors = np.clip(values[order], 0.0, None), vectors[:, order]
    share = np.cumsum(values) / values.sum()
    k = max(1, min(int(np.searchsorted(share, variance)) + 1, len(cols) - 1))
    return PcaModel(
        cols, mu.tolist(), sd.tolist(), vectors[:, :k].T.tolist(), values[:k].tolist(), k,
        float(share[k - 1]), hotelling_limit(k, legacy_n or n, alpha),
        residual_limit(values[k:], alpha), int(n))


def moments_by(df: DataFrame, tags: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """`keys, n_train, means, stds, r` per group over its complete rows, in one aggregation.

    `r` is the upper triangle of the correlations, row by row.  Partial aggregates leave a row per group
    and task, so a group with a third of all rows costs no more than any other.
    """
    cols = list(tags)
    if len(cols) > ONE_AGG_COLUMNS:
        raise ValueError(f"models per group take at most {ONE_AGG_COLUMNS} tags, not {len(cols)}")
    listed = lambda xs: F.array(*xs).cast("array<double>")
    return df.select(*keys, *cols).dropna().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_train"), listed([F.avg(c) for c in cols]).alias("means"),
        listed([F.stddev_samp(c) for c in cols]).alias("stds"),
        listed([_corr(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]).alias("r"))


def fit_pca_by(df: DataFrame, tags: Sequence[str], keys: Sequence[str] = ("asset",), variance: float = 0.90,
               alpha: float = 0.99, legacy_n: int | None = None) -> DataFrame:
    """A model per group as a table of `keys` and the fields of `PcaModel`; nothing reaches the driver.

    A group with fewer than MIN_TRAIN complete rows, or whose tags all stand still, has no model yet and
    no row.  Rows with a null key or tag take no part.
    """
    cols = list(tags)
    m = moments_by(df, cols, keys).filter((F.col("n_train") >= MIN_TRAIN) & (F.array_max("stds") >= 1e-9))
    schema = T.StructType([*(m.schema[k] for k in keys), *T.StructType.fromDDL(MODEL_DDL).fields])
    upper = np.triu_indices(len(cols), 1)
    real, reals = pa.float64(), pa.list_(pa.float64())
    types = {"tags": pa.list_(pa.string()), "means": reals, "stds": reals, "components": pa.list_(reals),
             "eigenvalues": reals, "n_components": pa.int32(), "variance_explained": real, "t2_limit": real,
             "spe_limit": real, "n_train": pa.int64()}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = []
            for row in batch.select(["n_train", "means", "stds", "r"]).to_pylist():
                r = np.eye(len(cols))
                r[upper] = np.array(row["r"], dtype=float)
                r.T[upper] = r[upper]
                models.append(_solve(cols, row["n_train"], np.array(row["means"]), np.array(row["stds"], dtype=float),
                                     r, variance, alpha, legacy_n))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys),
                 *(pa.array([getattr(x, f) for x in models], t) for f, t in types.items())], [*keys, *types])

    return m.mapInArrow(solve, schema)


def score_pca_by(df: DataFrame, models: DataFrame, tags: Sequence[str], keys: Sequence[str] = ("asset",),
                 top: int = 3) -> DataFrame:
    """Like `score_pca`, each complete row by the model of its group, plus that model's two limits.

    Rows of groups without a model are left out.  Models join as a small table, or salted where they are
    many; loadings are arrays, so one expression serves all groups.
    """
    fields = ["means", "stds", "components", "eigenvalues", "t2_limit", "spe_limit"]
    mine = models.select(*keys, F.struct(*fields).alias("_m"))
    d = attach_small(df.dropna(subset=list(tags)), mine, keys, F.hash(*tags))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    times = lambda xs, ys: F.zip_with(xs, ys, lambda x, y: x * y)
    x = F.array(*[F.col(t).cast("double") for t in tags])
    d = d.withColumn("_z", F.zip_with(F.zip_with(x, "_m.means", lambda v, mu: v - mu), "_m.stds", lambda v, sd: v / sd))
    d = d.withColumn("_s", F.transform("_m.components", lambda row: add(times(row, F.col("_z")))))
    back = F.transform(F.sequence(F.lit(0), F.lit(len(tags) - 1)), lambda i: add(
        F.zip_with("_m.components", "_s", lambda row, score: F.get(row, i) * score)))
    d = d.withColumn("_q", F.zip_with("_z", back, lambda z, b: (z - b) * (z - b)))
    names = F.array(*[F.lit(t) for t in tags])
    worst = F.slice(F.array_sort(F.transform("_q", lambda q, i: F.struct(
        (-q).alias("neg"), i.alias("i"), F.get(names, i).alias("tag")))), 1, top)
    return d.withColumn("t2", add(F.zip_with("_s", "_m.eigenvalues", lambda v, lam: v * v / lam))).withColumn(
        "spe", add(F.col("_q"))).withColumn("t2_limit", F.col("_m.t2_limit")).withColumn(
        "spe_limit", F.col("_m.spe_limit")).withColumn(
        "contributors", F.map_from_entries(F.transform(worst, lambda w: F.struct(w.tag, -w.neg)))).drop(
        "_m", "_z", "_s", "_q")


def score_pca(df: DataFrame, model: PcaModel, top: int = 3) -> DataFrame:
    """T², SPE and the `top` residual contributors of every complete row.

    Up to ONE_AGG_COLUMNS tags the projection is unrolled into generated code; wider
    models are multiplied batch by batch.
    """
    d = df.dropna(subset=model.tags)
    if len(model.tags) > ONE_AGG_COLUMNS:
        return _score_batches(d, model, top)
    p = len(model.tags)
    z = {f"_z{i}": (F.col(t) - model.means[i]) / model.stds[i] for i, t in enumerate(model.tags)}
    d = d.withColumns(z)
    s = {f"_s{j}": _dot(row, [F.col(f"_z{i}") for i in range(p)]) for j, row in enumerate(model.components)}
    d = d.withColumns(s)
    q = {}
    for i in range(p):
        back = _dot([row[i] for row in model.components], [F.col(f"_s{j}") for j in range(model.n_components)])
        gap = F.col(f"_z{i}") - back
        q[f"_q{i}"] = gap * gap
    d = d.withColumns(q)
    t2 = _sum([F.col(f"_s{j}") * F.col(f"_s{j}") / lam for j, lam in enumerate(model.eigenvalues)])
    spe = _sum([F.col(f"_q{i}") for i in range(p)])
    worst = F.slice(F.array_sort(F.array(*[
        F.struct((-F.col(f"_q{i}")).alias("neg"), F.lit(i).alias("i"), F.lit(t).alias("tag"))
        for i, t in enumerate(model.tags)])), 1, top)
    d = d.withColumn("t2", t2).withColumn("spe", spe).withColumn(
        "contributors", F.map_from_entries(F.transform(worst, lambda x: F.struct(x.tag, -x.neg))))
    return d.drop(*z, *s, *q)


def _score_batches(d: DataFrame, model: PcaModel, top: int) -> DataFrame:
    tags, means, stds = list(model.tags), np.array(model.means), np.array(model.stds)
    loads, lam = np.array(model.components), np.array(model.eigenvalues)
    schema = T.StructType(d.schema.fields + T.StructType.fromDDL(
        "t2 DOUBLE, spe DOUBLE, _who ARRAY<STRING>, _much ARRAY<DOUBLE>").fields)

    def score(batches):
        for pdf in batches:
            z = (pdf[tags].to_numpy(float) - means) / stds
            s = z @ loads.T
            q = (z - s @ loads) ** 2
            order = np.argsort(-q, axis=1, kind="stable")[:, :top]
            yield pdf.assign(t2=(s * s / lam).sum(1), spe=q.sum(1), _who=[[tags[i] for i in r] for r in order],
                             _much=[list(v) for v in np.take_along_axis(q, order, 1)])
    return (d.mapInPandas(score, schema)
            .withColumn("contributors", F.map_from_arrays("_who", "_much")).drop("_who", "_much"))


def _sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def _dot(weights, cols: list[Column]) -> Column:
    return _sum([F.lit(float(w)) * c for w, c in zip(weights, cols)])


def pca_alerts(wide: DataFrame, model: PcaModel, cooldown_s: float = 600, top: int = 3,
               seconds: int | None = None) -> DataFrame:
    """T² and SPE alerts of (asset, scenario, ts, tags…) rows, each with its own cooldown."""
    s = score_pca(wide, model, top)
    return _limit_alerts(s, F.lit(model.t2_limit), F.lit(model.spe_limit), cooldown_s, seconds)


def pca_alerts_by(wide: DataFrame, models: DataFrame, tags: Sequence[str], keys: Sequence[str] = ("asset",),
                  cooldown_s: float = 600, top: int = 3, seconds: int | None = None) -> DataFrame:
    """`pca_alerts`, each row against the model of its group; groups without a model raise none."""
    s = score_pca_by(wide, models, tags, keys, top)
    return _limit_alerts(s, F.col("t2_limit"), F.col("spe_limit"), cooldown_s, seconds)


def _limit_alerts(s: DataFrame, t2_limit: Column, spe_limit: Column, cooldown_s: float, seconds: int | None) -> DataFrame:
    long = s.select("asset", "scenario", "ts", F.to_json("contributors").alias("_c"), F.explode(F.array(
        F.struct(F.lit("PCA.T2").alias("stat"), F.col("t2").alias("value"), t2_limit.alias("lim")),
        F.struct(F.lit("PCA.SPE").alias("stat"), F.col("spe").alias("value"), spe_limit.alias("lim")),
    )).alias("x")).select("asset", "scenario", "ts", "_c", "x.*").filter(F.col("value") > F.col("lim"))
    kept = thin(long, ["asset", "scenario", "stat"], cooldown_s, seconds=seconds)
    kept = kept.withColumn("contributors", F.from_json("_c", "map<string,double>"))
    ratio = F.col("value") / F.col("lim")

    def stream(stat: str, kind: str, label: str) -> DataFrame:
        return as_alerts(
            kept.filter(F.col("stat") == stat), detector=stat, alert_type=kind,
            severity=severity_from_ratio(ratio), value=F.col("value"), lim=F.col("lim"),
            tag=F.lit(None), side=F.lit("above"),
            confidence=F.least(F.lit(1.0), F.log1p(ratio) / F.log(F.lit(10.0))),
            message=F.format_string(label + " %.2f exceeds %.2f", F.col("value"), F.col("lim")),
            contributors=F.col("contributors"))
    return stream("PCA.T2", "hotelling_t2", "T²").unionByName(stream("PCA.SPE", "spe_q", "SPE"))
