"""Models on Spark ML: soft-sensor ensemble, multi-horizon forecaster, promotion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reports import regression_metrics
from .windows import lag_features, time_split


def uniform(key: Column, salt: int) -> Column:
    """A repeatable draw in [0, 1) that does not depend on partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def holdout(df: DataFrame, key: Column, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by key hash."""
    u = uniform(key, seed)
    return df.filter(u >= share), df.filter(u < share)


def bootstrap_weight(key: Column, seed: int) -> Column:
    """Poisson(1) row weights: a bootstrap sample without moving rows."""
    u = uniform(key, seed)
    # Cumulative Poisson(1) probabilities.
    steps = [0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815]
    out = F.lit(6.0)
    for k in reversed(range(len(steps))):
        out = F.when(u < steps[k], float(k)).otherwise(out)
    return out


def _complete(columns: Sequence[str]) -> Column:
    """True where no input is null or NaN."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double"))
    return ok


@dataclass
class SoftSensor:
    """An ensemble of boosted trees; prediction is their mean, spread their deviation."""

    features: list[str]
    target: str
    models: list
    n_train: int = 0

    def predict(self, df: DataFrame) -> DataFrame:
        """Every row stays; one with a missing input has a null prediction.

        Fill gaps before, with `fill_both_ways`, to predict from the nearest readings.
        """
        d = VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="keep").transform(df)
        for i, m in enumerate(self.models):
            d = m.setPredictionCol(f"_p{i}").transform(d)
        cols = [F.col(f"_p{i}") for i in range(len(self.models))]
        mean = F.when(_complete(self.features), sum(cols[1:], cols[0]) / len(cols))
        var = sum([F.pow(c - F.col("predicted"), F.lit(2.0)) for c in cols], F.lit(0.0)) / len(cols)
        return (d.withColumn("predicted", mean).withColumn("std", F.sqrt(var))
                .drop("_x", *[f"_p{i}" for i in range(len(self.models))]))

    def importances(self, spark) -> DataFrame:
        """Average gain share per feature, largest first."""
        n = len(self.models)
        total = [sum(float(m.featureImportances[i]) for m in self.models) / n for i in range(len(self.features))]
        return spark.createDataFrame(list(zip(self.features, total)), "feature string, importance double") \
                    .orderBy(F.desc("importance"), "feature")


#: Rows up to which trees are fitted row by row; beyond, points that rows with the same inputs are dealt into, and points of a task.
FIT_ROWS = 1_000_000
POINTS = 16
POINTS_A_TASK = 10_000


def _points(d: DataFrame, features: Sequence[str], target: str, key: Column, weights: dict[str, Column],
            seed: int) -> DataFrame:
    """Rows with the same inputs as up to `POINTS` points: per model their weight and their weighted mean target.

    Splits of squared error depend on sums of weights and of weighted targets only, so a point takes part as its rows
    would.  Rows go to a point by a hash of their key; subsamples draw points.
    """
    y = F.col(target).cast("double")
    d = d.select(*features, F.floor(uniform(key, seed - 1) * POINTS).alias("_point"), y.alias("_y"),
                 *[w.alias(n) for n, w in weights.items()])
    sums = [a for n in weights for a in (F.sum(n).alias(n), F.sum(F.col(n) * F.col("_y")).alias(f"_s{n}"))]
    mean = [F.when(F.col(n) > 0, F.col(f"_s{n}") / F.col(n)).otherwise(0.0).alias(f"_y{n}") for n in weights]
    return d.groupBy(*features, "_point").agg(*sums).select(*features, *weights, *mean)


def fit_soft_sensor(train: DataFrame, features: Sequence[str], target: str, key: Column, n_models: int = 5,
                    trees: int = 200, depth: int = 5, step: float = 0.05, min_leaf: int = 20,
                    subsample: float = 0.8, seed: int = 42) -> SoftSensor:
    """Boosted trees on bootstrap weights.  Trees do not need scaled inputs.

    Beyond `FIT_ROWS` rows of which many have the same inputs, trees see points in place of rows (`_points`), which are
    as many as there are different inputs, whatever the rows; a leaf then has to weigh `min_leaf` in place of having so many.
    """
    d = train.dropna(subset=[*features, target])
    size = d.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.struct(*features)).alias("inputs")).first()
    n = size.n
    if n < 50:
        raise ValueError(f"too few samples to fit a soft sensor: {n}")
    weights = {f"_w{i}": bootstrap_weight(key, seed + i) for i in range(n_models)}
    dealt = n > FIT_ROWS and size.inputs * POINTS * 2 < n
    if dealt:
        d = _points(d, features, target, key, weights, seed).repartition(-(-size.inputs * POINTS // POINTS_A_TASK))
        labels = {w: f"_y{w}" for w in weights}
    else:
        d = d.select(*features, F.col(target).cast("double").alias("_y"), *[c.alias(w) for w, c in weights.items()])
        labels = dict.fromkeys(weights, "_y")
    d = VectorAssembler(inputCols=list(features), outputCol="_x").transform(d)
    d = d.select("_x", *dict.fromkeys(labels.values()), *weights).persist()
    leaf = dict.fromkeys(weights, {"minInstancesPerNode": min_leaf})
    if dealt:
        total = d.agg(*[F.sum(w).alias(w) for w in weights]).first()
        leaf = {w: {"minWeightFractionPerNode": min(0.49, min_leaf / total[w])} for w in weights}
    models = []
    for i, (w, label) in enumerate(labels.items()):
        gbt = GBTRegressor(featuresCol="_x", labelCol=label, weightCol=w, maxIter=trees, maxDepth=depth,
                           stepSize=step, subsamplingRate=subsample, seed=seed + i, **leaf[w])
        models.append(gbt.fit(d.filter(F.col(w) > 0)))
    d.unpersist()
    return SoftSensor(list(features), target, models, n)


def predict_with(df: DataFrame, features: Sequence[str], model, out: str = "predicted") -> DataFrame:
    """Score with a foreign model: `model(array of rows × features)` returns a number per row."""
    cols = list(features)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def score(batches):
        for pdf in batches:
            yield pdf.assign(**{out: model(pdf[cols].to_numpy(float))})
    return df.mapInPandas(score, schema)


@dataclass
class Forecaster:
    """One linear model per (target, horizon) on lagged inputs."""

    features: list[str]
    targets: list[str]
    lags: list[int]
    horizons: list[int]
    models: dict
    n_train: int = 0

    def inputs(self) -> list[str]:
        return [f"{f}__lag{k}" for f in self.features for k in self.lags]

    def predict(self, rows: DataFrame) -> DataFrame:
        """`p_<target>__h<h>` columns for rows made by :func:`lag_features`; null where an input is missing."""
        d = VectorAssembler(inputCols=self.inputs(), outputCol="_x", handleInvalid="keep").transform(rows)
        d = d.withColumn("_a", vector_to_array("_x"))
        out = {}
        for (t, h), (weights, bias) in self.models.items():
            dot = F.aggregate(F.zip_with("_a", F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b),
                              F.lit(0.0), lambda acc, v: acc + v)
            out[f"p_{t}__h{h}"] = F.when(_complete(self.inputs()), dot + F.lit(bias))
        return d.withColumns(out).drop("_x", "_a")


def fit_forecaster(train: DataFrame, features: Sequence[str], targets: Sequence[str], lags: Sequence[int],
                   horizons: Sequence[int], ridge: float = 1e-6) -> Forecaster:
    """Inputs are standardised inside the solver from the training rows only."""
    f = Forecaster(list(features), list(targets), list(lags), list(horizons), {})
    d = VectorAssembler(inputCols=f.inputs(), outputCol="_x").transform(train).persist()
    f.n_train = d.count()
    for t in targets:
        for h in horizons:
            m = LinearRegression(featuresCol="_x", labelCol=f"{t}__h{h}", regParam=ridge, standardization=True,
                                 solver="normal").fit(d)
            f.models[(t, h)] = ([float(w) for w in m.coefficients], float(m.intercept))
    d.unpersist()
    return f


def forecast_metrics(scored: DataFrame, targets: Sequence[str], horizons: Sequence[int],
                     keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R² per (horizon, target)."""
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(t).alias("target"),
                              F.col(f"{t}__h{h}").alias("actual"), F.col(f"p_{t}__h{h}").alias("predicted"))
                     for t in targets for h in horizons])
    long = scored.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")
    return regression_metrics(long, [*keys, "horizon", "target"], "actual", "predicted")


def collapse_metrics(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.avg("mae").alias("mae_overall"), F.max("mae").alias("mae_worst"))


def should_promote(new: Column, base: Column, threshold: float = 0.0) -> Column:
    """No baseline or a missing metric promotes; otherwise the error must fall enough."""
    return new.isNull() | base.isNull() | (new < base * (1.0 - threshold))


def evaluate_forecaster(wide: DataFrame, features, targets, lags, horizons, keys=("asset", "scenario"),
                        ts: str = "ts", tie: Sequence[str] = (), val_share: float = 0.2,
                        seconds: int | None = None) -> tuple[Forecaster, DataFrame]:
    """Fit on the earlier rows, score the later ones."""
    rows = lag_features(wide, features, targets, lags, horizons, keys, ts, tie, seconds)
    rows = time_split(rows, val_share, "now_ts", list(keys), seconds).persist()
    model = fit_forecaster(rows.filter(~F.col("is_val")), features, targets, lags, horizons)
    scored = model.predict(rows.filter("is_val"))
    return model, forecast_metrics(scored, targets, horizons)
