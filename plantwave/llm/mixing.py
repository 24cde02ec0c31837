"""Mixing of sources to target weights by Poisson replication, in DataFrame functions only.

A source with weight w gets the share w / (sum of weights) of the output, so each of its documents should
appear lambda = share * rows out / rows of the source times on average.  A hash of the seed and the
document gives a number in [0, 1), and the inverse of the Poisson distribution with mean lambda
turns it into a count: the same in every run, whatever the partitioning.  Documents are repeated that
often and shuffled globally by another hash.

Declared sources have a weight each; all others, and a null source, together make one more source with the
weight `rest`.  So the driver holds as many counts as there are weights, however many sources there are.
Rows of equal doc_id, source and text draw the same count.  A source without rows leaves its share to the
others; weights of 0 drop a source.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

#: Target weights of the query and the pipeline: four levels over twenty sources.
WEIGHTS = {f"src{i}": 1.0 + i % 4 for i in range(20)}
REST = 1.0
SEED = 2024
_DIGITS = 12
_REST_KEY = ""


def poisson_steps(mean: float) -> list[float]:
    """Cumulative probabilities of 0, 1, 2, … up to where they reach 1 as doubles."""
    if mean <= 0:
        return []
    out, total, k = [], 0.0, 0
    while True:
        p = math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        total += p
        out.append(total)
        if k > mean and p < 1e-17:
            return out
        k += 1


def rates(docs: DataFrame, weights: Mapping[str, float], rest: float, rows_out: int | None) -> dict[str, float]:
    """Mean repetitions of each declared source, and of all others under the empty name."""
    counts = {r.key: r.n for r in docs.groupBy(_key(weights).alias("key")).agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {k: (rest if k == _REST_KEY else weights[k]) for k in counts}
    total = sum(wanted.values())
    rows = sum(counts.values()) if rows_out is None else rows_out
    return {k: (wanted[k] / total * rows / n if total > 0 else 0.0) for k, n in counts.items()}


def _key(weights: Mapping[str, float]) -> Column:
    named = F.col("source").isin([k for k in weights if k != _REST_KEY])
    return F.when(named, F.col("source")).otherwise(F.lit(_REST_KEY))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 48 bits of the MD5 of the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16 ** _DIGITS))


def counted(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, rest: float = REST,
            rows_out: int | None = None, seed: int = SEED, copies: str = "copies") -> DataFrame:
    """`docs` with one more column, the Poisson count of each row; one of that name is replaced."""
    means = rates(docs, weights, rest, rows_out)
    key, drawn = free(docs.columns, "_key", "_draw")
    draw = uniform(seed, F.col("doc_id"), F.col("source"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    times = F.lit(0)
    for name, mean in means.items():
        steps = poisson_steps(mean)
        if steps:
            n = F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= F.col(drawn)))
            times = F.when(F.col(key) == name, n).otherwise(times)
    return docs.withColumn(key, _key(weights)).withColumn(drawn, draw).withColumn(copies, times).drop(key, drawn)


def mix(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, rest: float = REST, rows_out: int | None = None,
        seed: int = SEED, copy: str = "copy") -> DataFrame:
    """The mixed rows in global random order: the columns of `docs`, and `copy`, from 1 for each row."""
    times, order = free([*docs.columns, copy], "_copies", "_order")
    rows = counted(docs, weights, rest, rows_out, seed, times).filter(F.col(times) > 0)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(times)
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"), F.col(copy))
    return rows.withColumn(order, place).repartition(order).sortWithinPartitions(order).drop(order)


def sql(columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """The query's rows in DuckDB."""
    values = ", ".join(f"('{k}', {w})" for k, w in WEIGHTS.items())
    key = f"CASE WHEN source IN ({', '.join(repr(k) for k in WEIGHTS)}) THEN source ELSE '' END"
    return f"""WITH w(key, weight) AS (VALUES {values}, ('', {REST})),
keyed AS (SELECT *, {key} AS key FROM documents),
counts AS (SELECT key, count(*) AS n FROM keyed GROUP BY key),
rates AS (SELECT key, weight / sum(weight) OVER () * (SELECT count(*) FROM documents) / n AS mean
  FROM counts JOIN w USING (key)),
steps AS (SELECT key, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY key ORDER BY k) AS step
  FROM rates, range(0, 400) r(k) WHERE mean > 0),
drawn AS (SELECT *, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '~') || '|' || coalesce(source, '~')
  || '|' || md5(coalesce(text, ''))), 1, {_DIGITS}))::BIGINT / {16 ** _DIGITS}.0::DOUBLE AS draw FROM keyed),
counted AS (SELECT d.*, (SELECT count(*) FROM steps s WHERE s.key = d.key AND s.step <= d.draw) AS copies
  FROM drawn d)
SELECT {columns}, unnest(range(1, copies + 1))::INTEGER AS copy FROM counted WHERE copies > 0"""
