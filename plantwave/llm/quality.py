"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are Spark columns.  Boosted trees are grown on a bounded sample of labelled rows;
every path from a root is a rule, a conjunction of bounds on statistics.  A logistic regression with an L1
penalty keeps few of the rules, and these are compiled into one Spark column, so scoring needs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import free, spread_sample

#: Labelled rows the classifier is fitted on, about.
TRAIN_ROWS = 6_000
KEEP_FROM = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; a null counts as empty, and all are 0 for an empty one."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.length(text)
    words = F.filter(F.split(text, r"[\s]+"), lambda w: w != "")
    n_words = F.size(words)
    lines = F.filter(F.split(text, "\n"), lambda w: w != "")
    per = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    without = lambda pattern: chars - F.length(F.regexp_replace(text, pattern, ""))
    return {
        "chars": chars.cast("double"),
        "words": n_words.cast("double"),
        "word_length": per(chars, n_words),
        "symbols_a_word": per(without(r"[%&#$*|!@^~=<>_{}\[\]\\+]+"), n_words),
        "bars_a_word": per(without(r"\|+"), n_words),
        "shouts_a_word": per(without(r"!+"), n_words),
        "capitals": per(without(r"\p{Lu}+"), chars),
        "stops": per(without(r"[.,;:?]+"), chars),
        "digits": per(without(r"[0-9]+"), chars),
        "distinct_words": per(F.size(F.array_distinct(words)), n_words),
        "distinct_words_rooted": per(F.size(F.array_distinct(words)), F.sqrt(n_words.cast("double"))),
        "distinct_lines": per(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": per(n_words, F.size(lines)),
    }


@dataclass
class Rules:
    """`intercept` plus, for each rule that holds, its weight, through the logistic function."""
    names: list[str]
    intercept: float
    rules: list[tuple[float, tuple[tuple[int, bool, float], ...]]]

    def column(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for weight, path in self.rules:
            holds = None
            for f, above, cut in path:
                one = stats[self.names[f]] > cut if above else stats[self.names[f]] <= cut
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same in numpy."""
        hold = _holds(x, [p for _, p in self.rules])
        return 1 / (1 + np.exp(-(self.intercept + hold @ np.array([w for w, _ in self.rules]).reshape(-1))))


def _holds(x: np.ndarray, paths) -> np.ndarray:
    out = np.ones((len(x), len(paths)))
    for k, path in enumerate(paths):
        for f, above, cut in path:
            out[:, k] *= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the intercept, by accelerated proximal steps."""
    x = np.hstack([np.ones((len(r), 1)), r])
    size = np.linalg.norm(x, 2) ** 2 / (4 * len(x)) + 1e-9
    w = v = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(steps):
        slope = x.T @ (1 / (1 + np.exp(-(x @ v))) - y) / len(x)
        new = v - slope / size
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / size, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(names: list[str], x: np.ndarray, y: np.ndarray, seed: int = 7) -> Rules:
    """Rules from boosted trees, weighted by the penalty that does best on a fifth of the rows.

    Without rows the score is one half; with one class it is nearly that class.
    """
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Rules(names, float(np.log(share / (1 - share))), [])
    rng = np.random.default_rng(seed)
    test = rng.random(len(y)) < 0.2
    if test.all() or len(set(y[~test].tolist())) < 2 or not test.any():
        test = np.zeros(len(y), dtype=bool)
    grown = trees.fit(x[~test], y[~test], rounds=20, depth=3)
    found = trees.paths(grown)
    r = _holds(x, found)
    _, first = np.unique(r.T, axis=0, return_index=True)  # rules that hold for the same rows are one
    keep = [k for k in sorted(first) if 0 < r[:, k].mean() < 1]
    found, r = [found[k] for k in keep], r[:, keep]
    check = test if test.any() else ~test
    best = None
    for penalty in (0.03, 0.01, 0.003, 0.001, 0.0003):
        b, w = lasso(r[~test], y[~test], penalty)
        loss = _loss(1 / (1 + np.exp(-(b + r[check] @ w))), y[check])
        if best is None or loss < best[0] * 0.98:
            best = (loss, penalty)
    b, w = lasso(r, y, best[1], 800)
    used = np.flatnonzero(np.abs(w) > 1e-4)
    return Rules(names, b, [(float(w[k]), found[k]) for k in used])


def learn(docs: DataFrame, labels: DataFrame, usable: Column, train_rows: int = TRAIN_ROWS) -> Rules:
    """Fit on about `train_rows` labelled rows for which `usable`, a condition on doc_id, holds.

    Rows of one doc_id with different labels are left out, as are null labels.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(
        F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high").select(
        "doc_id", F.col("low").alias("_label"))
    known = spread_sample(known, F.col("doc_id"), train_rows, 11)
    stats = statistics(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(
        "_label", *(c.alias(k) for k, c in stats.items())).limit(4 * train_rows).collect()
    names = list(stats)
    x = np.array([[float(r[k]) for k in names] for r in rows]).reshape(len(rows), len(names))
    return fit(names, x, np.array([float(r["_label"] > 0) for r in rows]))


def with_score(docs: DataFrame, rules: Rules, score: str = "score") -> DataFrame:
    """`docs` with one more column, the score from 0 to 1 of the column `text`; one of that name is replaced."""
    stats = statistics(F.col("text"))
    held, row = free(docs.columns, "_statistics", "_row")
    # a column that is not deterministic keeps a filter on the score above the statistics, which it would repeat
    rows = docs.withColumns({held: F.struct(*(c.alias(k) for k, c in stats.items())), row: F.monotonically_increasing_id()})
    value = F.when(F.col(row) >= 0, rules.column({k: F.col(held)[k] for k in stats}))
    return rows.withColumn(score, value).drop(held, row)
