"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are the runs of 2, 3 and 4 bytes of its lower-cased UTF-8 form, with everything but
letters as one kind of gap.  Each hashes to an embedding; their mean over the whole text goes through a
linear softmax.  Both are trained by stochastic gradient descent in numpy on a bounded sample.  A
temperature fitted on rows kept aside calibrates the probabilities, and a text is rejected when its
best probability is below a threshold that those rows almost never fall under, or when it has no letter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, free, row_batches, spread_sample, tidy

#: Rows the model is trained on, about, and code points of one text: of a longer one, as many in even pieces from its
#: first to its last.
TRAIN_ROWS = 3_000
TRAIN_CHARS = 100_000
TRAIN_PIECES = 20
SLOTS = 1 << 15
WIDTH = 16
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_GAP = np.arange(256, dtype=np.uint8)
_GAP[[b for b in range(128) if not chr(b).isalpha()]] = 32
_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_PIECE = 1 << 20


def _runs(data: np.ndarray):
    """Slots of the subwords that start at each byte, one array per length."""
    bytes_ = _GAP[data].astype(np.uint32) + np.uint32(1)
    total = bytes_ * _MULTIPLY[0]
    for k in range(1, 4):
        if len(bytes_) <= k:
            return
        total = total[:-1] + bytes_[k:] * _MULTIPLY[k]
        yield k + 1, ((total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int32)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)


def _sums(table: np.ndarray, text: str) -> tuple[np.ndarray, int]:
    """Sum of table rows over the subwords of a text, and their number; long texts in pieces."""
    data, total, count = _bytes(text), np.zeros(table.shape[1]), 0
    for at in range(0, len(data), _PIECE):
        for length, slots in _runs(data[at:at + _PIECE + 3]):
            slots = slots[:max(0, min(_PIECE, len(data) - length + 1 - at))]
            total += np.bincount(slots, minlength=len(table)) @ table if len(slots) > 30_000 else \
                table[slots].sum(axis=0, dtype=np.float64)
            count += len(slots)
    return total, count


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray       # embeddings times weights: a row of logits for each slot
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, text: str) -> np.ndarray:
        total, count = _sums(self.table, text)
        logits = (total / max(count, 1) + self.bias) / self.temperature
        e = np.exp(logits - logits.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability; `und` and 0 without letters or without a model."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        p = self.probabilities(text)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def train(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 2.0, seed: int = 5) -> Model:
    """SGD over whole texts; one in five is kept aside for the temperature and the threshold."""
    names = sorted(set(langs))
    y = np.array([names.index(k) for k in langs], dtype=np.int64)
    rng = np.random.default_rng(seed)
    if len(names) < 2:
        return Model(names, np.zeros((SLOTS, len(names)), dtype=np.float32), np.zeros(len(names)))
    bags = []
    for text in texts:
        slots = np.concatenate([s for _, s in _runs(_bytes(text))])
        own, times = np.unique(slots, return_counts=True)
        bags.append((own, (times / len(slots)).astype(np.float32)))
    aside = rng.random(len(y)) < 0.2
    emb = rng.normal(0, 0.1, (SLOTS, WIDTH)).astype(np.float32)
    w, b = np.zeros((WIDTH, len(names)), dtype=np.float32), np.zeros(len(names), dtype=np.float32)
    steps = epochs * int((~aside).sum())
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~aside)):
            own, share = bags[i]
            step = rate * (1 - done / steps)
            done += 1
            mean = share @ emb[own]
            logits = mean @ w + b
            e = np.exp(logits - logits.max())
            slope = e / e.sum()
            slope[y[i]] -= 1
            back = w @ slope
            w -= step * np.outer(mean, slope)
            b -= 0.1 * step * slope
            emb[own] -= (8 * step) * np.outer(share, back)
    table = (emb @ w).astype(np.float32)
    model = Model(names, table, b.astype(np.float64))
    if aside.any():
        logits = np.array([bags[i][1] @ table[bags[i][0]] + b for i in np.flatnonzero(aside)])
        _calibrate(model, logits, y[aside])
    return model


def _calibrate(model: Model, logits: np.ndarray, y: np.ndarray) -> None:
    """The temperature of least log loss, and a threshold at half of what one row in 500 falls under, 0.4 at most."""
    def soft(t):
        e = np.exp(logits / t - (logits / t).max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    grid = np.geomspace(0.05, 500, 90)
    losses = [-np.log(np.clip(soft(t)[np.arange(len(y)), y], 1e-9, 1)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    best = soft(model.temperature).max(axis=1)
    model.threshold = float(min(0.4, 0.5 * np.quantile(best, 0.002)))


def bounded(text: Column, chars: int, pieces: int = TRAIN_PIECES) -> Column:
    """The text, or `pieces` even pieces of it, `chars` code points in all, spread from its start to its end."""
    size, length = max(1, chars // pieces), F.length(text)
    some = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(
        text, F.floor(i * (length - size) / F.lit(pieces - 1)).cast("int") + 1, F.lit(size)))
    return F.when(length > chars, F.array_join(some, " ")).otherwise(text)


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> Model:
    """Train on about `train_rows` rows of `(doc_id, text, lang)` that have a language and a letter.

    Repeated rows count once.  Without such rows, as in an empty table, the model knows no language and every text
    is `und` with score 0.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    some = spread_sample(usable.select("doc_id", "text", "lang"), F.col("doc_id"), train_rows, 3)
    some = some.withColumn("text", bounded(F.col("text"), train_chars)).distinct().collect()
    some = sorted((r.doc_id or 0, r.text, r.lang) for r in some if _LETTER.search(r.text))
    return train([t for _, t, _ in some], [k for _, _, k in some])


def with_language(docs: DataFrame, model: Model, names=("lang_pred", "score", "accepted")) -> DataFrame:
    """`docs` with the language, its probability and whether it is accepted; every row stays.

    A column that already has one of these names is replaced.
    """
    rows = docs.drop(*names)
    kept = rows.columns
    text, = free(kept, "_text")

    def work(batches):
        for batch in row_batches(batches, text):
            got = [model.predict(t) for t in batch.column(text).to_pylist()]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                   pa.array([g[0] != UNKNOWN and g[1] >= model.threshold for g in got])]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *new], [*kept, *names])

    return rows.withColumn(text, F.col("text").cast("string")).mapInArrow(
        tidy(work), f"{fields(rows)}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")
