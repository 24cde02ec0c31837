"""Exact top-k search over sparse integer vectors, term at a time.

A block of candidates is an inverted index: for each term the rows with a weight and their weights.  A query's
terms are taken one after another; each scatters its weighted postings into a dense array of scores, one
row for each query of a group.  A partition selection takes the best of every row, and the
blocks' results are merged.  Integer arithmetic throughout, so results are exact whatever the order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from . import vectors

#: Factor between a component and its integer weight.
SCALE = 1024
#: Queries whose score arrays are filled together.
TOGETHER = 32


def weights(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as integers: 64-bit ones, or Python's where those are too narrow."""
    scaled = np.floor(SCALE * x)
    if not np.isfinite(scaled).all():
        raise OverflowError("a component is too large to scale")
    if np.abs(scaled).max(initial=0.0) < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([[int(w) for w in row] for row in scaled], dtype=object).reshape(scaled.shape)


def postings(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term the rows that have it and their weights."""
    return [(at, rows[at, t]) for t in range(rows.shape[1]) for at in [np.flatnonzero(rows[:, t])]]


def accumulate(queries: np.ndarray, index: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of all n rows for each query."""
    scores = np.zeros((len(queries), n), dtype=queries.dtype)
    for t, (at, held) in enumerate(index):
        asking = np.flatnonzero(queries[:, t])
        if not len(at) or not len(asking):
            continue
        added = queries[asking, t][:, None] * held
        if len(at) == n and len(asking) == len(queries):
            scores += added
        else:
            scores[np.ix_(asking, at)] += added
    return scores


def search(rows: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`(query_id, rank, vec_id, score)`: the k highest integer inner products for each query.

    Vectors of another length than the query's are no candidates.  Null vectors and those with a null or
    non-finite component take no part; a vector of zeros does.  A score beyond 64 bits raises an error.
    """
    def nearest(query_ids, asked, ids, stored):
        held, wanted = weights(stored), weights(asked)
        most = (int(np.abs(held).max(initial=0)) * int(np.abs(wanted).max(initial=0))) * held.shape[1]
        if most >= 2**63:
            held, wanted = held.astype(object), wanted.astype(object)
        index = postings(held)
        out = []
        for start in range(0, len(wanted), TOGETHER):
            scores = accumulate(wanted[start:start + TOGETHER], index, len(held))
            for query, row in zip(query_ids[start:start + TOGETHER].tolist(), scores):
                at = vectors.top(row, k + 1) if row.dtype != object else np.array(
                    sorted(range(len(row)), key=lambda j: (-row[j], j))[:k + 1], dtype=np.int64)
                at = at[ids[at] != query][:k]
                out.append((np.full(len(at), query), ids[at], np.array(row[at], dtype=np.int64)))
        return tuple(np.concatenate(p) for p in zip(*out))

    return vectors.search(vectors.usable(rows, id_col, vector_col, nonzero=False), queries, k, "long", nearest)


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
