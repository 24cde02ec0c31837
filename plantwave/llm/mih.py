"""Approximate nearest neighbours by multi-index hashing, for the largest inner product.

Vectors get one more component that makes all lengths equal (0 for a query), so that the largest inner
product is the smallest angle.  Learned rotations turn them into bits: each rotation is fitted, on a bounded
sample, to lie close to the corners of a cube, from principal directions and a random start of its own, and
a bit is the sign of a rotated component.

Each block of candidates is indexed once per substring of the code: the distinct values of the substring,
and which codes have them.  By the pigeonhole principle a code within distance r of the query's has a
substring within r // substrings of the query's, so probing the values within that distance finds every code within
r.  A query first widens r until k codes lie within it, the last at distance d; then it takes all codes
within d + SLACK and ranks them by the inner product of the original vectors, in double precision.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import spread_sample

#: Vectors that the rotations are fitted on, about.
TRAIN_ROWS = 8_000
BITS = 256
SUBSTRING = 8
#: Bits beyond the k-th nearest code within which codes are ranked.
SLACK = 14
_FAR = 1 << 30


def level(x: np.ndarray, longest: float) -> np.ndarray:
    """Candidates with the component that makes every length `longest`."""
    rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]])


def rotations(sample: np.ndarray, bits: int = BITS, rounds: int = 20, seed: int = 9) -> np.ndarray:
    """A matrix whose columns are directions, `bits` of them, in groups that are rotations."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    _, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, ::-1]
    x = sample @ axes
    found = []
    while sum(f.shape[1] for f in found) < bits:
        turn, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
        for _ in range(rounds):
            corner = np.where(x @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(x.T @ corner)
            turn = u @ v
        found.append(axes @ turn)
    return np.hstack(found)[:, :bits]


def codes(x: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Packed bits, as many bytes as there are substrings."""
    return np.packbits(x @ turns >= 0, axis=1)


class Index:
    """The substring tables of a block of codes: the distinct values of each substring, and every code's."""

    def __init__(self, stored: np.ndarray):
        self.words = np.ascontiguousarray(stored).view("<u8")
        self.tables = [np.unique(column, return_inverse=True) for column in stored.T]
        self.tables = [(values, place.astype(np.intp)) for values, place in self.tables]

    def lowest(self, query: np.ndarray) -> np.ndarray:
        """For each code the distance of its nearest substring: a probe of radius s finds those with at most s."""
        low = np.full(len(self.words), SUBSTRING, dtype=np.uint8)
        for (values, place), part in zip(self.tables, query):
            np.minimum(low, np.take(np.bitwise_count(values ^ part), place), out=low)
        return low

    def within(self, query: np.ndarray, k: int, slack: int) -> np.ndarray:
        """All codes within the distance of the k-th nearest one plus `slack`."""
        low, m, n = self.lowest(query), len(self.tables), len(self.words)
        if n <= k:
            return np.arange(n)
        words = query.view("<u8")
        far = np.full(n, _FAR, dtype=np.int32)

        def probe(s):
            """Measure the codes that a probe of this radius finds and that no smaller one did."""
            at = np.flatnonzero((low <= s) & (far == _FAR))
            far[at] = np.bitwise_count((self.words if len(at) == n else self.words[at]) ^ words).sum(axis=1)

        for s in range(SUBSTRING + 1):
            probe(s)
            kth = int(np.partition(far, k - 1)[k - 1])
            if kth < m * (s + 1):  # no code that near has escaped
                break
        probe((kth + slack) // m)
        return np.flatnonzero(far <= kth + slack)


def search(rows: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
           bits: int = BITS, slack: int = SLACK, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: the k nearest found for each query, ties to the smaller id.

    Null and zero vectors and those with a null or non-finite component take no part; vectors of
    another length than the query's are no candidates.
    """
    have = vectors.usable(rows, id_col, vector_col, nonzero=True)
    some = spread_sample(have, F.col("vec_id"), train_rows, 21).collect()
    longest = have.groupBy(F.size("v").alias("dims")).agg(F.max(F.aggregate(
        "v", F.lit(0.0), lambda s, x: s + x * x)).alias("most"))
    longest = {r.dims: float(np.sqrt(r.most)) for r in longest.collect()}
    turns = {}
    for dims, most in longest.items():
        sample = np.array([r.v for r in some if len(r.v) == dims], dtype=np.float64).reshape(-1, dims)
        turns[dims] = rotations(level(sample / most, 1.0) if most > 0 else np.zeros((0, dims + 1)), bits)

    def nearest(query_ids, asked, ids, stored):
        dims = stored.shape[1]
        most, turn = longest[dims], turns[dims]
        index = Index(codes(level(stored / most, 1.0), turn))
        wanted = codes(np.hstack([asked / most, np.zeros((len(asked), 1))]), turn)
        out = []
        for query, vector, code in zip(query_ids.tolist(), asked, wanted):
            at = index.within(code, k + 1, slack)
            at = at[ids[at] != query]
            score = (stored[at] * vector).sum(axis=1)
            best = vectors.top(score, k)
            out.append((np.full(len(best), query), ids[at[best]], score[best]))
        return tuple(np.concatenate(p) for p in zip(*out))

    return vectors.search(have, queries, k, "double", nearest)
