"""What both vector searches share: usable rows, and query blocks against candidate blocks.

A stated set of queries meets all candidates.  Both are dealt into blocks of bounded size by a hash of
the id, each pair of blocks is one group, and a group gives the best of its candidates for each of its
queries.  So a task's memory does not follow the table, equal or popular vectors spread like others, and
what is merged are results, never pairs of vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a candidate block and of a query block, about.
CANDIDATES = 8_192
QUERIES = 2_048


def usable(rows: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """`(vec_id, v)`, v as array<double>: rows with an id, no null or non-finite component, and a length.

    With `nonzero`, vectors of zeros only are left out too.  Of rows that share an id the one with the
    smallest vector counts.
    """
    v = F.col("v")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonzero:
        fine = fine & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrices(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) for each length of vector, by ascending id."""
    rows = rows.sort_by("vec_id").combine_chunks()
    ids = rows["vec_id"].to_numpy()
    lists = rows["v"].combine_chunks() if isinstance(rows["v"], pa.ChunkedArray) else rows["v"]
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    out = {}
    for dims in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dims)
        out[dims] = ids[at], flat[starts[at][:, None] + np.arange(dims)]
    return out


def search(vectors: DataFrame, queries: Column, k: int, score_type: str,
           nearest: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple],
           candidates: int = CANDIDATES, asking: int = QUERIES) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: the k best of all other vectors for each row where `queries` holds.

    `nearest(query_ids, queries, ids, vectors)` gives arrays (query_id, vec_id, score) with the best k of a
    block of candidates for each query, without the query itself; all of one length, ids ascending.
    """
    sizes = vectors.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(queries, 1)).alias("q")).first()
    n_blocks, q_blocks = (max(1, -(-n // size)) for n, size in ((sizes.n, candidates), (sizes.q, asking)))
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.filter(queries).withColumn("i", block(q_blocks, 1)).withColumn("j", each(n_blocks))
    right = vectors.withColumn("j", block(n_blocks, 2)).withColumn("i", each(q_blocks))
    names = ["i", "j", "vec_id", "v"]

    def work(asked: pa.Table, stored: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and stored.num_rows:
            have = matrices(stored.select(["vec_id", "v"]))
            for dims, (ids, rows) in matrices(asked.select(["vec_id", "v"])).items():
                if dims in have:
                    found.append(nearest(ids, rows, *have[dims]))
        kind = pa.int64() if score_type == "long" else pa.float64()
        parts = [np.concatenate(p) for p in zip(*found)] if found else [[], [], []]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()),
                         "score": pa.array(parts[2], kind)})

    found = left.select(*names).toDF(*names).groupBy("i", "j").cogroup(
        right.select(*names).groupBy("i", "j")).applyInArrow(work, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the earlier place, best first."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = np.flatnonzero(scores > edge)
        at = np.concatenate([over, np.flatnonzero(scores == edge)[:k - len(over)]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, -scores[at]))]
