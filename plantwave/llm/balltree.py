"""Ranked lexical search: exact largest inner products of sparse vectors, by ball trees.

A document is the sparse vector of its term weights, an item that of its terms' weights times repeats, and the score
their inner product, in 64-bit integers.  Only terms of items can add to a score, so document vectors hold those.

*Statistics* (number of documents with a term, their length, how many hold a term) cover all documents.  Texts
are read once: a row per document with its length and those terms that may belong to an item (a bitmap of hashes
of a fixed size decides that, the join with the items' terms is exact) is staged and used for everything else.

*Trees.*  Documents are dealt into blocks by a hash of a row number, so a task's memory does not follow the table.
Each block becomes a ball tree: a node has a centroid and a radius that no document below it exceeds, and is
cut at the median of the projection on the line between two documents far from each other.  Coordinates are
scaled by the terms' weights, so that the radius is short in directions that matter little.  No document under a node can
score more than ``<item, centroid> + |item| * radius``.  Sparse documents lie almost at right angles, where that
bound alone excludes next to nothing, so a node also has its radius along each axis, how far any document below it goes
beyond the centroid there, and the smaller of ``|item| * radius`` and ``<item, radii>`` counts.  Bounds are computed in
doubles and rounded up by more than the error of the sums can be, so pruning never loses a document.

*Search.*  For each item the node of the highest bound is opened first.  Leaves are scored exactly, in integers.
A node is dropped when its bound is below the k-th best score of the block so far (at equality it stays, as ties
go to the smaller id).  The bests of all blocks are merged by rank.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_batches, staged

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCALE = 1_000_000_000
#: Documents of a block and items of a block, about, and documents of a leaf at most.
DOCUMENTS = 8_192
ITEMS = 2_048
LEAF = 16
#: Slots of the bitmap of term hashes.
SLOTS = 1 << 20
#: Rounding: relative slack of a squared distance, and of a bound.  Sums of up to 10^5 terms err by less than a hundredth of it.
_SQUARE_SLACK = 1e-9
_BOUND_SLACK = 1e-9


# --- terms ------------------------------------------------------------------------------------------------

def counted_terms(text: str | None) -> Counter:
    """The terms of a whole text with their occurrences."""
    return Counter(TERM.findall(text.translate(_LOWER))) if text else Counter()


def _slot(term: str) -> int:
    return zlib.crc32(term.encode()) & (SLOTS - 1)


def _term_lists(rows: DataFrame, id_col: str, text_col: str, bitmap: bytes | None) -> DataFrame:
    """`(id, n, terms, times)` for every row: n counts all terms; with a bitmap the lists hold only terms it has."""
    def work(batches):
        verdict: dict[str, bool] = {}
        for batch in row_batches(batches, "text"):
            totals, terms, times, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                found = counted_terms(text)
                totals.append(sum(found.values()))
                for term, n in found.items():
                    if bitmap is not None:
                        kept = verdict.get(term)
                        if kept is None:
                            if len(verdict) > 100_000:
                                verdict.clear()
                            slot = _slot(term)
                            kept = verdict[term] = bool(bitmap[slot >> 3] >> (slot & 7) & 1)
                        if not kept:
                            continue
                    terms.append(term)
                    times.append(n)
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(totals, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(terms, pa.string())),
                 pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))], ["id", "n", "terms", "times"])

    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "id long, n long, terms array<string>, times array<long>")


def _exploded(lists: DataFrame, *columns: str) -> DataFrame:
    return lists.select(*columns, F.explode(F.arrays_zip("terms", "times")).alias("at")).select(
        *columns, F.col("at.terms").alias("term"), F.col("at.times").alias("times"))


# --- the tree -----------------------------------------------------------------------------------------------

@dataclass
class Rows:
    """Sparse rows: `starts` has one entry more than there are rows."""
    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.starts[rows + 1] - self.starts[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(starts[-1]) - np.repeat(starts[:-1] - self.starts[rows], sizes)
        return Rows(starts, self.columns[at], self.values[at])

    def times(self, dense: np.ndarray) -> np.ndarray:
        """Inner products of all rows with one dense vector, in the type of the values and the vector."""
        product = self.values * dense[self.columns]
        if product.dtype.kind == "i":  # differences of running sums are exact
            total = np.concatenate([[0], np.cumsum(product)])
            return total[self.starts[1:]] - total[self.starts[:-1]]
        return np.bincount(np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), product, len(self.starts) - 1)


class BallTree:
    """A tree over sparse non-negative integer rows; `scale` stretches each column for distances."""

    def __init__(self, rows: Rows, scale: np.ndarray, leaf: int = LEAF):
        self.centroids: list[tuple[np.ndarray, np.ndarray]] = []
        self.radii: list[float] = []
        self.reaches: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        self.dims, self.leaf = len(scale), leaf
        self.order = np.arange(len(rows.starts) - 1)
        stretched = Rows(rows.starts, rows.columns, rows.values * scale[rows.columns])
        row = np.repeat(np.arange(len(self.order)), np.diff(rows.starts))
        self.squares = np.bincount(row, stretched.values**2, len(self.order))
        self._node(stretched, 0, len(self.order))
        self.rows = rows.take(self.order)

    def _node(self, stretched: Rows, start: int, end: int) -> int:
        me = len(self.radii)
        here = self.order[start:end]
        part = stretched.take(here)
        middle = np.bincount(part.columns, part.values, self.dims) / len(here)
        some = np.flatnonzero(middle)
        square = float(middle @ middle)
        squares = self.squares[here]
        far = squares - 2 * part.times(middle) + square
        slack = _SQUARE_SLACK * (float(squares.max()) + square)
        highest = np.zeros(self.dims)
        np.maximum.at(highest, part.columns, part.values)
        self.centroids.append((some, middle[some]))
        self.reaches.append(np.maximum(highest[some] - middle[some], 0))
        self.radii.append(float(np.sqrt(max(float(far.max()), 0.0) + slack)) * (1 + _BOUND_SLACK))
        self.spans.append((start, end))
        self.children.append(None)
        if end - start > self.leaf:
            one = self._dense(part, int(far.argmax()))
            away = squares - 2 * part.times(one)
            other = self._dense(part, int(away.argmax()))
            side = np.argsort(part.times(one - other), kind="stable")
            self.order[start:end] = here[side]
            cut = (start + end) // 2
            self.children[me] = (self._node(stretched, start, cut), self._node(stretched, cut, end))
        return me

    def _dense(self, part: Rows, row: int) -> np.ndarray:
        out = np.zeros(self.dims)
        a, b = part.starts[row], part.starts[row + 1]
        out[part.columns[a:b]] = part.values[a:b]
        return out

    def search(self, item: np.ndarray, scale: np.ndarray, k: int, opened: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of the k best rows with a score above 0, best first, ties to the earlier row.

        `item` has integer weights by column; `opened` takes the spans of the leaves that were scored.
        """
        shrunk = item / np.where(scale > 0, scale, 1.0)
        length = float(np.sqrt(shrunk @ shrunk))

        def bound(node):
            columns, values = self.centroids[node]
            wanted = shrunk[columns]
            rest = min(length * self.radii[node], float(self.reaches[node] @ wanted))
            return (float(values @ wanted) + rest) * (1 + _BOUND_SLACK) + 1

        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        heap = [(-bound(0), 0)] if len(self.order) else []
        least = 1
        while heap:
            high, node = heapq.heappop(heap)
            if -high < least:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    best = bound(child)
                    if best >= least:
                        heapq.heappush(heap, (-best, child))
                continue
            start, end = self.spans[node]
            if opened is not None:
                opened.append((start, end))
            a, b = self.rows.starts[start], self.rows.starts[end]
            got = Rows(self.rows.starts[start:end + 1] - a, self.rows.columns[a:b], self.rows.values[a:b]).times(item)
            good = got >= least
            if good.any():
                rows = np.concatenate([rows, self.order[start:end][good]])
                scores = np.concatenate([scores, got[good]])
                keep = np.lexsort((rows, -scores))[:k]
                rows, scores = rows[keep], scores[keep]
                if len(rows) == k:
                    least = int(scores[-1])
        return rows, scores


# --- Spark jobs -------------------------------------------------------------------------------------------

def _one_text(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Items with an id; of rows that share one, the smallest text counts."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))


def _bitmap(terms: DataFrame) -> bytes:
    """A bit for each hash slot of the terms: at most `SLOTS` numbers reach the driver, whatever their number."""
    slots = terms.select(F.expr(f"crc32(cast(term AS binary)) & {SLOTS - 1}").alias("slot")).distinct().collect()
    bits = np.zeros(SLOTS, dtype=bool)
    bits[[r.slot for r in slots]] = True
    return np.packbits(bits, bitorder="little").tobytes()


def search(docs: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", id_col: str = "doc_id",
           text_col: str = "text", documents: int = DOCUMENTS, asking: int = ITEMS) -> DataFrame:
    """`(item_id, rank, doc_id, score)`: the k documents of the highest scores above 0 for each item, ties to the smaller id.

    Every row of `docs` is a document, also where rows share an id, and counts in the statistics; one with a null id
    cannot be named and is not ranked.  Null and empty texts have no terms.  An item without terms, or none of whose
    terms stands in a document, has no rows; so have all items when there are no documents.
    """
    asked = staged(_exploded(_term_lists(_one_text(items, item_col, text_col), "item_id", "text", None), "id"), "ball-items")
    terms = asked.select("term").distinct()
    lists = staged(_term_lists(docs, id_col, text_col, _bitmap(terms)).filter(F.col("n") > 0).withColumn(
        "row", F.monotonically_increasing_id()), "ball-documents")
    size = lists.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("words")).first()
    df = lists.select(F.explode("terms").alias("term")).join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * size.n + 2) / (2 * F.col("df") + 1))).cast("long")
    queries = asked.join(df.select("term", weight.alias("w")), "term").groupBy("id").agg(
        F.collect_list(F.struct("term", "times", "w")).alias("entries"))
    queries = staged(queries, "ball-queries")

    n_blocks, q_blocks = (max(1, -(-n // most)) for n, most in ((size.n, documents), (queries.count(), asking)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("i", block("id", q_blocks)).withColumn("j", each(n_blocks)).select("i", "j", "id", "entries")
    right = lists.filter(F.col("id").isNotNull() & (F.size("terms") > 0)).withColumn("j", block("row", n_blocks)).withColumn(
        "i", each(q_blocks)).select("i", "j", "id", "n", "terms", "times")
    n_docs, n_words = size.n, size.words

    def work(wanted: pa.Table, have: pa.Table) -> pa.Table:
        found = _best(wanted, have, n_docs, n_words, k) if wanted.num_rows and have.num_rows else [[], [], []]
        return pa.table({name: pa.array(part, pa.int64()) for name, part in zip(("item_id", "doc_id", "score"), found)})

    best = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(
        work, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")


def _list_column(table: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """(ends with a 0 in front, flat values) of a list column."""
    column = table[name].combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]), column.flatten()


def block_rows(have: pa.Table, known: pa.Array, n_docs: int, n_words: int) -> tuple[np.ndarray, Rows]:
    """(ids, rows) of one block's documents by ascending id; the columns are the places of terms in `known`."""
    have = have.sort_by("id").combine_chunks()
    ends, flat = _list_column(have, "terms")
    times = _list_column(have, "times")[1].to_numpy()
    column = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy()
    row = np.repeat(np.arange(have.num_rows), np.diff(ends))
    inside = column >= 0
    row, column, times = row[inside], column[inside].astype(np.int64), times[inside]
    m = 75 + (25 * have["n"].to_numpy() * n_docs) // n_words
    values = (SCALE * times) // (1000 * times + 12 * m[row])
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=have.num_rows))])
    return have["id"].to_numpy(), Rows(starts, column, values)


def _best(wanted: pa.Table, have: pa.Table, n_docs: int, n_words: int, k: int) -> list[np.ndarray]:
    """(item_id, doc_id, score) of one block of items over one block of documents."""
    ends, entries = _list_column(wanted, "entries")
    known = pc.unique(entries.field("term"))
    place = pc.index_in(entries.field("term"), value_set=known).to_numpy()
    repeats, weight = entries.field("times").to_numpy(), entries.field("w").to_numpy()
    weights = np.zeros(len(known))
    weights[place] = weight
    ids, rows = block_rows(have, known, n_docs, n_words)
    tree = BallTree(rows, weights)
    out = [], [], []
    for item, a, b in zip(wanted["id"].to_pylist(), ends, ends[1:]):
        asked = np.zeros(len(known), dtype=np.int64)
        asked[place[a:b]] = repeats[a:b] * weight[a:b]
        at, scores = tree.search(asked, weights, k)
        out[0].append(np.full(len(at), item))
        out[1].append(ids[at])
        out[2].append(scores)
    return [np.concatenate(part) for part in out]


SQL = r"""WITH tokens AS (
  SELECT doc_id, row_number() OVER () AS row, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT doc_id, text FROM documents)),
lengths AS (SELECT row, doc_id, count(*) AS n FROM tokens GROUP BY row, doc_id),
sizes AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
times AS (SELECT row, term, count(*) AS tf FROM tokens GROUP BY row, term),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM times, sizes GROUP BY term, docs),
asked AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)) GROUP BY item_id, term),
scored AS (SELECT item_id, row, doc_id,
    sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN times USING (term) JOIN lengths USING (row), sizes GROUP BY item_id, row, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place
  FROM scored WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM placed WHERE place <= 20"""
