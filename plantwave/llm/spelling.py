"""Spelling variants: words one edit apart, by search schemes over FM-indexes of the vocabulary.

A word and its near word (one code point inserted, deleted or replaced) agree on the word's first half or on
its second.  So each word is searched twice: its first half is matched exactly from the left end of a
word and the search goes on to the right with one error; its second half is matched exactly from the right
end and the search goes on to the left with one error.  Together these schemes find every near word; the
second reports only words that the first could not.

*Index.*  The words of a block stand one after another, each between delimiters.  The FM-index of that string
answers "which suffixes start with a pattern" as an interval of suffix ranks and extends a pattern by
a symbol with two rank queries.  An index extends to one side, so there are two families of blocks: one
indexes the mirrored string, in which patterns grow to the right, the other the string itself.  Half of a scheme that
starts at a delimiter needs one side only, so an interval of the other index never has to be carried.  A pattern that
is a whole word has one suffix with the delimiter next, which names the word.  All
searches of a batch advance together, symbol by symbol, in numpy.

*Blocks.*  Near words differ by at most one in length and share a half.  In each family the words are
range-partitioned by length and spelling (mirrored spelling in the second family) into blocks of about
`BLOCK` words, so words that share a half of a given length lie together, and a word is sent to those blocks
of the three lengths that its half reaches: one or two each, and more only where a block's worth of words of one length
starts with the same half.  Words that reach
one block in large numbers are split among several copies of it.

Words, runs and counts cover all texts.  Rows that share a doc_id are treated alike; a null doc_id counts as the
empty text in the deletion rule; null texts have no runs.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_batches, staged

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DELETE_ONE_IN = 199
SHORTEST = 6
LEAST_COUNT = 5
#: A form has at least this many times the occurrences of the word.
FORM_TIMES = 5
#: Words of an index, about, and words that one copy of a block is searched for at most, about.
BLOCK = 32_768
ASKING = 200_000
#: Different words a task counts before it hands them on.
COUNTED = 200_000
#: Cells of the padded words of a batch of searches.
CELLS = 400_000
#: Code points of a word that blocks compare for routing.
_EDGE = 48
_LAST = "\U0010ffff"


# --- words and their counts -----------------------------------------------------------------------------

def counted_runs(doc_id, text: str) -> Counter:
    """The runs of one text after the deletion rule, with their occurrences; a run may come out empty."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out = Counter()
    for run, n in Counter(RUN.findall(text.translate(_LOWER))).items():
        h = zlib.crc32(run.encode(), start)
        if h % DELETE_ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST_COUNT) -> DataFrame:
    """`(word, n)`: the different runs of all whole texts with their occurrences, those long and frequent enough.

    Counted per task first, so a word that stands in every text costs a row per task.
    """
    def work(batches):
        total: dict[str, int] = {}

        def handed_on():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                                              ["word", "n"])

        for batch in batches:
            for part in row_batches([batch], "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    for word, n in counted_runs(doc_id, text).items():
                        if len(word) >= shortest:
                            total[word] = total.get(word, 0) + n
                    if len(total) > COUNTED:
                        yield handed_on()
                        total.clear()
        yield handed_on()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.filter(F.col("text").isNotNull()).mapInArrow(work, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# --- the index --------------------------------------------------------------------------------------------

def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling; delimiters (symbol 0) compare by their place, so no comparison passes one."""
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    width, n = 1, len(symbols)
    while True:
        behind = np.full(n, -1, dtype=np.int64)
        behind[:n - width] = rank[width:] if width < n else []
        key = rank * (n + 2 + len(ends) + int(symbols.max()) + 1) + behind + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]).cumsum()])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


class Index:
    """FM-index of words, each between delimiters, whose patterns grow to the right.

    The string is laid out mirrored, so that the backward step of the index is a step to the right in a word.  With
    `mirrored` words the same index grows patterns to the left.
    """

    def __init__(self, words: list[str]):
        flat = "".join(words)
        lengths = np.array([len(w) for w in words])
        points = np.frombuffer(flat.encode("utf-32-le"), dtype="<u4")
        self.alphabet, symbols = np.unique(points, return_inverse=True)
        self.width = len(self.alphabet) + 1
        n = len(points) + len(words) + 1
        # delimiter, word, delimiter, word, ..., delimiter; then mirrored
        text = np.zeros(n, dtype=np.int32)
        starts = np.cumsum(lengths + 1) - lengths
        text[np.arange(len(points)) + np.repeat(np.arange(len(words)), lengths) + 1] = symbols + 1
        text = text[::-1]
        ends = np.flatnonzero(text == 0)
        order = suffix_ranks(text, ends)
        self.size = n
        before = text[order - 1]  # the symbol before each suffix, the last one's before the first
        self.before = before
        # all places of each symbol in `before`, as sorted numbers symbol * size + place: the number of those below
        # symbol * size + r is the count of smaller symbols plus the rank of the symbol at r, which a step asks for
        self.places = np.sort(before.astype(np.int64) * n + np.arange(n))
        # a suffix behind the delimiter that ends a word (mirrored) names the word
        owner = np.full(n, -1, dtype=np.int64)
        owner[n - starts - lengths] = np.arange(len(words))
        self.word_at = owner[order]

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Code points as symbols; one that no word has is -1, and so is padding."""
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where((words > 0) & (self.alphabet[at] == words), at + 1, -1).astype(np.int32)

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one more symbol on the right; empty where nothing goes on so."""
        key = np.maximum(symbol, 0).astype(np.int64) * self.size
        a = np.searchsorted(self.places, key + low)
        return a, np.where(symbol >= 0, np.searchsorted(self.places, key + high), a)

    def ended(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which intervals hold a suffix with the delimiter next, and the words those are; patterns are whole words, so one at most."""
        a, b = np.searchsorted(self.places, low), np.searchsorted(self.places, high)
        hit = b > a
        return hit, self.word_at[self.places[a[hit]]]


def _branches(index: Index, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which interval, symbol) for every symbol but the delimiter that an interval goes on with."""
    span = high - low
    wide = np.flatnonzero(span > index.width)
    few = np.flatnonzero((span > 0) & (span <= index.width))
    reps = span[few]
    which = np.repeat(few, reps)
    at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(low[few], reps)
    key = np.unique(which * index.width + index.before[at]) if len(at) else np.zeros(0, dtype=np.int64)
    some = np.repeat(wide, index.width - 1) * index.width + np.tile(np.arange(1, index.width), len(wide))
    key = np.concatenate([key, some])
    which, symbol = key // index.width, (key % index.width).astype(np.int32)
    return which[symbol > 0], symbol[symbol > 0]


def search(index: Index, words: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in `words`, place in the index) of all words that keep the first `halves` code points and differ by one edit."""
    lengths = np.array([len(w) for w in words])
    padded = np.zeros((len(words), int(lengths.max())), dtype="<u4")
    padded[np.arange(padded.shape[1])[None, :] < lengths[:, None]] = np.frombuffer(
        "".join(words).encode("utf-32-le"), dtype="<u4")
    said = index.symbols(padded)
    own = np.arange(len(words))
    low, high = np.zeros(len(words), dtype=np.int64), np.full(len(words), index.size, dtype=np.int64)
    low, high = index.step(low, high, np.zeros(len(words), dtype=np.int32))
    for k in range(int(halves.max())):
        some = (k < halves) & (high > low)
        low[some], high[some] = index.step(low[some], high[some], said[own[some], k])
    alive = high > low
    own, low, high, at = own[alive], low[alive], high[alive], halves[alive].astype(np.int64)
    out_own, out_word = [], []

    def finish(own, low, high, at):
        """Searches that have had their error: the rest exactly, then the delimiter."""
        while len(own):
            done = at == lengths[own]
            if done.any():
                hit, found = index.ended(low[done], high[done])
                out_own.append(own[done][hit])
                out_word.append(found)
            own, low, high, at = own[~done], low[~done], high[~done], at[~done]
            low, high = index.step(low, high, said[own, at])
            live = high > low
            own, low, high, at = own[live], low[live], high[live], at[live] + 1

    while len(own):
        ended = at == lengths[own]
        # one code point of the word is left out; of equal ones in a row the first
        out = ~ended
        inner = np.flatnonzero(out & (at > halves[own]))
        out[inner[said[own[inner], at[inner]] == said[own[inner], at[inner] - 1]]] = False
        finish(own[out], low[out], high[out], at[out] + 1)
        # one code point is replaced, or one comes in, behind equal ones in a row
        which, symbol = _branches(index, low, high)
        a, b = index.step(low[which], high[which], symbol)
        now = np.where(ended[which], -2, said[own[which], np.minimum(at[which], lengths[own[which]] - 1)])
        other = symbol != now
        finish(own[which][other], a[other], b[other], at[which][other])
        replaced = other & (now != -2)
        finish(own[which][replaced], a[replaced], b[replaced], at[which][replaced] + 1)
        # no error yet: on with the word's own code point
        own, low, high, at = own[~ended], low[~ended], high[~ended], at[~ended]
        low, high = index.step(low, high, said[own, at])
        live = high > low
        own, low, high, at = own[live], low[live], high[live], at[live] + 1
    if not out_own:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    pairs = np.unique(np.concatenate(out_own) * (len(index.word_at) + 1) + np.concatenate(out_word))
    return pairs // (len(index.word_at) + 1), pairs % (len(index.word_at) + 1)


def half(length: int) -> int:
    """Code points of a word's first half; the second half has the rest."""
    return length // 2


# --- Spark jobs -------------------------------------------------------------------------------------------

def _blocks(words: DataFrame, mirrored: bool, n_blocks: int) -> DataFrame:
    """`(block, spelled, n)`: words (mirrored or not) in ranges of length and spelling; one row per word."""
    spelled = F.reverse("word") if mirrored else F.col("word")
    rows = words.select(spelled.alias("spelled"), "n").repartitionByRange(n_blocks, F.length("spelled"), "spelled")
    return staged(rows.select(F.spark_partition_id().alias("block"), "spelled", "n"), "spelling-blocks")


def _edges(blocks: DataFrame) -> list[tuple]:
    """(first, last, block) of the blocks in order, each edge as (length, leading code points)."""
    place = F.struct(F.length("spelled").alias("length"), F.substring("spelled", 1, _EDGE).alias("head"))
    rows = blocks.groupBy("block").agg(F.min(place).alias("first"), F.max(place).alias("last")).collect()
    return sorted(((r["first"]["length"], r["first"]["head"]), (r["last"]["length"], r["last"]["head"]), r["block"])
                  for r in rows)


def reached(edges: list[tuple], lasts: list[tuple], spelled: str, kept: int) -> list[int]:
    """The blocks that hold words of a near length that start with the first `kept` code points."""
    head = spelled[:kept][:_EDGE]
    out = []
    for length in (len(spelled) - 1, len(spelled), len(spelled) + 1):
        top = (length, head + _LAST)
        at = bisect_left(lasts, (length, head))
        while at < len(edges) and edges[at][0] <= top:
            out.append(edges[at][2])
            at += 1
    return sorted(set(out))


def _searched(blocks: DataFrame, mirrored: bool, asking: int) -> DataFrame:
    """`(word, near, near_n)` of one family."""
    edges = _edges(blocks)
    lasts = [e[1] for e in edges]

    def route(batches):
        for batch in batches:
            spelled = batch.column("spelled").to_pylist()
            found = [reached(edges, lasts, s, len(s) - half(len(s)) if mirrored else half(len(s))) for s in spelled]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for f in found for b in f], pa.int32()),
                 pa.array([s for s, f in zip(spelled, found) for _ in f], pa.string())], ["block", "asked"])

    asked = staged(blocks.select("spelled").mapInArrow(route, "block int, asked string"), "spelling-asked")
    heavy = {r.block: -(-r.n // asking) for r in asked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > asking).collect()}
    parts = F.lit(1)
    if heavy:
        parts = F.coalesce(F.create_map(*(F.lit(x) for pair in sorted(heavy.items()) for x in pair))[F.col("block")], F.lit(1))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("asked"), parts).cast("int"))
    held = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))

    def work(queries: pa.Table, words: pa.Table) -> pa.Table:
        stored, counts = words["spelled"].to_pylist(), words["n"].to_numpy()
        out = [[], [], []]
        if queries.num_rows and stored:
            index = Index(stored)
            wanted = sorted(queries["asked"].to_pylist(), key=len)
            sizes = np.array([len(w) for w in wanted])
            at = 0
            while at < len(wanted):  # as many as fill the cells, padded to the longest of them
                end = at + max(1, int(np.searchsorted(sizes[at:] * np.arange(1, len(wanted) - at + 1), CELLS)))
                some, kept = wanted[at:end], sizes[at:end]
                kept = kept - kept // 2 if mirrored else kept // 2
                who, which = search(index, some, kept)
                for i, k in zip(who.tolist(), which.tolist()):
                    word, near = some[i], stored[k]
                    if mirrored:
                        word, near = word[::-1], near[::-1]
                        if near[:len(word) // 2] == word[:len(word) // 2]:
                            continue  # the other family has it
                    out[0].append(word)
                    out[1].append(near)
                    out[2].append(int(counts[k]))
                at = end
        return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.string()),
                         "near_n": pa.array(out[2], pa.int64())})

    return asked.groupBy("block", "part").cogroup(held.select("block", "part", "spelled", "n").groupBy(
        "block", "part")).applyInArrow(work, "word string, near string, near_n long")


def near_words(words: DataFrame, block: int = BLOCK, asking: int = ASKING) -> DataFrame:
    """`(word, near, near_n)`: every pair of words one edit apart, in both directions, each once.

    `words` has `(word, n)`, distinct words of two code points or more.
    """
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("points")).first()
    n_blocks = max(1, -(-size.n // block), -(-(size.points or 0) // (16 * block)))
    found = [_searched(_blocks(words, mirrored, n_blocks), mirrored, asking) for mirrored in (False, True)]
    return found[0].union(found[1])


def forms(words: DataFrame, near: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """`(word, n, n_near, form, form_n)` for every word; the form is its most frequent near word, if frequent enough."""
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    rows = words.join(best, "word", "left")
    enough = -F.col("best.less") >= F.lit(times) * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                       F.when(enough, F.col("best.near")).alias("form"),
                       F.when(enough, -F.col("best.less")).alias("form_n"))


def roots(linked: DataFrame) -> DataFrame:
    """`(word, root)` for the words with a form: the last word of the chain of forms.

    Jumps double in each round.  Counts grow along a chain, so it has no cycle, and by a factor, so few rounds do.
    """
    jumps = staged(linked.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = staged(jumps.join(further, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        jumps = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return jumps


def spelling_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """`(word, form, root, n, n_near, form_n)`: one row per word of the vocabulary.

    `root` is the word itself where it has no form.  An empty table gives an empty table.
    """
    words = staged(vocabulary(docs), "spelling-words")
    linked = staged(forms(words, near_words(words, block)), "spelling-forms")
    return linked.join(roots(linked), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
