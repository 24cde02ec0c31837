"""Spelling variants by search schemes over FM-indexes against plain comparisons."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwave.llm import queries, spelling

from .test_texts import SF, documents, empty_docs, odd_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(word):
    """Keys under which words one edit apart meet: the word, and the word without one code point."""
    return {word[:i] + word[i + 1:] for i in range(len(word))} | {word}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_pairs(words):
    meet = defaultdict(set)
    for w in words:
        for k in edits(w):
            meet[k].add(w)
    return {(a, b) for group in meet.values() for a in group for b in group if one_edit(a, b)}


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + "\n":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                run = run.translate(LOWER)
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 199 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                counts[run] += 1
            run = ""
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = defaultdict(list)
    for a, b in brute_pairs(n):
        near[a].append(b)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v))
        if n[best] >= 5 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def rows_of(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_suffix_ranks_and_steps():
    words = ["banana", "bananas", "ananas", "band"]
    index = spelling.Index(words)
    code = {chr(c): i + 1 for i, c in enumerate(index.alphabet)}
    for pattern, want in (("ban", 3), ("banana", 2), ("anan", 1), ("nan", 0), ("bananas", 1)):
        low, high = index.step(np.array([0]), np.array([index.size]), np.array([0]))
        for c in pattern:
            low, high = index.step(low, high, np.array([code[c]]))
        assert int(high[0] - low[0]) == want, pattern
        hit, found = index.ended(low, high)
        assert [words[i] for i in found] == [w for w in words if w == pattern and hit.all()]


@pytest.mark.parametrize("letters, size", [("ab", 14), ("abcé日", 8), ("a", 40)])
def test_search_finds_every_near_word(letters, size):
    rng = random.Random(size)
    words = sorted({"".join(rng.choices(letters, k=rng.randrange(2, size))) for _ in range(700)})
    want = brute_pairs(words)
    got = set()
    for mirrored in (False, True):
        side = [w[::-1] if mirrored else w for w in words]
        kept = np.array([len(w) - len(w) // 2 if mirrored else len(w) // 2 for w in side])
        who, which = spelling.search(spelling.Index(side), side, kept)
        assert len(set(zip(who.tolist(), which.tolist()))) == len(who)
        got |= {(words[i], words[k]) for i, k in zip(who.tolist(), which.tolist())}
    assert got == want


@pytest.mark.parametrize("block, asking", [(32_768, 200_000), (40, 60)])
def test_blocks_lose_and_repeat_no_pair(spark, block, asking):
    rng = random.Random(7)
    words = {"und" + "".join(rng.choices("abcü", k=rng.randrange(3, 7))) for _ in range(500)}
    words |= {"".join(rng.choices("abé", k=rng.randrange(6, 9))) for _ in range(300)} | {"z" * 300, "z" * 301, "q" * 60 + "a"}
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    rows = spelling.near_words(df, block, asking).collect()
    assert len(rows) == len({(r.word, r.near) for r in rows})
    assert {(r.word, r.near) for r in rows} == brute_pairs(words)
    assert all(r.near_n == len(r.near) for r in rows)


def test_a_word_goes_to_few_blocks(spark):
    """The words sent to blocks grow with the vocabulary, not with its square."""
    rng = random.Random(1)
    words = {"".join(rng.choices("abcdefghijklmnop", k=rng.randrange(6, 12))) for _ in range(4000)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    edges = spelling._edges(spelling._blocks(df, False, 40))
    lasts = [e[1] for e in edges]
    sent = [len(spelling.reached(edges, lasts, w, len(w) // 2)) for w in words]
    assert len(edges) == 40 and sum(sent) / len(sent) < 4


def test_query_equals_brute_force(spark):
    got = rows_of(queries.QUERIES["op13_spelling_groups"](spark, SF))
    want = brute([(r.doc_id, r.text) for r in documents(spark).collect()])
    assert got == want and len(got) > 100 and any(v[0] for v in got.values())


def test_chains_of_forms(spark):
    counts = [("aaaaaaaa", 3125), ("aaaaaaab", 625), ("aaaaaabb", 125), ("aaaaabbb", 25), ("aaaabbbb", 5), ("zzzzzzz", 9)]
    words = spark.createDataFrame(counts, "word string, n long")
    linked = spelling.forms(words, spelling.near_words(words))
    got = {r.word: r.root for r in spelling.roots(linked).collect()}
    assert got == {w: "aaaaaaaa" for w, _ in counts[1:5]}


def test_ties_repeated_rows_and_odd_texts(spark):
    rows = [(1, " ".join(["Colour Color"] * 6 + ["COLOUR"] * 3), "x"), (1, " ".join(["Colour Color"] * 6), "x"), (2, None, "x"),
            (3, "", "x"), (None, "colors colors×colors colors÷ colors colour" * 3, "x"), (4, "ÀÉÎÕÜÿ " * 7 + "ÀÉÎÕÜ " * 5, "x"),
            (5, "y" * 5000 + " " + "word-less1word " * 20 + "y" * 5000, "x")] + [(9, "y" * 5000, None)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = rows_of(spelling.spelling_groups(df.withColumn("n", F.lit(1)).withColumn("near", F.lit(1))))
    assert got == brute([("" if i is None else i, t) for i, t, _ in rows])
    assert "y" * 5000 in got
    assert rows_of(spelling.spelling_groups(odd_docs(spark))) == brute(
        [("" if r.doc_id is None else r.doc_id, r.text) for r in odd_docs(spark).collect()])
    assert spelling.spelling_groups(empty_docs(spark)).count() == 0
