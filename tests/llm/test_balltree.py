"""Ranked lexical search by ball trees against a plain scorer and SQL."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwave.llm import balltree, queries

from .test_texts import SF, documents, empty_docs, odd_docs


def terms(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if run:
                out.append(run)
            run = ""
        else:
            run += c.lower() if c.isascii() else c
    return out


def brute(docs, items, k=20):
    """{item_id: [(doc_id, score)]} of all documents, one by one."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = {}
    for item, text in items:
        asked = Counter(terms(text))
        scores = []
        for i, c in counted:
            m = 75 + (25 * sum(c.values()) * n_docs) // words
            s = sum(r * math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, r in asked.items() if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out[item] = [(i, -s) for s, i in sorted(scores)[:k]]
    return {i: v for i, v in out.items() if v}


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.item_id, r.rank)):
        assert r.rank == len(out[r.item_id]) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return dict(out)


def benchmark(spark, sf=SF):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def test_query_equals_brute_force(spark):
    got = found(queries.QUERIES["op12_ball_tree_search"](spark, SF))
    assert got == brute([(r.doc_id, r.text) for r in documents(spark).collect()],
                        [(r.item_id, r.text) for r in benchmark(spark).collect()])


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.01/{name}.parquet'")
    want = sorted(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({balltree.SQL})").fetchall())
    got = queries.QUERIES["op12_ball_tree_search"](spark, "/root/testdata/sf0.01")
    assert sorted(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == want


@pytest.mark.parametrize("documents_, asking", [(16, 3), (1000, 1)])
def test_blocks_change_nothing(spark, documents_, asking):
    docs, items = documents(spark), benchmark(spark).limit(10)
    few = found(balltree.search(docs, items, 7, documents=documents_, asking=asking))
    assert few == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 7)


def random_rows(rng, n, dims, groups):
    """Rows in groups of near copies, as sparse rows and as a matrix."""
    dense = np.zeros((n, dims), dtype=np.int64)
    base = [rng.sample(range(dims), 12) for _ in range(groups)]
    for row in dense:
        for c in rng.choice(base):
            row[c] = rng.choice([1, 2, 3]) * 1000 + rng.randrange(5)
    starts = np.concatenate([[0], np.cumsum((dense > 0).sum(axis=1))])
    columns = np.concatenate([np.flatnonzero(r) for r in dense])
    return balltree.Rows(starts, columns, dense[dense > 0]), dense


@pytest.mark.parametrize("power", [0, 0.5, 1])
def test_tree_finds_the_best_and_opens_few_leaves(power):
    rng = random.Random(3)
    rows, dense = random_rows(rng, 1500, 300, 60)
    weights = np.array([rng.randrange(0, 9000) for _ in range(300)])
    scale = weights.astype(float) ** power
    tree, share = balltree.BallTree(rows, scale), []
    for _ in range(30):
        item = np.zeros(300, dtype=np.int64)
        item[rng.sample(range(300), 15)] = 1
        item *= weights
        opened = []
        at, scores = tree.search(item, scale, 10, opened)
        every = dense @ item
        want = [i for i in np.lexsort((np.arange(len(every)), -every)) if every[i] > 0][:10]
        assert at.tolist() == want and scores.tolist() == every[want].tolist()
        share.append(sum(b - a for a, b in opened) / len(dense))
    assert np.mean(share) < 0.5


def test_no_document_beats_its_ball():
    """Bounds hold for every document below a node, also for items made to meet them."""
    rng = random.Random(8)
    rows, dense = random_rows(rng, 400, 80, 10)
    scale = np.array([rng.uniform(0.1, 50) for _ in range(80)])
    tree = balltree.BallTree(rows, scale, 4)
    for node, (start, end) in enumerate(tree.spans):
        columns, values = tree.centroids[node]
        middle = np.zeros(80)
        middle[columns] = values
        below = dense[tree.order[start:end]] * scale
        assert (np.sqrt(((below - middle) ** 2).sum(axis=1)) <= tree.radii[node]).all()
        assert (below[:, columns] <= (values + tree.reaches[node]) * (1 + 1e-12)).all()


def test_real_blocks_are_pruned(spark):
    """On the given documents a search scores well under half of a block."""
    docs = [(r.doc_id, Counter(terms(r.text))) for r in documents(spark, "/root/testdata/sf0.1").limit(4000).collect()]
    items = [Counter(terms(r.text)) for r in benchmark(spark, "/root/testdata/sf0.1").limit(40).collect()]
    import pyarrow as pa
    known = sorted(set().union(*items))
    place = {t: i for i, t in enumerate(known)}
    n_docs, words = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    kept = [[t for t in c if t in place] for _, c in docs]
    have = pa.table({"id": [i for i, _ in docs], "n": [sum(c.values()) for _, c in docs], "terms": kept,
                     "times": [[c[t] for t in k] for k, (_, c) in zip(kept, docs)]})
    _, rows = balltree.block_rows(have, pa.array(known), n_docs, words)
    weights = np.array([int(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) for t in known])
    tree, opened = balltree.BallTree(rows, weights.astype(float)), []
    for c in items:
        item = np.zeros(len(known), dtype=np.int64)
        for t, r in c.items():
            item[place[t]] = r * weights[place[t]]
        tree.search(item, weights.astype(float), 20, opened)
    assert sum(b - a for a, b in opened) < 0.45 * len(items) * n_docs


def test_odd_rows_ties_and_repeats(spark):
    docs = odd_docs(spark).union(spark.createDataFrame(
        [(i, "Tie tie TIE word", None, None, None) for i in (70, 60, 60, 50)] + [(80, "x" * 200_000 + " tie", None, None, None)],
        odd_docs(spark).schema))
    docs = docs.withColumn("score", F.lit("mine")).withColumn("rank", F.lit("mine")).withColumn("id", F.lit("mine"))
    items = spark.createDataFrame([(1, "tie a b a"), (1, "zzz"), (2, None), (3, ""), (4, "nowhere"), (None, "tie"), (5, "日本 don't é_é")],
                                  "item_id long, text string").withColumn("terms", F.lit("mine"))
    got = found(balltree.search(docs, items))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == brute(rows, [(1, "tie a b a"), (4, "nowhere"), (5, "日本 don't é_é")])
    assert [i for i, _ in got[1] if i in (50, 60, 70)] == [50, 60, 60, 70]
    assert balltree.search(empty_docs(spark), items).count() == 0
    assert balltree.search(docs, items.limit(0)).count() == 0
