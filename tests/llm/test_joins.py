"""Jaccard join, vector searches and the pipeline against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plantwave.llm import jaccard, langid, mih, pieces, quality, queries, shingles, topk, vectors
from plantwave.llm.common import crc_mod, staged

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- shingles -------------------------------------------------------------------------------------------

def test_shingle_sets_equal_plain_ones(monkeypatch):
    texts = ["", "a", " a B\tc", "a b c d", "a b c d e", "A B C D E F", "x y z " * 50, "日本 語\x0b x\x1cy ñ", None,
             "one two three four five six seven " * 20, "w" * 300 + " b c d e f", "A B C D E f\n"]
    for block in (1 << 20, 64):
        monkeypatch.setattr(shingles, "_BLOCK", block)
        got = shingles.sets_of_column(pa.array(texts, pa.string()))
        want = [brute.shingles(t) for t in texts]
        assert [len(g) for g in got] == [len(w) for w in want]
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert len(set(got[i].tolist()) & set(got[j].tolist())) == len(want[i] & want[j])


# --- Jaccard join -----------------------------------------------------------------------------------------

def corpus(seed, docs=150):
    """Clusters of edited copies, chains of edits, exact copies, a shared passage, short texts and loners."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(2, 5)))
    passage = [word() for _ in range(40)]
    rows, bases = [], [[word() for _ in range(r.randint(20, 90))] for _ in range(12)]
    for i in range(docs):
        kind = r.random()
        if kind < 0.55:
            b = list(r.choice(bases[:4]))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                b[r.randrange(len(b))] = word()
            if r.random() < 0.1:
                bases.append(b)  # chains
        elif kind < 0.7:
            b = passage + [word() for _ in range(r.randint(1, 30))]
        elif kind < 0.8:
            b = [r.choice("ab") for _ in range(r.randint(0, 6))]
        else:
            b = [word() for _ in range(r.randint(5, 60))]
        rows.append((i, " ".join(b)))
    return rows


@pytest.mark.parametrize("rows,pivots,copies", [(300, 32, 3), (4, 3, 99), (4, 3, 0)])
def test_classes_equal_all_pairs(spark, monkeypatch, rows, pivots, copies):
    """Small regions, regions split into Voronoi cells, and regions joined in blocks."""
    monkeypatch.setattr(jaccard, "REGION_ROWS", rows)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "MOST_COPIES", copies)
    monkeypatch.setattr(jaccard, "LEVELS", 2 if copies else 1)
    data = corpus(rows + copies, 150 if rows > 100 else 60)
    got = jaccard.jaccard_classes(spark.createDataFrame(data, "doc_id long, text string").repartition(5), sketch_bits=8)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.classes(data)


def test_region_join_equals_all_pairs():
    for seed in range(6):
        sets = [s for s in shingles.sets_of_column(pa.array([t for _, t in corpus(seed, 80)])) if len(s)]
        found = jaccard.Classes(len(sets))
        for i, j in jaccard.join_region(sets):
            found.join(i, j)
        want = jaccard.Classes(len(sets))
        for i, a in enumerate(sets):
            for j in range(i):
                n = len(np.intersect1d(a, sets[j]))
                if 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                    want.join(i, j)
        assert (found.roots() == want.roots()).all()


def test_components_of_long_chains(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = jaccard.components(spark.createDataFrame(edges, "a long, b long"))
    labels = {r.x: r.component for r in got.collect()}
    assert len(labels) == n + 3 and {labels[i] for i in range(n + 1)} == {0} and labels[1001] == 1000
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text), (5, text), (3, text + " x"), (9, None), (8, ""), (7, " \n"), (None, text), (6, "one"), (2, "one"),
            (5, "something else altogether in this row here"), (1, "something else altogether in this row here")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("region", F.lit(2))
    got = [(r.doc_id, r.component_id, r.n_shingles) for r in jaccard.jaccard_classes(d).collect()]
    assert len(got) == len(rows)
    assert {g[:2] for g in got} == {(5, 1), (3, 1), (9, 9), (8, 8), (7, 7), (None, None), (6, 2), (2, 2), (1, 1)}
    kept = jaccard.one_per_class(d, jaccard.jaccard_classes(d))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 7, 8, 9] and kept.columns == d.columns
    assert jaccard.jaccard_classes(d.limit(0)).count() == 0


# --- vector searches --------------------------------------------------------------------------------------

def plain_search(rows, every, k, score):
    """All pairs, in plain Python order."""
    out = []
    for q, a in rows.items():
        if q % every:
            continue
        found = sorted(((-score(a, b), i) for i, b in rows.items() if i != q and len(a) == len(b)))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def vector_rows(seed, n=230):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 9))
    rows = [(i, (base[i % 6] + rng.normal(size=9) * (i % 4) / 5).tolist()) for i in range(n)]
    rows += [(n + i, rows[20][1]) for i in range(40)]  # copies
    rows += [(900, None), (901, [float("nan")] * 9), (902, [None] * 9), (903, [0.0] * 9), (904, [float("inf")] * 9),
             (905, []), (906, [1.0, 2.0]), (940, [2.0, 1.0]), (None, [1.0] * 9), (0, rows[0][1])]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))


@pytest.mark.parametrize("block", [8192, 50])
def test_exact_search_equals_all_pairs(spark, monkeypatch, block):
    rows = vector_rows(1)
    have = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    monkeypatch.setattr(vectors.search, "__defaults__", (block, 2 if block < 100 else 2048))
    got = topk.search(vector_frame(spark, rows), F.col("vec_id") % 20 == 0, 10)
    assert sorted(map(tuple, got.collect())) == plain_search(have, 20, 10, lambda a, b: sum(x * y for x, y in zip(a, b)))


def test_term_at_a_time_with_sparse_and_wide_weights():
    rng = np.random.default_rng(2)
    stored = rng.integers(-9, 9, (50, 7)) * (rng.random((50, 7)) < 0.3)
    asked = rng.integers(-9, 9, (6, 7)) * (rng.random((6, 7)) < 0.5)
    assert (topk.accumulate(asked, topk.postings(stored), 50) == asked @ stored.T).all()
    wide = topk.weights(np.array([[1e19, 1.5]]))
    assert wide.dtype == object and wide[0, 0] == int(np.floor(1024 * 1e19))


def test_search_in_empty_tables(spark):
    none = vector_frame(spark, [])
    assert topk.search(none, F.col("vec_id") % 20 == 0, 10).count() == 0
    assert mih.search(none, F.col("vec_id") % 20 == 0, 10).count() == 0
    one = vector_frame(spark, [(0, [1.0, 2.0])])
    assert topk.search(one, F.col("vec_id") % 20 == 0, 10).count() == 0
    assert mih.search(one, F.col("vec_id") % 20 == 0, 10).count() == 0


def test_top_takes_ties_by_place():
    assert vectors.top(np.array([1, 3, 3, 2, 3]), 2).tolist() == [1, 2]
    assert vectors.top(np.array([1, 2]), 5).tolist() == [1, 0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_multi_index_hashing(spark, sf):
    path = f"/root/testdata/{sf}"
    got = queries.QUERIES["op7_multi_index_hashing"](spark, path).toPandas()
    table = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    v, ids = np.stack(table.embedding).astype(np.float64), table.vec_id.to_numpy()
    asked = ids % 20 == 0
    assert (got.groupby("query_id").size() == 20).all() and set(got.query_id) == set(ids[asked])
    hits = 0
    for q in ids[asked]:
        scores = (v * v[ids == q][0]).sum(axis=1)
        scores[ids == q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert np.allclose(mine.score, [scores[ids == i][0] for i in mine.vec_id], atol=1e-12)
        assert (np.diff(mine.score) <= 0).all()
        hits += len(set(ids[np.argsort(-scores, kind="stable")[:20]]) & set(mine.vec_id))
    assert hits >= 0.9 * 20 * asked.sum()


def test_lengths_do_not_mislead_the_index(spark):
    """Largest inner product, not smallest angle: long vectors win."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) * (1 + 9 * (i % 7 == 0))).tolist()) for i in range(400)]
    got = mih.search(vector_frame(spark, rows), F.col("vec_id") % 40 == 0, 5).collect()
    want = plain_search(dict(rows), 40, 5, lambda a, b: float((np.array(a) * np.array(b)).sum()))
    assert len(set((r[0], r[2]) for r in got) & set((r[0], r[2]) for r in want)) >= 0.9 * len(want)


def test_probes_find_every_code_within_the_radius():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 256, (300, 32), dtype=np.uint8)
    codes[:40] = codes[0]
    codes[5:40, 3] ^= 1 << rng.integers(0, 8, 35).astype(np.uint8)
    index = mih.Index(codes)
    for q in (codes[0], codes[200]):
        far = np.unpackbits(codes ^ q, axis=1).sum(axis=1)
        radius = np.sort(far)[9] + 6
        assert (index.within(q, 10, 6) == np.flatnonzero(far <= radius)).all()


# --- pipeline ----------------------------------------------------------------------------------------------

def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, seen, SF), "test-" + name)
        assert out.columns[:5] == columns and (name == "sentencepiece" or out.columns == columns)
        kept[name], seen = out, out
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    model = langid.learn(docs.filter(crc_mod(F.col("doc_id"), 3) != 1))
    want = [r.doc_id for r in docs.collect() if model.predict(r.text)[0] != "und"
            and model.predict(r.text)[1] >= model.threshold]
    assert ids(kept["language_id"]) == sorted(want)
    rules = quality.learn(kept["language_id"], spark.read.parquet(f"{SF}/labels.parquet"), crc_mod(F.col("doc_id"), 4) != 2)
    want = quality.with_score(kept["language_id"], rules).filter("score >= 0.7")
    assert ids(kept["quality_rules"]) == ids(want)
    rows = [(r.doc_id, r.text) for r in kept["quality_rules"].collect()]
    assert ids(kept["jaccard_join"]) == sorted(i for i, (_, c) in brute.classes(rows).items() if i == c)
    assert set(ids(kept["poisson_mixing"])) <= set(ids(kept["jaccard_join"]))
    path = queries.tokenizer_path("piece_bpe_32k.model")
    last = kept["sentencepiece"].collect()
    assert len(last) == kept["poisson_mixing"].count()
    assert all(pieces.codec(path).decode(np.array(r.piece_ids)) == r.text for r in last[:50])


def test_pipeline_of_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "src1", 0), (2, None, "en", None, None)], DOCS)
    for extra in (docs.unionByName(odd).unionByName(docs.limit(3)).withColumn("copy", F.lit(7)).withColumn(
            "score", F.lit("s")), docs.limit(0)):
        out = extra
        for name, stage in corpus_pipeline.STAGES:
            out = staged(stage(spark, out, SF), "odd-" + name)
        assert set(extra.columns) <= set(out.columns)
        assert (out.count() > 0) == (extra.count() > 0)


def test_run_gives_the_last_stage(spark):
    r = corpus_pipeline.run(spark, SF)
    assert r.columns[-1] == "piece_ids" and 0 < r.count() < 400 and corpus_pipeline.ORACLE_SQL is None


def test_texts_stay_and_full_slot_tables_change_nothing(spark, monkeypatch):
    """Texts of sets that may link were shuffled by doc_id; a table of slots picks them where they are."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 3) * 100 + k + (k == 7) * (i % 3)}" for k in range(60))) for i in range(90)]
                                 + [(90, None), (91, "one two"), (92, "one two")], "doc_id long, text string")
    some = jaccard.id_table(docs.filter("doc_id % 9 = 0").select("doc_id"))
    sets = jaccard.shingle_tables(docs.filter("text IS NOT NULL"), some)
    assert "exchange" not in sets._jdf.queryExecution().executedPlan().toString().lower()
    assert {r.x for r in sets.collect()} >= set(range(0, 90, 9))
    rows = lambda: sorted(map(tuple, jaccard.jaccard_classes(docs).collect()))
    want = rows()
    assert [r[2] for r in want[-3:]] == [90, 91, 91] and [r[2] for r in want[:4]] == [0, 0, 0, 3]
    monkeypatch.setattr(jaccard, "id_table", lambda ids: np.full(1 << 12, 255, np.uint8))
    assert rows() == want


def test_points_that_cannot_link_by_size_leave_their_bucket(spark):
    """Any two points with a common leading shingle went to a region, with their sets, whatever their sizes."""
    fill = iter(range(1000, 2000))

    def point(x, n, shingle, early):
        return x, n, 1, [shingle, next(fill)] if early else [next(fill), shingle], [0, 0]

    rows = [point(1, 100, 7, True), point(2, 79, 7, True), point(3, 100, 8, True), point(4, 80, 8, True),
            point(5, 100, 9, False), point(6, 90, 9, False), point(7, 100, 10, False), point(8, 90, 10, True),
            point(9, 100, 11, True), point(10, 90, 11, False), point(11, 50, 12, False), point(12, 50, 12, True),
            (13, 100, 1, [13], [1]), (14, 5, 1, [13], [2])]
    points = spark.createDataFrame(rows, "x long, n long, shorts long, lead array<long>, salts array<int>")
    assert {r.x for r in jaccard.buckets(points).collect()} == {3, 4, 7, 8, 11, 12, 13, 14}


def test_texts_cut_at_the_threshold_still_meet(spark):
    rng, rows, want = random.Random(11), [], {}
    for k in range(150):
        n = rng.randrange(5, 160)
        words = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
        least = -(-8 * n // 10)
        a, b, c = 4 * k, 4 * k + 1, 4 * k + 2
        rows += [(a, " ".join(words)), (b, " ".join(words[:least + 4])), (c, " ".join(words[n - least + 1:]))]
        want |= {a: a, b: a}
        left, right = set(range(least)), set(range(n - least + 1, n))
        alone = len(right) * 100 < 80 * n and len(left & right) * 100 < 80 * len(left | right)
        want[c] = c if alone else a
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_what_blocks_ask_follows_shingles_not_ranges(spark, monkeypatch):
    """Each range got a size, a count and a tag of every set with a shingle there, more bytes than the shingles."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{k + 10**6 * (k > 300 and i % 2)}" for k in range(404))) for i in range(60)],
                                 "doc_id long, text string")
    made, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a: made.append(plain(self, *a)) or made[-1])

    def asked(bits):
        monkeypatch.setattr(jaccard, "RANGE_BITS", bits)
        made.clear()
        counts = sorted(r.shared for r in jaccard.shared_counts(docs, 1).collect())
        sent = made[0].select(sum(F.coalesce(F.length(c), F.lit(0)) for c, kind in made[0].dtypes if kind == "binary").alias("n"))
        return counts, sent.agg(F.sum("n")).first()[0]

    few, many = asked(4), asked(10)
    assert few[0] == many[0] == [297] * 60
    assert many[1] < 1.2 * few[1] and many[1] < 60 * 400 * 5


def test_owners_as_bits():
    for who, n in (([], 3), ([0, 0, 2, 5], 6), ([7], 8), ([1] * 9, 2), ([0], 1)):
        assert jaccard.bits_owner(jaccard.owner_bits(np.array(who, dtype=np.int32), n)).tolist() == who


def test_copies_ask_once_and_every_set_asks(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(9))
    rows = [(i, text(i % 40)) for i in range(400)] + [(1000, text(39)), (1000, text(77)), (2, text(78)), (2000, text(77)), (900, text(79))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard.digests(docs)
    reps = sets.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    got = [r.text for r in jaccard.askers(docs, reps, sets.join(reps, ["d1", "d2", "n"]).select("doc_id", "rep")).collect()]
    assert {*got} == {t for _, t in rows} and len(got) < 100


def test_points_with_a_shingle_in_common_by_chance_leave_their_region(spark, monkeypatch):
    """All points of a region were moved with their sets, however many met there by one shingle of long texts."""
    rng = np.random.default_rng(12)
    new = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    sets, want = [], []
    for n in (3, 40, 63, 64, 65, 127, 128, 129, 150, 500, 511, 513, 4000):
        a = new(n)
        gone = n // 5
        near = [a[gone:], np.concatenate([a[: n - n // 10], new(n // 10 - (n // 10) // 9)])]
        for b in near:
            both = np.intersect1d(a, b)
            if jaccard.linked(len(both), len(a) + len(b) - len(both)):
                sets += [a, b]
                want += [len(sets) - 2, len(sets) - 1]
        sets += [new(n + 200 + 3 * n * k) for k in range(3)]
    shared = new(1)
    sets = [np.unique(np.append(s, shared)) if i not in want else np.sort(s) for i, s in enumerate(sets)]
    keep = jaccard.may_link(np.array([len(s) for s in sets]), [jaccard.parities(s) for s in sets])
    assert keep[want].all() and len(want) > 20 and keep.sum() == len(want)
    points = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "x long, set binary")
    named = spark.createDataFrame([(r, i) for r in (0, 1) for i in range(len(sets))] + [(2, 0), (2, 1), (2, 4)], "region long, x long")
    near = lambda: sorted(map(tuple, jaccard.near_members(named, points).collect()))
    all_rows = sorted(map(tuple, named.collect()))
    assert near() == [r for r in all_rows if r[1] in want and r[0] < 2 or r in ((2, 0), (2, 1))]
    with monkeypatch.context() as m:
        m.setattr(jaccard, "REGION_BYTES", 100)
        assert {r for r in near() if r[0] < 2} == {r for r in all_rows if r[0] < 2}
    monkeypatch.setattr(jaccard, "SKETCH_ROWS", 3)
    assert near() == [r for r in all_rows if r[0] < 2 or r[1] != 4]


def test_rows_that_no_class_drops_stay_where_they_are(spark):
    """All texts were shuffled to drop a few."""
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(9))
    rows = [(i, text(i)) for i in range(600)] + [(700, text(5)), (701, text(5)), (9, text(800)), (9, text(9)), (None, text(5)), (702, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("_may", F.lit("mine"))
    classes = spark.createDataFrame([(i, 5 if i in (700, 701) else i) for i, _ in rows], "doc_id long, component_id long")
    kept = jaccard.one_per_class(docs, classes)
    plan = kept._jdf.queryExecution().executedPlan().initialPlan()
    while plan.nodeName() != "Union":
        plan = plan.children().apply(0)
    first = plan.children().apply(0).toString()
    assert "hashpartitioning" not in first and "BroadcastExchange" in first
    got = [(r.doc_id, r.text) for r in kept.collect()]
    want = [r for r in rows if r not in ((700, text(5)), (701, text(5)), (9, text(9)))]
    assert sorted(got, key=str) == sorted(want, key=str) and kept.columns == docs.columns
    own = {r.doc_id for r in jaccard.marked(docs, docs.filter("doc_id < 20").select("doc_id"), "hit").filter("hit").collect()}
    assert {*range(20)} <= own and len(own) < 100
