"""Language, quality, pages, pieces and id files against plain versions and known answers."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantwave.llm import chat, common, dom, idfiles, langid, mixing, pages, pieces, quality, queries, trees

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n", "a", "x" * 5000, "word " * 3000, "12 34 %%%", "<s>|</s>", "é ñ ß\t\x0b q", "a\nb\n\n c",
       "<|im_end|>", "▁a ▁▁b", "日本 語", "\x00\x01", "don't l'été"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    """Null columns, repeated rows, ties, and long and empty texts."""
    rows = [(i, t, "en", "src0", 0) for i, t in enumerate(ODD)] + [(3, ODD[3], None, None, None)] * 2
    rows += [(None, "no id here", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Columns named like those that operators add or use inside."""
    for name in ("score", "accepted", "_text", "_key", "_draw", "copy", "_copies", "_order", "_statistics", "piece_ids",
                 "lang_pred", "_place"):
        df = df.withColumn(name, F.lit("mine"))
    return df


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- language ---------------------------------------------------------------------------------

def test_language_on_rows_kept_aside(spark):
    r = queries.QUERIES["op5_language_id"](spark, SF).join(documents(spark).select("doc_id", "lang"), "doc_id").toPandas()
    assert len(r) == 200 and set(r.lang_pred) <= {"en", "de", "fr", "es"}
    held = r[r.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and held.accepted.mean() > 0.98
    assert (r.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in r.doc_id]).all()


def test_language_of_odd_rows(spark):
    model = langid.learn(documents(spark))
    r = langid.with_language(odd_docs(spark), model).toPandas()
    assert len(r) == len(ODD) + 4
    none = r.text.isna() | ~r.text.fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert ((r.lang_pred == "und") == none).all() and not r.accepted[none].any()
    assert r.score.between(0, 1).all()
    assert langid.with_language(empty_docs(spark), model).count() == 0


def test_language_without_training_rows(spark):
    model = langid.learn(empty_docs(spark))
    assert model.predict("some words") == ("und", 0.0)
    assert langid.train(["a b c"], ["en"]).predict("x")[0] == "en"


def test_language_sums_in_pieces(monkeypatch):
    text = "the quick brown fox " * 400
    table = np.random.default_rng(0).normal(size=(langid.SLOTS, 3)).astype(np.float32)
    whole, n = langid._sums(table, text)
    monkeypatch.setattr(langid, "_PIECE", 777)
    parts, m = langid._sums(table, text)
    assert n == m and np.allclose(whole, parts, rtol=1e-4)


# --- quality ------------------------------------------------------------------------------------

def test_quality_on_rows_kept_aside(spark):
    sf = "/root/testdata/sf0.01"
    r = queries.QUERIES["op1_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = r[r.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert (r.predicted == (r.score >= 0.7)).all()


def test_rules_as_columns_equal_numpy(spark):
    docs = documents(spark).limit(60)
    stats = quality.statistics(F.col("text"))
    x = docs.select(*(c.alias(k) for k, c in stats.items())).toPandas()
    y = (x["symbols_a_word"] > x["symbols_a_word"].median()).to_numpy(float)
    rules = quality.fit(list(stats), x.to_numpy(float), y)
    got = quality.with_score(docs, rules).select("score").toPandas().score
    assert np.allclose(got, rules.score(x.to_numpy(float))) and len(rules.rules) > 0
    assert ((got > 0.5) == (y > 0.5)).mean() > 0.9


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (None, 1), (4, None)], "doc_id long, quality int")
    rules = quality.learn(odd_docs(spark), labels, F.lit(True))
    r = quality.with_score(clashing(odd_docs(spark)), rules).toPandas()
    assert len(r) == len(ODD) + 4 and r.score.between(0, 1).all() and (r.accepted == "mine").all()
    none = quality.learn(empty_docs(spark), labels.limit(0), F.lit(True))
    assert quality.with_score(empty_docs(spark), none).count() == 0


def test_trees_learn_a_conjunction():
    x = np.random.default_rng(1).random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.3)).astype(float)
    m = trees.fit(x, y, rounds=15)
    assert ((m.margin(x) > 0) == (y > 0)).mean() > 0.98
    assert any({(f, a) for f, a, _ in p} == {(0, True), (2, False)} for p in trees.paths(m))


# --- pages ---------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p>"</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a><li><a href=/b>More</a></ul></nav>
<div class="cookie-banner">We use cookies.</div><article><h1>Rivers &amp; lakes</h1><p>One <b>bold</b>  line.<br>Next.
<p>Two, still &lt;here&gt;.</p><div class="ad">Buy now!</div><ul><li>first point of it<li>second point of it</ul></article>
<aside class="sidebar"><h3>Related</h3><a href=/x>Other story</a></aside>
<form><label>Mail</label><input><button>Join</button></form>
<section id="comments"><div class="comment"><p>I liked this a lot.</p></div></section><footer>&copy; us</footer></body>"""


@pytest.fixture(scope="module")
def page_model():
    return pages.train("rain river stone house green walk paper light under between little often".split())


def test_article_without_the_rest(page_model):
    assert page_model.extract([PAGE]) == [
        "Rivers & lakes One bold line. Next. Two, still <here>. first point of it second point of it"]


def test_given_pages_whole(spark):
    import html
    import re
    r = queries.QUERIES["op3_html_blocks"](spark, SF).toPandas()
    have = spark.read.parquet(f"{SF}/pages.parquet").toPandas().merge(r, on=["page_id", "url"])
    for row in have.itertuples():
        body = re.search(r"<article>(.*?)</article>", row.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert row.text == " ".join(p for p in parts if p) and row.n_chars == len(row.text)


def runs(html):
    return [text for _, text in dom.read_pages([html]).runs]


@pytest.mark.parametrize("tag, said", [
    ("<svg-icon name='x'></svg-icon>", []), ("<video-player src=a></video-player>", []), ("<audio-player></audio-player>", []),
    ("<svg width='1' />", []), ("<svg/>", []), ("<math/>", []), ("<math />", []), ("<svg><text>no</text></svg>", []),
    ("<video src=a>no</video>", []), ("<math><mi>x</mi><mo>+</mo><mn>1</mn></math>", ["x+1"])])
def test_tags_end_where_they_end(page_model, tag, said):
    body = f"<body>{tag}<article><p>River and stone. Paper light.</p></article></body>"
    assert runs(body) == [*said, "River and stone. Paper light."]
    assert page_model.extract([body])[0].endswith("River and stone. Paper light.")


def test_math_and_long_names_are_read(page_model):
    page = "<article><p>River of <math><mi>x</mi><mo>+</mo><mn>1</mn></math> stones.</p></article>"
    assert page_model.extract([page]) == ["River of x+1 stones."]
    assert dom.read_pages([f'<div class="{"a1 " * 100} sidebar">x</div>']).tokens[1][-1] == "sidebar"


def test_inline_tags_stay_in_their_paragraph(page_model):
    said = 'see <a class="ref" href="/x">here</a>, wo<span class=x>rd</span> and <a href="/y?id=nav">the <b id=k>other</b></a> one.'
    assert runs(f"<article><p>{said}</p></article>") == ["see here, word and the other one."]
    long = "River and stone, paper light under the walk. " * 3
    for tag in ('a href=/x class="ref"', 'span class="highlight"', 'em id="share"', 'a href="/p?role=menu"', "b class=ad"):
        page = f"<nav><a class=menu href=/>Home</a></nav><article><h1>Walk</h1><p>{long}<{tag}>green</{tag.split()[0]}>, house.</p></article>"
        assert page_model.extract([page]) == [f"Walk {long}green, house."]
    nodes = dom.read_pages(['<p class="lead">one <a class="ref" href="/?id=nav">two</a> <i class="icon"></i></p>'])
    assert nodes.tag == ["#root", "p"] and nodes.tokens[1] == ("lead", "ref")
    laid = pages._Layout(np.random.default_rng(0), ["word"])
    assert any("<span class=" in laid.prose(5, 9) for _ in range(200))


def test_choices_never_contradict(page_model):
    nodes = dom.read_pages([PAGE, "", None, "<p>only", "<div>" * 300 + "deep" + "</p>" * 5, "<a b='", "text & more"])
    keep = dom.decode(nodes, np.random.default_rng(0).normal(size=len(nodes.tag)))
    parent = np.array(nodes.parent)
    assert keep[parent[(parent >= 0) & keep]].all()
    assert page_model.extract([None, ""]) == ["", ""] and page_model.extract([]) == []


def test_decoding_is_the_best_choice():
    nodes = dom.read_pages(["<div><p>a<p>b</div><section><p>c</section>"])
    n = len(nodes.tag)
    rng = np.random.default_rng(3)
    for _ in range(20):
        margin = rng.normal(size=n)
        best = max((sum(margin[i] for i in range(n) if mask >> i & 1) for mask in range(1 << n)
                    if all(nodes.parent[i] < 0 or mask >> nodes.parent[i] & 1 for i in range(n) if mask >> i & 1)))
        assert abs(margin[dom.decode(nodes, margin)].sum() - best) < 1e-9


def test_odd_pages(spark, page_model):
    rows = [(1, "u", None), (1, None, "<p>x"), (None, "u", ""), (2, "u", "<p>" + "long text. " * 20000)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    r = pages.main_text(df, page_model).toPandas()
    assert len(r) == 4 and (r.n_chars == r.text.str.len()).all() and r.n_chars.max() > 200_000
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.main_text(none, pages.learn(none)).count() == 0


# --- chat ------------------------------------------------------------------------------------------

def test_escapes_are_reversible(spark):
    texts = ["<|im_end|>", "<\\|x", "<\\\\|", "<<||", "\\", "a\\nb", "", "<|<\\|"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("b"),
        chat.unescape_role(chat.escape_role(F.concat("t", F.lit("\nr\\")))).alias("r"))
    for row in d.collect():
        assert row.b == row.t and "<|" not in row.e and row.r == row.t + "\nr\\"


def test_every_reply_has_its_prefix(spark):
    rows = [(1, 2, "assistant", "B<|im_end|>"), (1, 1, "user", "A"), (1, 3, "user", "C"), (1, 4, "assistant", None),
            (1, 5, "user", "tail"), (2, 0, "user", "alone"), (None, None, None, None), (1, 4, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    e = chat.examples(turns).orderBy("conv_id", "example").collect()
    one = [r for r in e if r.conv_id == 1]
    assert len(one) == 4 and [r.loss_start is None for r in one] == [False, False, False, True]
    assert one[0].text[one[0].loss_start:one[0].loss_end] == "B<\\|im_end|>"
    assert all(b.text.startswith(a.text) for a, b in zip(one, one[1:]))
    d = {r.conv_id: r for r in chat.digests(chat.examples(turns)).collect()}
    assert d[1].n_turns == 6 and d[1].loss_chars == len("B<|im_end|>") and d[2].loss_chars == 0 and d[None].n_turns == 1
    assert chat.digests(chat.examples(turns.limit(0))).count() == 0


# --- mixing ------------------------------------------------------------------------------------------

def test_mixture_meets_its_targets(spark):
    d = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(
        F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").otherwise(F.col("id").cast("string")).alias("source"))
    r = mixing.mix(d, {"hot": 1.0, "b": 2.0}, rest=1.0)
    n = {x.k: x.n for x in r.groupBy(F.when(F.col("source").isin("hot", "b"), F.col("source")).otherwise("rest").alias(
        "k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(n["hot"] - 10_000) < 400 and abs(n["b"] - 20_000) < 600 and abs(n["rest"] - 10_000) < 400
    same = mixing.counted(d.repartition(7), {"hot": 1.0, "b": 2.0}).agg(F.sum("copies")).first()[0]
    assert same == r.count()


def test_poisson_steps():
    for mean in (0.1, 1.0, 7.5, 900.0):
        s = mixing.poisson_steps(mean)
        assert abs(s[-1] - 1) < 1e-9 and abs(sum(1 - x for x in s) - mean) < 1e-6 * max(mean, 1)
    assert mixing.poisson_steps(0) == []


def test_mixture_of_odd_rows(spark):
    r = mixing.mix(clashing(odd_docs(spark)), {"src0": 1.0}, rest=1.0, rows_out=4000, copy="again").toPandas()
    assert 3500 < len(r) < 4500 and (r["copy"] == "mine").all() and set(r.columns) >= {"again", "_key"}
    assert mixing.mix(empty_docs(spark)).count() == 0
    assert mixing.mix(odd_docs(spark), {"src0": 0.0}, rest=0.0).count() == 0


# --- pieces --------------------------------------------------------------------------------------------

def test_parity_with_sentencepiece(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    texts = [t for t in ODD if t is not None] + [r.text for r in documents(spark).collect()]
    codec = pieces.codec(path)
    assert codec.apart and codec.verify(texts, path) == []


def test_unigram_model_is_rebuilt(tmp_path):
    """A file written by hand: four pieces with scores; the best split wins."""
    import struct

    def text(number, raw):
        return bytes([number << 3 | 2, len(raw)]) + raw
    body = b""
    for piece, score, kind in (("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("ab", -2.5, 1), ("b", -2.0, 1), ("▁a", -2.1, 1)):
        body += text(1, text(1, piece.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))
    body += text(2, bytes([3 << 3, 1])) + text(3, bytes([3 << 3, 1, 4 << 3, 0]))
    (tmp_path / "m.model").write_bytes(body)
    c = pieces.Codec(str(tmp_path / "m.model"))
    assert np.frombuffer(c.encode(["ab"])[0], c.dtype).tolist() == [5, 4]
    assert c.decode(np.array([5, 4])) == "ab"


def test_pieces_of_odd_rows(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    d = pieces.with_text(pieces.with_pieces(clashing(odd_docs(spark)), path), path).toPandas()
    assert len(d) == len(ODD) + 4 and (d._text == "mine").all()
    assert (d.decoded == d.text.fillna("").str.replace("▁", " ")).all()
    r = pieces.encoded_documents(documents(spark), path).toPandas()
    assert r.restored.all() and (r.n_pieces == r.piece_ids.map(len)).all()
    assert pieces.with_pieces(empty_docs(spark), path).count() == 0


# --- id files ------------------------------------------------------------------------------------------

def test_coding_round_trip():
    rng = np.random.default_rng(5)
    ranks = [rng.integers(0, 2**k, n).astype(np.uint32) for k, n in ((3, 7), (12, 0), (20, 5), (32, 9), (8, 1))]
    docs, counts, got = idfiles.read_image(idfiles.image([4, None, 6, 7, 8], ranks))
    assert docs == [4, None, 6, 7, 8] and counts.tolist() == [7, 0, 5, 9, 1] and (got == np.concatenate(ranks)).all()
    with pytest.raises(ValueError):
        idfiles.read_image(idfiles.image([1], [ranks[0]])[:-1])


def test_files_give_back_all_ids(spark, tmp_path):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path("word_bpe_49k.json")
    docs = documents(spark).select("doc_id", "text").union(odd_docs(spark).select(F.col("doc_id") - 100, "text"))
    files = idfiles.token_files(docs, path, path=str(tmp_path / "ids"), image_ids=5000)
    got = idfiles.digests(spark, files).toPandas().sort_values(["start", "n_tokens"])
    rows = docs.toPandas()
    plain = Tokenizer.from_file(path)
    rows["ids"] = [np.array(e.ids + [2], "<u4").tobytes() for e in plain.encode_batch(
        rows.text.fillna("").tolist(), add_special_tokens=False)]
    assert len(got) == len(rows) and got.start.tolist() == (got.n_tokens.cumsum() - got.n_tokens).tolist()
    want = sorted((-10**9 if pd.isna(d) else d, len(i) // 4, zlib.crc32(i)) for d, i in zip(rows.doc_id, rows.ids))
    assert want == sorted((-10**9 if pd.isna(d) else d, n, c) for d, n, c in zip(got.doc_id, got.n_tokens, got.ids_crc32))
    assert got.doc_id.dropna().is_monotonic_increasing
    assert idfiles.token_files(empty_docs(spark), path, path=str(tmp_path / "none")) is not None


def test_free_names():
    assert common.free(["A", "_a", "b"], "a", "c") == ["__a", "c"]


# --- long rows and control characters ----------------------------------------------------------------------

def test_language_learns_from_long_texts_only(spark):
    """Texts beyond the bound are learnt from in pieces of the whole text; a fixed slot count checks the mean."""
    rows = documents(spark).filter("lang IS NOT NULL").groupBy("lang").agg(
        F.min("doc_id").alias("doc_id"), F.array_join(F.collect_list("text"), " ").alias("text"))
    model = langid.learn(rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(10)))).withColumn(
        "text", F.concat("text", F.lit(" "), F.col("i").cast("string"))), train_chars=2000)
    assert set(model.langs) == {"en", "de", "fr", "es"}
    r = langid.with_language(documents(spark), model).toPandas().dropna(subset=["lang"])
    assert (r.lang == r.lang_pred).mean() > 0.9


def test_pieces_of_a_long_text_span_it(spark):
    df = spark.createDataFrame([("".join(f"{i:05d}" for i in range(2000)),), ("short",), (None,)], "text string")
    long, short, none = [r.t for r in df.select(langid.bounded(F.col("text"), 100, 5).alias("t")).collect()]
    assert long.split() == ["".join(f"{i:05d}" for i in range(2000))[a:a + 20] for a in (0, 2495, 4990, 7485, 9980)]
    assert short == "short" and none is None


def test_mean_embedding_against_plain_counts():
    """The mean over hashed subwords, one byte after another in Python."""
    rng = np.random.default_rng(0)
    table = rng.normal(size=(langid.SLOTS, 3))
    for text in ("a", "Hallo Welt, 12 é!", "x" * 90, "The 3 büros\n"):
        raw = f" {text.lower()} ".encode()
        gap = [32 if b < 128 and not chr(b).isalpha() else b for b in raw]
        total, count = np.zeros(3), 0
        for k in (2, 3, 4):
            for i in range(len(gap) - k + 1):
                h = sum((gap[i + j] + 1) * int(langid._MULTIPLY[j]) for j in range(k)) & 0xFFFFFFFF
                total += table[((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 17]
                count += 1
        got, n = langid._sums(table, text)
        assert n == count and np.allclose(got, total)


def test_words_of_long_pages_train_the_model(spark):
    df = spark.createDataFrame([(1, "<p>" + "anfang " * 40_000 + "<i>ende</i></p>"), (2, None)], "page_id long, html string")
    seen = []
    import plantwave.llm.pages as module
    kept, module.train = module.train, seen.append
    try:
        module.learn(df)
    finally:
        module.train = kept
    assert seen == [["anfang", "ende"]]


def test_any_role_reads_back(spark):
    roles = ["us\x00er", "a\\b", "\\n", "\n\\", "<|x", "<\\|", "<\\\\|s\\s", "", "assistant", "\\s\\n\n<|im_end|>"]
    rows = [(i, 0, r, "<|im_start|>t") for i, r in enumerate(roles)]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = made.select("conv_id", chat.parse(F.col("text")).alias("turns")).collect()
    assert {r.conv_id: r.turns[0].role for r in got} == dict(enumerate(roles))
