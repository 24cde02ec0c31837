"""Byte-level BPE by longest matches against the tiktoken library and plain merges."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from plantwave.llm import bytepairs, queries

from .test_texts import ODD, SF, clashing, documents, empty_docs, odd_docs

FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
PATH = P.path(FILES[0])


def library(name):
    with open(P.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(codec, texts):
    return [np.frombuffer(p, np.int32).tolist() for p in codec.encode(texts)]


@pytest.mark.parametrize("name", FILES)
def test_ids_of_random_texts(name):
    codec, other, rng = bytepairs.codec(P.path(name), P.PATTERN), library(name), random.Random(4)
    letters = [chr(i) for i in range(0x250)] + list("    \n\t'stdmrelv") * 20 + list("\x1c\x1f\x85\xa0 ​日本語한😀")
    texts = ["".join(rng.choices(letters, k=rng.randrange(50))) for _ in range(3000)]
    texts += ["".join(rng.choices("aabcdeisthnr ", k=rng.randrange(70))) for _ in range(3000)]
    texts += [b"".join(rng.choices(codec.tokens, k=rng.randrange(12))).decode("utf-8", "ignore") for _ in range(2000)]
    texts += ["a" * 5000, " " * 3000, "ab" * 4000, "=-" * 3000 + "=" * 999, "aaaaaaab" * 500, "<|endoftext|>"]
    for text, ids in zip(texts, ids_of(codec, texts)):
        assert ids == other.encode_ordinary(text), text
        assert codec.decode(np.array(ids, np.int32)) == text.encode()


def test_own_vocabularies_against_plain_merges():
    """Random merge lists, many of them with tokens that can be split in several ways."""
    for seed in range(20):
        rng = random.Random(seed)
        tokens = [bytes([b]) for b in range(256)]
        parts = [b"a", b"b", b"c"]
        for _ in range(60):
            new = rng.choice(parts) + rng.choice(parts)
            if new not in tokens and plain(new, tokens) is not None and len(plain(new, tokens)) == 2:
                tokens.append(new)
                parts.append(new)
        codec = bytepairs.BytePairs(tokens, r".+")
        for _ in range(200):
            text = "".join(rng.choices("abc", k=rng.randrange(1, 40)))
            assert codec.cover(text) == plain(text.encode(), tokens)


def plain(raw, tokens):
    rank = {t: i for i, t in enumerate(tokens)}
    parts = [raw[i:i + 1] for i in range(len(raw))]
    while True:
        found = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        if not found:
            return [rank[p] for p in parts]
        _, i = min(found)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_file_that_is_no_merge_list_is_refused():
    with pytest.raises(ValueError):
        bytepairs.BytePairs([bytes([b]) for b in range(256)] + [b"abc"], r".+")
    with pytest.raises(ValueError):
        bytepairs.BytePairs([b"a", b"b"], r".+")


def test_work_is_linear_in_a_piece():
    """Each place of a long piece is left at most once, so the asked pairs grow with its length."""
    codec = bytepairs.BytePairs(bytepairs.load_ranks(PATH), P.PATTERN)
    asked = []
    whole = codec.side_by_side
    codec.fits = type("Counting", (dict,), {"get": lambda self, k, d=None: asked.append(k) or dict.get(self, k, d)})()
    codec.side_by_side = whole
    counts = []
    for n in (20_000, 80_000):
        asked.clear()
        codec.cover("xqzab0aq" * (n // 8))
        counts.append(len(asked))
    assert counts[1] < 4.5 * counts[0]


def test_small_stores_change_nothing(monkeypatch):
    codec = bytepairs.BytePairs(bytepairs.load_ranks(PATH), P.PATTERN)
    texts = [f"word{i % 37} other{i % 11}, and the rest" for i in range(300)]
    want = ids_of(codec, texts)
    monkeypatch.setattr(bytepairs, "KEPT_UNITS", 5)
    monkeypatch.setattr(bytepairs, "KEPT_PAIRS", 7)
    small = bytepairs.BytePairs(bytepairs.load_ranks(PATH), P.PATTERN)
    assert [i for t in texts for i in ids_of(small, [t])] == want and len(small.fits) <= 7


def test_query_equals_the_library(spark):
    other = library(FILES[0])
    got = {r.doc_id: r for r in queries.QUERIES["op11_byte_pair_cover"](spark, SF).collect()}
    rows = documents(spark).select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = other.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_odd_rows(spark):
    df = bytepairs.with_tokens(clashing(odd_docs(spark)).withColumn("token_ids", F.lit("mine")), PATH, P.PATTERN)
    r = bytepairs.with_bytes(df, PATH, P.PATTERN).collect()
    assert len(r) == len(ODD) + 4
    other = library(FILES[0])
    for row in r:
        assert row.token_ids == other.encode_ordinary(row.text or "") and bytes(row.decoded) == (row.text or "").encode()
        assert row["_text"] == "mine"
    assert bytepairs.digests(odd_docs(spark), PATH, P.PATTERN).count() == len(ODD) + 4
    assert bytepairs.with_tokens(empty_docs(spark), PATH, P.PATTERN).count() == 0
    assert bytepairs.digests(empty_docs(spark), PATH, P.PATTERN).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, token_ids array<int>")
    got = {x.doc_id: x.decoded for x in bytepairs.with_bytes(none, PATH, P.PATTERN).collect()}
    assert got[1] is None and bytes(got[2]) == b""


def test_a_path_is_shortened_to_its_token_once():
    """From a path of the automaton that is no token, each byte of the way back was a look-up, at every place again."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"cd", b"abcd"]
    codec = bytepairs.BytePairs(tokens, r".+")
    assert codec.cover("abc" * 3) == [256, ord("c")] * 3
    assert codec.first["abc"] == 256 and "abc" not in codec.known


def test_a_word_is_covered_once_whatever_signs_follow_it(monkeypatch):
    """Each unit was covered anew, and most new units are known words with other signs around them."""
    codec, other = bytepairs.BytePairs(bytepairs.load_ranks(PATH), P.PATTERN), library(FILES[0])
    monkeypatch.setattr(bytepairs, "KEPT_PIECES", 40)
    cover, met = codec.cover, []
    monkeypatch.setattr(codec, "cover", lambda piece: (met.append(piece), cover(piece))[1])
    texts = [f" anreeaqu{end}" for end in ("", ",", ".", "!!!", "$$$", "'s", "…", "9")]
    assert ids_of(codec, texts) == [other.encode_ordinary(t) for t in texts]
    assert met.count(" anreeaqu") == 1
    texts = [f" wort{i:03d}xé{i}" for i in range(300)]
    assert ids_of(codec, texts) == [other.encode_ordinary(t) for t in texts] and len(codec.pieces) <= 40
