"""Registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, chat, jaccard, mixing, topk
from .common import crc_mod, short_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op8_token_id_files")
def op8(spark, sf):
    from . import idfiles
    files = idfiles.token_files(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return idfiles.digests(spark, files)


@query("op10_jaccard_join", jaccard.SQL)
def op10(spark, sf):
    return jaccard.jaccard_classes(table(spark, sf, "documents"))


@query("op5_language_id")
def op5(spark, sf):
    from . import langid
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = langid.learn(docs.filter(~held_out))
    rows = langid.with_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "lang_pred", "score", "accepted")


@query("op1_quality_rules")
def op1(spark, sf):
    from . import quality
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rules = quality.learn(docs, table(spark, sf, "labels"), crc_mod(F.col("doc_id"), 4) != 2)
    rows = quality.with_score(docs, rules)
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                       F.when(F.col("score") >= quality.KEEP_FROM, 1).otherwise(0).alias("predicted"))


@query("op4_chat_prefix_targets", chat.SQL)
def op4(spark, sf):
    return chat.digests(chat.examples(chat.with_planted(table(spark, sf, "conversations"))))


@query("op2_poisson_mixing", mixing.sql())
def op2(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@query("op6_sentencepiece")
def op6(spark, sf):
    from . import pieces
    return pieces.encoded_documents(table(spark, sf, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op7_multi_index_hashing")
def op7(spark, sf):
    from . import mih
    return mih.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op9_term_at_a_time", topk.SQL)
def op9(spark, sf):
    return topk.search(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query("op3_html_blocks")
def op3(spark, sf):
    from . import pages
    html = table(spark, sf, "pages")
    return pages.main_text(html, pages.learn(html))


@query("op11_byte_pair_cover")
def op11(spark, sf):
    import public_tokenizers
    from . import bytepairs
    return bytepairs.digests(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"),
                             public_tokenizers.PATTERN)


@query("op13_spelling_groups")
def op13(spark, sf):
    from . import spelling
    return spelling.spelling_groups(table(spark, sf, "documents"))


@query("op12_ball_tree_search", balltree.SQL)
def op12(spark, sf):
    return balltree.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
