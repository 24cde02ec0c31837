"""A training corpus from the documents: language, quality, near duplicates, mixture, token ids.

Each stage takes all rows that the one before it kept, is written as Parquet to the shared folder and
read again.  All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwave.llm import jaccard, langid, mixing, pieces, quality
from plantwave.llm.common import crc_mod, free, short_batches, staged
from plantwave.llm.queries import table, tokenizer_path

#: Models decide, so no SQL gives the rows; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is uncertain."""
    short_batches(spark)
    model = langid.learn(docs.filter(crc_mod(F.col("doc_id"), 3) != 1))
    names = free(docs.columns, "lang_pred", "lang_score", "accepted")
    return langid.with_language(docs, model, tuple(names)).filter(F.col(names[2])).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a quality score below 0.7."""
    rules = quality.learn(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2)
    score, = free(docs.columns, "quality_score")
    return quality.with_score(docs, rules, score).filter(F.col(score) >= quality.KEEP_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of texts linked by a Jaccard similarity of 0.8."""
    return jaccard.one_per_class(docs, jaccard.jaccard_classes(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources get their target shares, in random order."""
    copy, = free(docs.columns, "copy")
    return mixing.mix(docs, copy=copy).drop(copy)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the SentencePiece ids of each text."""
    return pieces.with_pieces(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", languages),
    ("quality_rules", good_quality),
    ("jaccard_join", near_duplicates),
    ("poisson_mixing", mixture),
    ("sentencepiece", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
