"""Corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and all but the last return the columns of ``docs``. A
stage sees all rows its predecessor kept and its decisions take effect: rows go, or are packed.
Extra columns are carried along. An empty table gives an empty one. What a null doc_id, a null or
empty text and repeated rows mean to a stage is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm import decontaminate, langid, neardup, packing, quality, tokens
from sessionloom.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a probability of at least 0.5.

    Null and empty texts and those without letters go. Repeated rows stay or go together; a null doc_id is as good as any.
    """
    return langid.keep_known(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.3.

    Null and empty texts are scored as empty ones. Repeated rows stay or go together; null labels teach nothing.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of similarity 0.8 or more in shingles of five words.

    Texts without words and rows without a doc_id are in no group and stay; rows that repeat a kept doc_id all stay.
    """
    return neardup.keep_first(docs, neardup.SHINGLE)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage of ten words, nor a whole shorter item.

    Null and empty texts hold none. Repeated rows stay or go together; null items are no passage.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in training sequences of 2,048 ids.

    A null or empty text is one piece of the end id. Repeated rows are packed each; a null doc_id stays null.
    """
    return packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("quality", good),
    ("near_duplicates", distinct),
    ("decontamination", clean),
    ("packing", packed),
]
#: Trained models and library tokenizers are beyond SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
