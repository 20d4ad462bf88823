"""The corpus pipeline: clean, identify, deduplicate, pack.

Every stage is ``(spark, docs, sf_dir) -> DataFrame`` and calls one operator of
``siteloom.llm``; all but the last return the columns of ``documents``.  A
driver may write each stage's rows as Parquet and read them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import jaccard, langid, packing, quality
from siteloom.llm.common import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep most of their text when bad lines are removed."""
    prepare(spark)
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones show."""
    prepare(spark)
    return langid.Identifier(docs.where(~langid.held_out(F.col("doc_id")))).keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, 0.8 or more."""
    return jaccard.keep_first(docs, n=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("pack", pack),
]

#: Language models and tokenizers aren't SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
