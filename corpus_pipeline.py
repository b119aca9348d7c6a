"""The corpus pipeline: stages over documents, each given what its predecessor kept.

Every stage but the last returns the columns of documents, with n_chars as the code points of the text it leaves.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import bpe_transducer, decontaminate, near_dups, quality_rules, substring_dedup
from wordloom.llm.common import table, written


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that their host repeats."""
    return _counted(quality_rules.cleaned(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates. Rows that share an id are each judged by their text; null ids stay."""
    return near_dups.without_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word windows that earlier documents have."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    return _counted(substring_dedup.dedup(docs, carry), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that mostly consist of them go."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    return _counted(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), carry), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the bytes decoded from them."""
    return bpe_transducer.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: SQL cannot express the last stage; tests hold all five against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written before the next one begins."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
