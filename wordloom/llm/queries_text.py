"""Queries of the operators that compare texts with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import collocations, decontaminate, license_scan, near_dups, ranked_search, substring_dedup, suffix_dedup
from wordloom.llm.common import table

#: Similarity of linked documents in op3.
LINK_PERCENT = 85


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), LINK_PERCENT)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_near_duplicates": op3_near_duplicates, "op4_decontaminate": op4_decontaminate, "op5_substring_dedup": op5_substring_dedup, "op7_suffix_dedup": op7_suffix_dedup, "op11_license_scan": op11_license_scan, "op12_collocations": op12_collocations, "op13_ranked_search": op13_ranked_search}
ORACLES = {"op3_near_duplicates": near_dups.sql(LINK_PERCENT), "op4_decontaminate": decontaminate.SQL, "op5_substring_dedup": substring_dedup.SQL, "op11_license_scan": license_scan.SQL, "op12_collocations": collocations.SQL, "op13_ranked_search": ranked_search.SQL}
