"""Queries of the operators on whole documents and pages that stay inside DataFrame functions, and of extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import html_text, quality_rules, url_trust
from wordloom.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.judge(docs).drop("source")


def op2_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(table(spark, sf_dir, "pages"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_quality_rules": op1_quality_rules, "op2_url_trust": op2_url_trust, "op10_html_text": op10_html_text}
ORACLES = {"op1_quality_rules": quality_rules.SQL, "op2_url_trust": url_trust.SQL}
