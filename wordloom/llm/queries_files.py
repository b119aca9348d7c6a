"""Queries of the operators that write files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import warc
from wordloom.llm.common import shared_dir, table


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, payload=False).drop("url")


QUERIES = {"op6_warc": op6_warc}
ORACLES = {"op6_warc": warc.SQL}
