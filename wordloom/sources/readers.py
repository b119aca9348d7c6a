"""Readers of raw sources by kind, each a DataFrame of records with an explicit schema, and their ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.sources import json_arrays

SPACES = " \t\r\n\x0b\x0c"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and broken (whether bytes that are no UTF-8 were replaced) of each line."""
    raw = spark.read.text(path)
    return raw.select(F.make_valid_utf8("value").alias("value"), (~F.is_valid_utf8("value")).alias("broken"))


def delimited(spark: SparkSession, path: str, delimiter: str = "\t", header: str | None = None) -> DataFrame:
    """fields of each line that is not blank; there are no quotes, and short rows stay. Lines equal to `header` are left out."""
    stripped = F.btrim("value", F.lit(SPACES))
    rows = lines(spark, path).where(stripped != "")
    return (rows if header is None else rows.where(stripped != header.strip(SPACES))).select(F.split(stripped, f"\\Q{delimiter}\\E").alias("fields"), "broken")


def delimited_quoted(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = "\t", header: bool = False) -> DataFrame:
    """Records with quoted fields that may hold line ends; all-blank records are left out."""
    read = spark.read.schema(schema).option("sep", delimiter).option("header", header).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    filled = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "" for c in schema.names]
    some = filled[0]
    for f in filled[1:]:
        some |= f
    return read.where(some)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object a line; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, element: T.DataType, root: str | None = None) -> DataFrame:
    """element: the members of the array that each file is, or that its key `root` holds; see json_arrays.read()."""
    return json_arrays.read(spark, path, element, root)


def wiki_pages(spark: SparkSession, path: str, namespace: int = 0) -> DataFrame:
    """title and text of the pages of one namespace of an XML dump."""
    schema = "title string, ns int, revision struct<text: string>"
    read = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return read.where(F.col("ns") == namespace).select(F.btrim(F.regexp_replace(F.translate("title", "_", " "), "\\s+", " ")).alias("title"), F.col("revision.text").alias("text"))


READERS = {"delimited": delimited, "delimited-quoted": delimited_quoted, "jsonl": json_lines, "json-array": json_array, "mediawiki-xml": wiki_pages}


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"no reader of kind {kind}; known are {', '.join(READERS)}")
    return READERS[kind](spark, path, **options)
